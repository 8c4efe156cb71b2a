"""Decisions for a whole portfolio: underwriting inputs, readiness gates and the decision run, one row a case.

Everything a person states or confirms for a case comes as a table `cases`, so a run is a join and not a form. Nothing here
collects: per-case flags are partial aggregates, and a case without gates is the only one that gets a range.
"""

from __future__ import annotations

from collections.abc import Callable

from ledgerloom import rules
from ledgerloom.functions.money import CENTS
from ledgerloom.lineage import kept_by, written
from ledgerloom.operators import classify as K
from ledgerloom.operators import coverage as C
from ledgerloom.operators import debt as D
from ledgerloom.operators import metrics as M
from ledgerloom.operators import policy as P
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a run asks for.
LEAST_REVENUE = 10_000
ALLOWED_STATUSES = ["reconciled_candidate_review_required", "ai_reconciled_candidate_review_required"]
DEFAULT_TEXT = r"\b(?:DEFAULT|PAST DUE|COLLECTION)\b"
SUSPECT = "Suspected manipulation"
DEFAULT_TERM, DEFAULT_FACTOR = 6, "1.46"
#: Extraction methods whose rows a person has to confirm.
READ_BY_MODEL = ["ai_pdf", "ai_pdf_pages"]
#: Gates about evidence, which a signed override of exactly these data clears; the others it does not.
DIAGNOSTIC = [
    "statement_issues", "disallowed_status", "extraction_unconfirmed", "no_daily_balances", "fees_without_returns", "pages_unreviewed",
    "coverage_unacknowledged", "integrity_unreviewed", "originals_not_compared", "hard_stop",
]


def data_signature(ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """(case_id, signature): a hash of all rows of a case's ledger and statements, whatever their order. A number, two
    sums and two exclusive ors of row hashes are hashed, so no case is gathered."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        cols = [F.col(c) for c in sorted(df.columns)]
        h, g = F.xxhash64(*cols), F.xxhash64(F.lit(name), *cols)
        return df.groupBy("case_id").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(g).alias("y"), F.sum(h.cast("decimal(20,0)")).alias("s"))

    both = digest(ledger, "l").withColumn("part", F.lit("l")).unionByName(digest(statements, "s").withColumn("part", F.lit("s")))
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "n", "x", "y", "s"))), "|")
    return both.groupBy("case_id").agg(F.sha2(shown, 256).alias("signature"))


def underwriting_inputs(
    ledger: DataFrame, statements: DataFrame, months: DataFrame, positions: DataFrame | None = None, matcher: Callable[[Column], Column] | None = None,
    covered: DataFrame | None = None,
) -> DataFrame:
    """Measures of the chosen months of every case that has statements (revenue, trend, ...: see `revenue_metrics`),
    average daily balance, negative days (null if balances can't be rebuilt), returned items and fees, distinct lenders
    paid, velocity, operating outflows, monthly debt (of verified positions; without a schedule the average of what is
    paid), and the counts of positions.

    ledger: a classified ledger with seq and statement_period_start; statements with opening and rate; months as of
    `chosen_months`; positions as of `seed_positions`; covered: the covered spans, where they are at hand. Tables by case are
    best kept by case (`lineage.kept_by`): all that is joined here is one row a case.
    """
    spans = kept_by(C.covered_spans(statements)) if covered is None else covered
    rows = written(C.covered_rows(ledger, spans, months))
    paid = D.debt_payments(rows, matcher).select("case_id", "id", "lender", "amount", "month") if positions is None else D.debt_payment_rows(rows, positions, matcher)
    paid = written(paid)
    ids = paid.select("case_id", "id").distinct()
    match = (matcher or K.lender_match)(F.col("description"))
    lenders = rows.where("tx_type = 'debit'").join(ids, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.count_distinct(match["lender"]).alias("lenders"))
    own = rows.where("tx_type = 'debit' and not coalesce(internal_transfer, false)").join(ids, ["case_id", "id"], "left_anti")
    parts = [
        M.revenue_metrics(rows, months).withColumnRenamed("average", "revenue"), lenders, M.monthly_average(own, months, "operating_outflows"),
        M.returned_payments(ledger).select("case_id", F.col("returned_items").alias("returned"), "fee_rows"),
        C.daily_balances(statements, ledger, months, spans).select("case_id", F.round("average_daily_balance", 2).alias("average_daily_balance"), "negative_days"),
        months.groupBy("case_id").agg(F.count("*").alias("months"), F.bool_and("complete").alias("months_complete")),
    ]
    if positions is None:
        parts.append(M.monthly_average(paid, months, "monthly_debt").withColumns({c: F.lit(0).cast("long") for c in ("mca_positions", "unverified")}))
    else:
        parts.append(D.debt_summary(positions).select("case_id", "monthly_debt", "mca_positions", "unverified"))
    out = statements.select("case_id").distinct()
    for part in parts:
        out = out.join(part, "case_id", "left")
    counts = ("lenders", "returned", "fee_rows", "months", "mca_positions", "unverified")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {c: F.round(F.coalesce(c, F.lit(0.0)), 2) for c in ("operating_outflows", "monthly_debt")}
    out = out.withColumns(zero).withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))
    velocity = F.when(F.col("lenders") == 0, "0 in 90 Days").when(F.col("lenders") == 1, "1 in 90 Days").otherwise("2+ in 90 Days")
    burden = F.when(F.col("revenue") != 0, F.col("monthly_debt") / F.nullif(F.col("revenue"), F.lit(0.0)) * 100).otherwise(F.lit(0.0))
    return out.withColumns({"velocity": velocity, "burden": burden})


def account_figures(ledger: DataFrame, statements: DataFrame, schedule: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`underwriting_inputs` of every account by itself, over its own available months. ledger and statements have the
    account as their case_id; schedule: positions of a ledger."""
    ledger, statements = written(ledger), kept_by(statements)
    spans = kept_by(C.covered_spans(statements))
    months = kept_by(C.coverage_summary(spans, C.offer_months(statements, spans)))
    return underwriting_inputs(ledger, statements, months, None if schedule is None else schedule(ledger), covered=spans)


def gate_findings(
    cases: DataFrame, ledger: DataFrame, statements: DataFrame, findings: DataFrame, inputs: DataFrame, flags: DataFrame | None = None
) -> DataFrame:
    """V6: (case_id, gate, detail) for everything that keeps a case from a range; details of one gate stand once each.

    cases: case_id, industry, months_in_business, public_records, bank_verification, extraction_confirmed, pages_reviewed,
    coverage_acknowledged, integrity_reviewed, integrity_note, compared (with the originals), complete, override_signature;
    null is no. findings: case_id, stmt_id, code. flags: case_id, kind ('integrity' or 'page'), detail. statements also have
    status and extraction_method. inputs: as of `underwriting_inputs`. An override counts if it names the signature of
    exactly these data; it clears the DIAGNOSTIC gates.
    """
    text = F.upper(F.coalesce("description", F.lit("")))
    pending = (F.col("tx_type") == "credit") & ~F.coalesce(F.col("revenue_status").isin(rules.TRUE, rules.NON), F.lit(False))
    of_ledger = ledger.groupBy("case_id").agg(
        F.count_if(pending).alias("pending"), F.bool_or(F.regexp_like(text, F.lit(DEFAULT_TEXT))).alias("default_text"),
        F.bool_or(F.contains(F.lower(F.coalesce("category", F.lit(""))), F.lit("wash"))).alias("wash"),
    )
    of_statements = statements.groupBy("case_id").agg(
        F.count_if(~F.coalesce(F.col("status").isin(ALLOWED_STATUSES), F.lit(False))).alias("disallowed"),
        F.bool_or(F.coalesce(F.col("extraction_method").isin(READ_BY_MODEL), F.lit(False))).alias("by_model"),
    )
    of_findings = findings.groupBy("case_id").agg(F.bool_or(F.contains(F.lower("code"), F.lit("manipulation"))).alias("manipulation"))
    if flags is None:
        flags = findings.select("case_id", F.lit("").alias("kind")).where("false")
    of_flags = flags.groupBy("case_id").agg(F.count_if(F.col("kind") == "integrity").alias("integrity"), F.count_if(F.col("kind") == "page").alias("pages"))
    one = cases
    for part in (of_ledger, of_statements, of_findings, of_flags, inputs, data_signature(ledger, statements)):
        one = one.join(part.select("case_id", *[c for c in part.columns if c not in one.columns]), "case_id", "left")
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    missing = F.col("industry").isNull() | F.col("months_in_business").isNull() | F.col("public_records").isNull() | F.col("bank_verification").isNull()
    stops = F.concat_ws(
        ", ", F.when(yes("default_text"), "default, past due or collection text"), F.when(yes("wash"), "wash category"),
        F.when(yes("manipulation") | yes(F.col("bank_verification") == SUSPECT), "suspected manipulation"),
    )
    revenue = F.coalesce("revenue", F.lit(0.0))
    gates = {
        "disallowed_status": (some("disallowed"), F.col("disallowed").cast("string")),
        "extraction_unconfirmed": (yes("by_model") & ~yes("extraction_confirmed"), F.lit("")),
        "pending_deposits": (some("pending"), F.col("pending").cast("string")),
        "no_common_months": (~some("months"), F.lit("")),
        "debt_unverified": (some("unverified"), F.col("unverified").cast("string")),
        "no_daily_balances": (F.col("average_daily_balance").isNull() | F.col("negative_days").isNull(), F.lit("")),
        "fees_without_returns": (some("fee_rows") & ~some("returned"), F.col("fee_rows").cast("string")),
        "revenue_not_finite": (F.isnan(revenue) | (F.abs(revenue) == float("inf")), F.lit("")),
        "inputs_incomplete": (missing, F.lit("")),
        "pages_unreviewed": (some("pages") & ~yes("pages_reviewed"), F.col("pages").cast("string")),
        "coverage_unacknowledged": (some("months") & ~yes("months_complete") & ~yes("coverage_acknowledged"), F.lit("")),
        "integrity_unreviewed": (some("integrity") & (~yes("integrity_reviewed") | blank(F.col("integrity_note"))), F.col("integrity").cast("string")),
        "completeness_unconfirmed": (~yes("complete"), F.lit("")),
        "originals_not_compared": (~yes("compared"), F.lit("")),
        "hard_stop": (stops != "", stops),
        "revenue_below_minimum": (revenue < LEAST_REVENUE, F.format_string("%.2f", revenue)),
    }
    waived = yes(F.col("override_signature") == F.col("signature"))
    shown = [F.when(c & (~waived if g in DIAGNOSTIC else F.lit(True)), F.struct(F.lit(g).alias("gate"), F.coalesce(d, F.lit("")).alias("detail"))) for g, (c, d) in gates.items()]
    one = one.select("case_id", waived.alias("waived"), F.array_compact(F.array(*shown)).alias("gates"))
    issues = findings.join(one.where("not waived").select("case_id"), "case_id").select(
        "case_id", F.lit("statement_issues").alias("gate"), F.concat_ws(": ", "stmt_id", "code").alias("detail")
    )
    return one.select("case_id", F.explode("gates").alias("g")).select("case_id", "g.*").unionByName(issues.dropDuplicates())


def decision_run(cases: DataFrame, inputs: DataFrame, gates: DataFrame) -> DataFrame:
    """One row a case: its gates, and only where there is none the score, grade, position, term, cap and range, with a
    hash of what they rest on.

    The position is one more than the verified active advances. cases: see `gate_findings`, and credit_score,
    repayment_term, repayment_factor and advance_pct_revenue (null: none asked for). A term is moved into the bounds of its
    position. A case of an industry that isn't rated has no score: problem 'no score'.
    """
    c = F.col
    blocked = gates.groupBy("case_id").agg(F.array_sort(F.collect_set("gate")).alias("gates"))
    facts = ["industry", "months_in_business", "public_records", "bank_verification", "credit_score", "repayment_term", "repayment_factor", "advance_pct_revenue"]
    every = cases.select("case_id", *facts).join(inputs, "case_id").join(blocked, "case_id", "left")
    every = written(every.withColumn("gates", F.coalesce("gates", F.array().cast("array<string>"))).withColumn("positions", c("mca_positions")))
    scored = P.scorecard(every.where(F.size("gates") == 0))
    position = (c("mca_positions") + 1).cast("int")
    low, high = P.term_bounds(position)
    money = lambda x: c(x).cast(CENTS)
    multiple = F.floor((money("revenue") * c("advance").cast("decimal(6,4)")).cast("decimal(30,10)"), F.lit(2)).cast(CENTS)
    funded = written(scored.select(
        "case_id", "score", "grade", position.alias("funding_position"), money("revenue").alias("revenue"), money("monthly_debt").alias("monthly_debt"),
        money("operating_outflows").alias("operating_outflows"), F.lit(0).cast(CENTS).alias("reserve"),
        F.coalesce(c("repayment_factor"), F.lit(DEFAULT_FACTOR)).cast("decimal(6,4)").alias("factor"), c("advance").cast("decimal(6,4)").alias("advance"),
        c("max_burden").cast("decimal(6,4)").alias("max_burden"), F.greatest(low, F.least(high, F.coalesce(c("repayment_term"), F.lit(DEFAULT_TERM)))).cast("int").alias("term"),
        F.when(c("advance_pct_revenue").isNotNull(), P.capped_advance(multiple, money("revenue"), c("advance_pct_revenue"))).alias("cap"),
    ))
    limits = P.funding_limits(funded).select("case_id", "amount", "problem", "monthly_payment")
    low_amount, median, high_amount = P.estimate_range(c("amount"))
    shown = funded.join(limits, "case_id").select(
        "case_id", "score", "grade", "funding_position", "term", F.when(c("score").isNull(), "no score").otherwise(c("problem")).alias("problem"),
        low_amount.alias("low"), median.alias("median"), high_amount.alias("high"), "monthly_payment",
    )
    rest_on = [*facts, "revenue", "monthly_debt", "operating_outflows", "lenders", "returned", "mca_positions"]
    snapshot = F.sha2(F.to_json(F.struct(*[F.coalesce(c(x).cast("string"), F.lit("~")).alias(x) for x in rest_on])), 256)
    return every.select("case_id", "gates", (F.size("gates") > 0).alias("blocked"), snapshot.alias("input_snapshot")).join(shown, "case_id", "left")
