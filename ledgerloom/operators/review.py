"""Recorded decisions over a ledger: reviews of deposits, remembered payers, suggestions, corrections. Each is a table that
meets the ledger in a join; a case with an invalid decision keeps its rows as they are."""

from __future__ import annotations

from ledgerloom import rules
from ledgerloom.functions.money import CENTS
from ledgerloom.functions.text import is_generic, normalized
from ledgerloom.operators.classify import apply_rules, exclusion_category, exclusion_reason, set_decision
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = 0.95
EVIDENCE = ["processor_settlement", "explicit_customer_receipt"]
CONTEXT_EVIDENCE = "contextual_customer_receipt"
EXAMPLES = 8


def valid_decisions(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (case_id, id, status) of the cases all of whose decisions are valid: each id stands once in the ledger
    and once among the decisions, for a credit, with a known status."""
    rows = ledger.groupBy("case_id", "id").agg(F.count("*").alias("_k"), F.max(F.col("tx_type") == "credit").alias("_credit"))
    times = F.count("*").over(Window.partitionBy("case_id", "id"))
    met = decisions.select("case_id", "id", "status", times.alias("_n")).join(rows, ["case_id", "id"], "left")
    good = (F.col("_n") == 1) & (F.col("_k") == 1) & F.col("_credit") & F.col("status").isin(rules.TRUE, rules.NON, rules.REVIEW)
    bad = met.where(~F.coalesce(good, F.lit(False))).select("case_id").distinct()
    return met.join(bad, "case_id", "left_anti").select("case_id", "id", "status")


def commit_decisions(ledger: DataFrame, decisions: DataFrame, payer_rules: DataFrame, remember: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K8: (ledger, payer_rules, events) after the decisions of all valid cases. A contrary decision drops the remembered
    rule of its payer; with `remember`, named and non-excluded payers are remembered; rules are applied again."""
    good = valid_decisions(ledger, decisions).withColumnRenamed("status", "_status")
    out = ledger.join(good, ["case_id", "id"], "left")
    own = F.coalesce(F.col("internal_transfer"), F.lit(False))
    decided = F.when(own, rules.NON).otherwise(F.col("_status"))
    made = out.where("_status is not null").select(
        "case_id", "id", "account_id", "description", F.col("revenue_status").alias("previous"), decided.alias("decision")
    )
    changed = set_decision(out, F.col("_status").isNotNull(), F.col("_status"), F.lit("underwriter"), F.lit("Underwriter decision."))
    keyed = made.select("case_id", "account_id", normalized(F.col("description")).alias("description_key"), "decision", "description")
    contrary = keyed.join(payer_rules, ["case_id", "account_id", "description_key"]).where("decision <> status").select(
        "case_id", "account_id", "description_key"
    ).distinct()
    kept = payer_rules.join(contrary, ["case_id", "account_id", "description_key"], "left_anti")
    if remember:
        new = keyed.where(
            F.col("decision").isin(rules.TRUE, rules.NON) & ~is_generic(F.col("description")) & exclusion_category(F.col("description")).isNull()
        ).groupBy("case_id", "account_id", "description_key").agg(F.max("decision").alias("status"))
        kept = kept.join(new, ["case_id", "account_id", "description_key"], "left_anti").unionByName(new)
    events = made.select("case_id", "id", "previous", "decision")
    return apply_rules(changed.select(*ledger.columns), kept), kept, events


def import_rules(payer_rules: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported rules over those of their case, all of a case's or none: every key whole and unique, every status
    true or non-revenue."""
    key = ["case_id", "account_id", "description_key"]
    n = F.count("*").over(Window.partitionBy(*key))
    good = F.coalesce(F.col("status").isin(rules.TRUE, rules.NON) & (F.col("account_id") != "") & (F.col("description_key") != ""), F.lit(False))
    checked = imported.withColumn("_ok", good & (n == 1))
    bad = checked.where("not _ok").select("case_id").distinct()
    use = checked.join(bad, "case_id", "left_anti").select(*key, "status")
    return payer_rules.join(use, key, "left_anti").select(*key, "status").unionByName(use)


def apply_context(ledger: DataFrame, settings: DataFrame) -> DataFrame:
    """K9: pending e-transfers become revenue in cases that say so; a withdrawn instruction takes back its own rows.
    settings: case_id, include_etransfers."""
    out = ledger.join(settings.select("case_id", F.col("include_etransfers").alias("_yes")), "case_id", "left")
    yes = F.coalesce("_yes", F.lit(False))
    credit = F.col("tx_type") == "credit"
    taken = credit & (F.col("classification_source") == "underwriter_context") & ~yes
    out = set_decision(out, taken, F.lit(rules.REVIEW), F.lit("unclassified"), F.lit("E-transfer instruction removed; review again."))
    pending = credit & (F.col("revenue_status") == rules.REVIEW)
    gone = exclusion_category(F.col("description"))
    out = out.withColumn("_gone", pending & gone.isNotNull())
    out = set_decision(out, F.col("_gone"), F.lit(rules.NON), F.lit("rules"), exclusion_reason(F.col("description")), gone)
    text = normalized(F.col("description"))
    named = F.regexp_like(text, F.lit(rules.ETRANSFER)) & ~F.regexp_like(text, F.lit(rules.OUTGOING))
    when = credit & (F.col("revenue_status") == rules.REVIEW) & yes & named & ~F.coalesce("internal_transfer", F.lit(False))
    out = set_decision(out, when, F.lit(rules.TRUE), F.lit("underwriter_context"), F.lit("Case instruction: incoming e-transfers are receipts."),
                       F.lit(rules.TRUE_CATEGORY))
    return out.select(*ledger.columns)


def pending_groups(ledger: DataFrame) -> DataFrame:
    """Pending credits by account and description: number and up to eight examples, the earliest."""
    rows = ledger.where((F.col("tx_type") == "credit") & (F.col("revenue_status") == rules.REVIEW))
    keyed = rows.withColumn("description_key", normalized(F.col("description")))
    key = ["case_id", "account_id", "description_key"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("date", "id"))
    examples = keyed.withColumn("_r", first).where(F.col("_r") <= EXAMPLES).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("date", "id", "amount"))).alias("examples")
    )
    return keyed.groupBy(*key).agg(F.count("*").alias("occurrences")).join(examples, key)


def accept_suggestions(ledger: DataFrame, suggestions: DataFrame, context: bool = False) -> DataFrame:
    """Supplied suggestions (case_id, account_id, description_key, decision, confidence, evidence) decide pending groups
    only if sure, named and of allowed evidence. A case whose suggestions don't meet its groups one to one takes none."""
    key = ["case_id", "account_id", "description_key"]
    groups = pending_groups(ledger).select(*key).withColumn("_g", F.lit(1))
    given = suggestions.groupBy(*key).agg(F.count("*").alias("_s"), *[F.first(c).alias(f"_{c}") for c in ("decision", "confidence", "evidence")])
    met = groups.join(given, key, "full")
    bad = met.where("_g is null or _s is null or _s <> 1").select("case_id").distinct()
    use = met.join(bad, "case_id", "left_anti").select(*key, "_decision", "_confidence", "_evidence")
    out = ledger.withColumn("description_key", normalized(F.col("description"))).join(use, key, "left")
    allowed = EVIDENCE + [CONTEXT_EVIDENCE] * context
    sure = (F.col("_confidence") >= CONFIDENCE) & ~is_generic(F.col("description"))
    yes = (F.col("_decision") == rules.TRUE) & F.col("_evidence").isin(allowed) & exclusion_category(F.col("description")).isNull()
    no = (F.col("_decision") == rules.NON) & (F.col("_evidence") == "non_revenue")
    when = (F.col("tx_type") == "credit") & (F.col("revenue_status") == rules.REVIEW) & sure & (yes | no)
    out = out.withColumn("_use", when)
    return set_decision(out, F.col("_use"), F.col("_decision"), F.lit("suggestion"), F.lit("Supplied suggestion, accepted by policy.")).select(*ledger.columns)


def forget_rules(ledger: DataFrame, payer_rules: DataFrame, forgotten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, payer_rules) without the rules of `forgotten` (case_id, account_id, description_key): rows that a rule
    decided go back to review, those that a human decided stay."""
    key = ["case_id", "account_id", "description_key"]
    gone = forgotten.select(*key).distinct().withColumn("_gone", F.lit(True))
    out = ledger.withColumn("description_key", normalized(F.col("description"))).join(gone, key, "left")
    when = F.coalesce("_gone", F.lit(False)) & (F.col("classification_source") == "verified_payer_rule")
    out = set_decision(out, when, F.lit(rules.REVIEW), F.lit("unclassified"), F.lit("Remembered rule removed."))
    return out.select(*ledger.columns), payer_rules.join(gone.select(*key), key, "left_anti")


# ---- Corrections of statements ----------------------------------------------------------------------------------------------


def confirm_periods(statements: DataFrame, rows: DataFrame, confirmations: DataFrame, most_days: int = 3660) -> tuple[DataFrame, DataFrame]:
    """R2: (statements, rejects). confirmations: stmt_id, start, end, reference. A confirmed period is in order, no longer
    than ten years, has a reference and holds every date of the statement."""
    span = rows.where("date is not null").groupBy("stmt_id").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    met = confirmations.join(span, "stmt_id", "left")
    problem = (
        F.when(~F.coalesce((F.col("start") <= F.col("end")) & (F.datediff("end", "start") <= most_days), F.lit(False)), "invalid period")
        .when(F.coalesce(F.trim("reference"), F.lit("")) == "", "no reference")
        .when((F.col("_first") < F.col("start")) | (F.col("_last") > F.col("end")), "dates outside")
    )
    judged = met.withColumn("problem", problem)
    good = judged.where("problem is null").select("stmt_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    out = statements.join(good, "stmt_id", "left").withColumns(
        {"period_start": F.coalesce("_s", "period_start"), "period_end": F.coalesce("_e", "period_end")}
    )
    return out.select(*statements.columns), judged.where("problem is not null").select("stmt_id", "problem")


def correct_balances(rows: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with original_balance, audit). corrections: id, value, reference; one takes effect only if its id stands once
    among the rows and once among the corrections, and it has a reference. The extracted value is kept."""
    unique = rows.groupBy("id").agg(F.count("*").alias("_k"))
    times = F.count("*").over(Window.partitionBy("id"))
    good = corrections.withColumn("_n", times).join(unique, "id").where("_n = 1 and _k = 1 and trim(reference) <> ''").select(
        "id", F.col("value").cast(CENTS).alias("_value"), "reference"
    )
    out = rows.join(good, "id", "left")
    audit = out.where("_value is not null").select("id", "stmt_id", F.col("balance").alias("before"), F.col("_value").alias("after"), "reference")
    fixed = out.withColumn("original_balance", F.col("balance")).withColumn("balance", F.coalesce("_value", "balance"))
    return fixed.select(*rows.columns, "original_balance"), audit


def cited_positions(ledger: DataFrame, citations: DataFrame, used: DataFrame) -> DataFrame:
    """One unverified position for each citation (case_id, citation, id) whose rows are all debits of one account
    in CAD, unused, no own transfers and cited once: their number, median payment and last day."""
    times = F.count("*").over(Window.partitionBy("case_id", "id"))
    met = citations.withColumn("_n", times).join(ledger, ["case_id", "id"], "left").join(
        used.select("case_id", "id").distinct().withColumn("_used", F.lit(True)), ["case_id", "id"], "left"
    )
    good = (F.col("tx_type") == "debit") & (F.col("currency") == "CAD") & F.col("_used").isNull() & (F.col("_n") == 1) & ~F.coalesce(
        "internal_transfer", F.lit(False)
    )
    return met.groupBy("case_id", "citation").agg(
        F.bool_and(F.coalesce(good, F.lit(False))).alias("_ok"), F.count_distinct("account_id").alias("_a"), F.max("account_id").alias("account_id"),
        F.count("*").alias("payments"), F.median(F.col("amount").cast("double")).alias("payment"), F.max("date").alias("last_seen"),
    ).where("_ok and _a = 1").drop("_ok", "_a")


def staged_proposals(ledger: DataFrame, actions: DataFrame, allowed: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(preview, rejects) of proposals, all of a case's or none: preview has one row (case_id, change, action_id, id, before,
    after) for each row that an action touches, rejects one (case_id, reason) for each thing wrong with a case.

    actions: case_id, action_id, kind ('revenue' or 'debt'), id, status (revenue), lender and debt_kind (debt); allowed: case_id,
    id that the proposal may touch; used: case_id, id that already support a position.
    """
    key = ["case_id", "id"]
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    own = Window.partitionBy(*key, "kind")
    met = actions.withColumn("_times", F.count("*").over(own)).join(ledger.withColumn("_n", F.count("*").over(Window.partitionBy(*key))), key, "left")
    met = met.join(flag(allowed, "_allowed"), key, "left").join(flag(used, "_used"), key, "left")
    deal = Window.partitionBy("case_id", "action_id")
    met = met.withColumn("_accounts", F.size(F.collect_set("account_id").over(deal)))
    c, revenue, debt = F.col, F.col("kind") == "revenue", F.col("kind") == "debt"
    internal = F.coalesce("internal_transfer", F.lit(False))
    reasons = {
        "unknown kind of action": ~F.coalesce(revenue | debt, F.lit(False)),
        "row outside the reviewed context": c("_allowed").isNull() | c("_n").isNull(),
        "duplicate transaction ids": c("_n") > 1,
        "conflicting or repeated action": c("_times") > 1,
        "invalid status": revenue & ~F.coalesce(c("status").isin(rules.TRUE, rules.NON, rules.REVIEW), F.lit(False)),
        "only deposits are revenue": revenue & (c("tx_type") != "credit"),
        "own transfers stay non-revenue": revenue & internal & (c("status") != rules.NON),
        "payment supports a position already": debt & c("_used").isNotNull(),
        "debt rests on debits": debt & (c("tx_type") != "debit"),
        "currency needs a rate": debt & (c("currency") != "CAD"),
        "one account for each position": debt & (c("_accounts") != 1),
        "own transfers pay no debt": debt & internal,
        "debt needs a lender and a kind": debt & ((F.trim(F.coalesce("lender", F.lit(""))) == "") | ~F.coalesce(c("debt_kind").isin("MCA", "Other debt"), F.lit(False))),
    }
    wrong = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in reasons.items()]))
    judged = met.withColumn("_wrong", wrong)
    rejects = judged.select("case_id", F.explode("_wrong").alias("reason")).distinct()
    good = judged.join(rejects.select("case_id").distinct(), "case_id", "left_anti")
    return good.select(
        "case_id", F.when(revenue, "Revenue").otherwise("Unverified debt candidate").alias("change"), "action_id", "id",
        F.when(revenue, c("revenue_status")).alias("before"), F.when(revenue, c("status")).otherwise(c("lender")).alias("after"),
    ), rejects
