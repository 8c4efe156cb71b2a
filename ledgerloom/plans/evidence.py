"""Queries over recorded decisions, extracted pages, exports and document texts."""

from __future__ import annotations

from ledgerloom import rules
from ledgerloom.functions.money import CENTS, setting_ok
from ledgerloom.operators import batches as B
from ledgerloom.operators import classify as K
from ledgerloom.operators import documents as D
from ledgerloom.operators import metrics as M
from ledgerloom.operators import review as R
from ledgerloom.plans.bridge import orders_ledger, orders_statements, table
from ledgerloom.plans.core import query
from ledgerloom.plans.oracle_base import over_orders
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RULE_KEY = ["case_id", "account_id", "description_key"]


def _rules(ledger: DataFrame) -> DataFrame:
    """Remembered payers: 'ACME PROPERTY 123' is revenue in even accounts; a generic payer that must not count."""
    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    acc = ledger.select("case_id", "account_id").distinct()
    acme = acc.where(n % 2 == 0).select("*", F.lit("ACME PROPERTY 123").alias("description_key"), F.lit(rules.TRUE).alias("status"))
    vague = acc.select("*", F.lit("BUSINESS DEPOSIT").alias("description_key"), F.lit(rules.TRUE).alias("status"))
    return acme.unionByName(vague)


@query("k6_k7_j9_payer_rules", over_orders("""
SELECT id, CASE WHEN description = 'ACME PROPERTY 123' AND number % 2 = 0 THEN 'True Revenue' ELSE revenue_status END AS revenue_status,
    CASE WHEN description = 'ACME PROPERTY 123' AND number % 2 = 0 THEN 'verified_payer_rule' WHEN revenue_status = 'Review Required' THEN 'unclassified' ELSE 'rules' END AS source
FROM ledger"""))
def k6_k7_payer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = K.classify(orders_ledger(spark, sf_dir))
    return K.classify_local(ledger, _rules(ledger)).select("id", "revenue_status", F.col("classification_source").alias("source"))


@query("k6_reasons", over_orders(""", r AS (
    SELECT id, tx_type, id % 7 AS m, number, CASE WHEN id % 12 = 0 THEN 'm' ELSE category END AS category, revenue_status, id % 12 = 0 AS merchant FROM ledger
), fees AS (
    SELECT DISTINCT number, m FROM r WHERE merchant AND tx_type = 'debit' AND id_is_fee
)
SELECT id, CASE WHEN merchant THEN CASE WHEN tx_type = 'credit' AND EXISTS (SELECT 1 FROM fees f WHERE f.number = r.number AND f.m = r.m)
        THEN 'Merchant deposit reference matches merchant fee debits in this account.' ELSE '' END
    WHEN tx_type <> 'credit' OR revenue_status = 'Review Required' THEN '' WHEN category = 'Non-Revenue - Interest' THEN 'Bank interest, rather than an operating receipt.'
    WHEN category = 'Non-Revenue - Own-Account / Internal Transfer' THEN 'Explicit account transfer.' WHEN category LIKE '%NSF' AND NOT gst THEN 'Returned payment, refund, or reversal.'
    WHEN category LIKE '%NSF' THEN 'Returned payment, refund, or reversal.' WHEN loan THEN 'Financing or owner funds, rather than an operating receipt.'
    ELSE 'Recognized transaction description: ' || category END AS reason FROM r""".replace("revenue_status, id % 12 = 0 AS merchant", "revenue_status, id % 12 = 0 AS merchant, id % 5 < 3 AS id_is_fee, description LIKE 'GST%' AS gst, description = 'LOAN DISBURSEMENT' AS loan")))  # fmt: skip
def k6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twelfth row names a merchant: deposits 'DPn |', and of the debits three in five fees 'MRCHn |'."""
    k = F.col("id")
    merchant = F.when(F.col("tx_type") == "credit", F.concat(F.lit("DP"), (k % 7).cast("string"), F.lit(" | x"))).when(
        k % 5 < 3, F.concat(F.lit("MRCH"), (k % 7).cast("string"), F.lit(" | x"))
    ).otherwise("RENT")
    rows = orders_ledger(spark, sf_dir).withColumns({
        "account_id": F.concat(F.lit("servus:"), "account_id"), "description": F.when(k % 12 == 0, merchant).otherwise(F.col("description")),
    })
    return K.classify_local(K.classify(rows)).select("id", F.col("classification_reason").alias("reason"))


def _decisions(ledger: DataFrame) -> DataFrame:
    """Every pending deposit with a key divisible by 5 is no revenue; case 4 also decides a debit, which voids its decisions."""
    pending = ledger.where("tx_type = 'credit' and revenue_status = 'Review Required' and id % 5 = 0").select("case_id", "id", F.lit(rules.NON).alias("status"))
    wrong = ledger.where("case_id = 4 and tx_type = 'debit'").agg(F.min("id").alias("id")).select(F.lit(4).cast("long").alias("case_id"), "id", F.lit(rules.NON).alias("status"))
    return pending.unionByName(wrong)


_DECIDED = """, pending AS (
    SELECT * FROM ledger WHERE tx_type = 'credit' AND revenue_status = 'Review Required'
), decided AS (
    SELECT * FROM pending WHERE id % 5 = 0 AND case_id <> 4
), contrary AS (
    SELECT DISTINCT account_id FROM decided WHERE description = 'ACME PROPERTY 123'
)"""


@query("k8_committed_decisions", over_orders(f"""{_DECIDED}
SELECT id, CASE WHEN id IN (SELECT id FROM decided) THEN 'Non-Revenue'
    WHEN description = 'ACME PROPERTY 123' AND number % 2 = 0 AND account_id NOT IN (SELECT account_id FROM contrary) THEN 'True Revenue'
    WHEN description = 'ACME PROPERTY 123' AND account_id IN (SELECT account_id FROM contrary) THEN 'Non-Revenue'
    ELSE revenue_status END AS revenue_status FROM pending"""))  # fmt: skip
def k8_committed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = K.classify(orders_ledger(spark, sf_dir))
    out, _, _ = R.commit_decisions(ledger, _decisions(ledger), _rules(ledger), remember=True)
    return out.join(ledger.where("tx_type = 'credit' and revenue_status = 'Review Required'").select("id"), "id", "left_semi").select("id", "revenue_status")


@query("k8_decision_events", over_orders(f"""{_DECIDED} SELECT id, revenue_status AS previous, 'Non-Revenue' AS decision FROM decided"""))
def k8_decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = K.classify(orders_ledger(spark, sf_dir))
    return R.commit_decisions(ledger, _decisions(ledger), _rules(ledger))[2].select("id", "previous", "decision")


@query("s11_rule_import", over_orders("""
SELECT DISTINCT case_id, account_id, 'ACME PROPERTY 123' AS description_key, CASE WHEN case_id <> 2 THEN 'Non-Revenue' ELSE 'True Revenue' END AS status
FROM ledger WHERE case_id <> 2 OR number % 2 = 0
UNION ALL SELECT DISTINCT case_id, account_id, 'BUSINESS DEPOSIT', 'True Revenue' FROM ledger"""))
def s11_rule_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported rules of all accounts; one bad status in case 2 voids that case's import."""
    ledger = orders_ledger(spark, sf_dir)
    acc = ledger.select("case_id", "account_id").distinct()
    first = acc.where("case_id = 2").agg(F.min("account_id").alias("m"))
    bad = F.when(F.col("account_id") == F.col("m"), "Maybe").otherwise(rules.NON)
    given = acc.join(F.broadcast(first)).select("case_id", "account_id", F.lit("ACME PROPERTY 123").alias("description_key"), bad.alias("status"))
    return R.import_rules(_rules(ledger), given)


@query("k9_business_context", over_orders("""
SELECT id, CASE WHEN description = 'INTERAC e-Transfer Received' AND case_id % 2 = 0 THEN 'True Revenue' ELSE revenue_status END AS revenue_status,
    CASE WHEN description = 'INTERAC e-Transfer Received' AND case_id % 2 = 0 THEN 'True Revenue - Verified Operating Receipts' ELSE category END AS category
FROM ledger WHERE tx_type = 'credit'"""))
def k9_business_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = K.classify(orders_ledger(spark, sf_dir))
    settings = ledger.select("case_id").distinct().withColumn("include_etransfers", F.col("case_id") % 2 == 0)
    return R.apply_context(ledger, settings).where("tx_type = 'credit'").select("id", "revenue_status", "category")


_GROUPS = """, pending AS (
    SELECT *, upper(replace(description, 'ç', 'c')) AS k FROM ledger WHERE tx_type = 'credit' AND revenue_status = 'Review Required'
)"""


@query("k10_suggestion_groups", over_orders(f"""{_GROUPS}
SELECT case_id, account_id, k AS description_key, count(*) AS occurrences,
    (SELECT string_agg(id::VARCHAR, ',' ORDER BY date, id) FROM (SELECT id, date FROM pending q WHERE q.account_id = p.account_id AND q.k = p.k ORDER BY date, id LIMIT 8)) AS examples
FROM pending p GROUP BY case_id, account_id, k"""))
def k10_suggestion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.pending_groups(K.classify(orders_ledger(spark, sf_dir)))
    return out.withColumn("examples", F.array_join(F.transform("examples", lambda x: x["id"].cast("string")), ","))


@query("k10_accepted_suggestions", over_orders(f"""{_GROUPS}
SELECT id, CASE WHEN case_id = 1 OR number % 3 = 0 THEN revenue_status WHEN k = 'ACME PROPERTY 123' THEN 'True Revenue' ELSE revenue_status END AS revenue_status FROM pending"""))
def k10_accepted_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups are suggested as revenue, sure but in accounts divisible by 3; case 1 lacks one suggestion and takes none."""
    ledger = K.classify(orders_ledger(spark, sf_dir))
    groups = R.pending_groups(ledger)
    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    gap = groups.where("case_id = 1").agg(F.min(F.struct("account_id", "description_key")).alias("g"))
    given = groups.join(F.broadcast(gap)).where((F.struct("account_id", "description_key") != F.col("g"))).select(
        *_RULE_KEY, F.lit(rules.TRUE).alias("decision"), F.when(n % 3 == 0, 0.9).otherwise(0.97).alias("confidence"), F.lit("explicit_customer_receipt").alias("evidence")
    )
    out = R.accept_suggestions(ledger, given)
    return out.join(ledger.where("tx_type = 'credit' and revenue_status = 'Review Required'").select("id"), "id", "left_semi").select("id", "revenue_status")


@query("k11_forgotten_rules", over_orders("""
SELECT id, CASE WHEN description = 'ACME PROPERTY 123' AND number % 4 = 2 THEN 'True Revenue' ELSE revenue_status END AS revenue_status FROM ledger WHERE tx_type = 'credit'"""))
def k11_forgotten_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of accounts divisible by 4 are forgotten."""
    ledger = K.classify(orders_ledger(spark, sf_dir))
    known = _rules(ledger)
    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    out, _ = R.forget_rules(K.apply_rules(ledger, known), known, known.where(n % 4 == 0))
    return out.where("tx_type = 'credit'").select("id", "revenue_status")


@query("r2_confirmed_periods", over_orders("""
SELECT stmt_id, CASE WHEN stmt_ord % 4 = 0 THEN date_trunc('month', period_start)::DATE ELSE period_start END AS period_start,
    CASE WHEN stmt_ord % 4 = 0 THEN last_day(period_start) ELSE period_end END AS period_end FROM statements"""))
def r2_confirmed_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole months are confirmed for every fourth statement; every other confirmation lacks a reference, is reversed or cuts rows off."""
    st = orders_statements(spark, sf_dir)
    k = F.col("stmt_ord") % 4
    day = F.date_trunc("month", "period_start").cast("date")
    given = st.select("stmt_id", F.when(k == 2, F.date_add("period_end", 400)).otherwise(day).alias("start"),
                      F.when(k == 3, F.date_sub(day, 1)).otherwise(F.last_day("period_start")).alias("end"), F.when(k == 1, " ").otherwise("page 1").alias("reference"))
    return R.confirm_periods(st, orders_ledger(spark, sf_dir), given)[0].select("stmt_id", "period_start", "period_end")


@query("r3_balance_corrections", over_orders("""
SELECT id, stmt_id, balance AS before, CAST(coalesce(balance, 0) + 1 AS DECIMAL(18,2)) AS after FROM ledger WHERE id % 40 = 0 AND id % 120 <> 0"""))
def r3_balance_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = orders_ledger(spark, sf_dir)
    given = ledger.where("id % 40 = 0").select("id", (F.coalesce("balance", F.lit(0)) + 1).alias("value"), F.when(F.col("id") % 120 == 0, "").otherwise("page 2").alias("reference"))
    return R.correct_balances(ledger, given)[1].select("id", "stmt_id", "before", "after")


@query("r5_a14_cited_positions", over_orders(""", cites AS (
    SELECT *, number * 1000 + stmt_ord % 50 AS citation FROM ledger WHERE tx_type = 'debit' AND lender = 'BDC' OR (case_id = 3 AND id % 97 = 0)
)
SELECT case_id, citation, max(account_id) AS account_id, count(*) AS payments, round(median(amount::DOUBLE), 4) AS payment, max(date) AS last_seen FROM cites
GROUP BY case_id, citation HAVING bool_and(tx_type = 'debit' AND currency = 'CAD' AND id % 50 <> 0) AND count(DISTINCT account_id) = 1"""))
def r5_a14_cited_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = K.classify(orders_ledger(spark, sf_dir))
    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    cites = ledger.where("(tx_type = 'debit' and description = 'BDC LOAN') or (case_id = 3 and id % 97 = 0)").select("case_id", (n * 1000 + F.col("stmt_ord") % 50).alias("citation"), "id")
    used = ledger.where("id % 50 = 0").select("case_id", "id")
    return R.cited_positions(ledger, cites, used).withColumn("payment", F.round("payment", 4))


# ---- Pages, listings and exports ----------------------------------------------------------------------------------------------


@query("s2_first_uploads", """
SELECT doc_id, sha256(text) AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1""")
def s2_first_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return B.first_uploads(docs, F.col("text"), ["lang"], "doc_id").select("doc_id", "sha256")


@query("s4_evidence_contract", over_orders("""
SELECT l.id, CASE WHEN l.id % 2 = 0 THEN CAST(l.date + 1 AS DATE) ELSE l.date END AS date, CASE WHEN l.id % 2 = 0 THEN 'posted_date' ELSE 'statement_date' END AS date_basis,
    strftime(CASE WHEN l.id % 2 = 0 THEN CAST(l.date + 1 AS DATE) ELSE l.date END, '%Y-%m') AS month, l.seq AS source_sequence, s.account_id
FROM ledger l LEFT JOIN statements s ON s.stmt_id = l.stmt_id"""))
def s4_evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_ledger(spark, sf_dir).select("stmt_id", (F.col("seq") * 10).alias("seq"), "id", "date", "month",
                                               F.when(F.col("id") % 2 == 0, F.date_add("date", 1)).alias("posted_date"))
    return B.evidence_contract(rows, orders_statements(spark, sf_dir)).select("id", "date", "date_basis", "month", "source_sequence", "account_id")


@query("s4_readiness", over_orders("""
SELECT stmt_id, CASE WHEN stmt_ord % 5 = 0 OR NOT EXISTS (SELECT 1 FROM ledger l WHERE l.stmt_id = s.stmt_id AND l.id % 3 <> 0) THEN 'Incomplete or inconsistent'
    WHEN stmt_ord % 7 = 0 OR stmt_ord % 4 = 0 THEN 'Usable with warnings' ELSE 'Validated figures' END AS readiness FROM statements s"""))
def s4_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = orders_statements(spark, sf_dir).withColumn("ai_review_required", F.col("stmt_ord") % 4 == 0)
    return B.readiness(st, orders_ledger(spark, sf_dir).where("id % 3 <> 0"), st.where("stmt_ord % 5 = 0"), st.where("stmt_ord % 7 = 0"))


@query("s5_page_rows", over_orders("""
SELECT id, row_number() OVER (PARTITION BY stmt_id ORDER BY (seq - 1) // 4, -seq) AS sequence, -seq AS page_sequence FROM ledger"""))
def s5_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four rows, each page listed backwards."""
    rows = orders_ledger(spark, sf_dir).select("id", F.col("stmt_id").alias("doc_id"), F.floor((F.col("seq") - 1) / 4).alias("page"), (-F.col("seq")).alias("sequence"))
    return B.page_rows(rows).select("id", "sequence", "page_sequence")


@query("f10_verified_positions", over_orders("""
SELECT DISTINCT case_id, account_id, lender, reference, number % 3 <> 0 AND number % 4 <> 1 AS is_verified FROM ledger WHERE tx_type = 'debit' AND lender IS NOT NULL"""))
def f10_verified_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions whose verification was signed; in accounts 4k + 1 the payment changed afterwards."""
    from ledgerloom.operators.debt import debt_payments, is_verified, signature

    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    own = debt_payments(orders_ledger(spark, sf_dir)).select("case_id", "account_id", "lender", "reference").distinct()
    signed = own.withColumns({"kind": F.lit("MCA"), "status": F.lit("Active"), "frequency": F.lit("Weekly"), "payment": F.lit(10).cast(CENTS), "verified": n % 3 != 0})
    later = signed.withColumn("verified_signature", signature()).withColumn("payment", F.when(n % 4 == 1, F.lit(11)).otherwise(F.col("payment")).cast(CENTS))
    return later.select("case_id", "account_id", "lender", "reference", is_verified().alias("is_verified"))


@query("v4_consistency_flags", over_orders(""", s AS (
    SELECT *, opening + CASE WHEN stmt_ord % 4 = 0 THEN 1 ELSE 0 END AS o FROM statements WHERE stmt_ord % 10 <> 0
)
SELECT stmt_id, 'FINANCIAL_INCONSISTENCY' AS code FROM s WHERE stmt_ord % 6 IN (1, 2)
UNION ALL SELECT y.stmt_id, 'BALANCE_CONTINUITY' FROM s x JOIN s y ON x.account_id = y.account_id AND x.stmt_ord = (SELECT max(stmt_ord) FROM s p WHERE p.account_id = y.account_id AND p.stmt_ord < y.stmt_ord)
WHERE x.period_end + 1 = y.period_start AND x.closing <> y.o"""))
def v4_consistency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.operators.ledger import consistency_flags

    o = F.col("stmt_ord")
    st = orders_statements(spark, sf_dir).withColumns({
        "opening": (F.col("opening") + F.when(o % 4 == 0, 1).otherwise(0)).cast(CENTS), "exclude_from_ledger": o % 10 == 0,
    })
    text = F.when(o % 6 == 1, "row 3 date is Outside the statement period").when(o % 6 == 2, "debits total does not match the statement").when(o % 6 == 3, "page 2 is blank")
    return consistency_flags(st, st.select("case_id", "stmt_id", text.alias("text")).where("text is not null")).select("stmt_id", "code")


@query("r5_staged_proposals", over_orders(""", a AS (
    SELECT *, id % 11 = 0 AND tx_type = 'credit' AS revenue, id % 13 = 0 AND lender = 'BDC' AS debt FROM ledger
), acts AS (
    SELECT case_id, id, 'r' AS action, 'revenue' AS kind, revenue_status, 'Non-Revenue' AS after, id % 3 <> 2 OR case_id % 4 <> 1 AS allowed, true AS cad, 1 AS accounts FROM a WHERE revenue
    UNION ALL SELECT case_id, id, 'd' || number, 'debt', NULL, 'BDC', id % 3 <> 2 OR case_id % 4 <> 1, currency = 'CAD', 1 FROM a WHERE debt
), bad AS (
    SELECT DISTINCT case_id FROM acts WHERE NOT allowed OR NOT cad
)
SELECT case_id, CASE kind WHEN 'revenue' THEN 'Revenue' ELSE 'Unverified debt candidate' END AS change, action AS action_id, id, revenue_status AS before, after FROM acts
WHERE case_id NOT IN (SELECT case_id FROM bad)"""))
def r5_staged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits and bank payments by keys; in cases 4k + 1 a third of the rows is outside what may be touched, and payments in
    USD void their case."""
    ledger = K.classify(orders_ledger(spark, sf_dir))
    n = F.element_at(F.split("account_id", ":"), 2)
    none = F.lit(None).cast("string")
    revenue = ledger.where("id % 11 = 0 and tx_type = 'credit'").select(
        "case_id", F.lit("r").alias("action_id"), F.lit("revenue").alias("kind"), "id", F.lit(rules.NON).alias("status"), none.alias("lender"), none.alias("debt_kind"))
    debt = ledger.where("id % 13 = 0 and tx_type = 'debit' and description = 'BDC LOAN'").select(
        "case_id", F.concat(F.lit("d"), n).alias("action_id"), F.lit("debt").alias("kind"), "id", none.alias("status"), F.lit("BDC").alias("lender"), F.lit("Other debt").alias("debt_kind"))
    allowed = ledger.where("id % 3 <> 2 or case_id % 4 <> 1").select("case_id", "id")
    return R.staged_proposals(ledger, revenue.unionByName(debt), allowed, ledger.where("false").select("case_id", "id"))[0]


@query("g2_combined_exports", over_orders(""", p AS (
    SELECT *, CASE WHEN month <= '1998-06' THEN 'a' ELSE 'b' END AS w FROM ledger
)
SELECT account_id, min(date) AS period_start, max(date) AS period_end, count(DISTINCT year(date)) AS parts, number % 5 <> 2 AS reconciled, count(*) AS n,
    CAST(sum(move) AS DECIMAL(18,2)) AS net FROM p GROUP BY account_id, number, w"""))
def g2_combined_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches an account, exported year by year; every part prints the totals of its search, in accounts 5k + 2 a cent off."""
    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    whole = Window.partitionBy("account_id").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    rows = orders_ledger(spark, sf_dir).withColumns({"w": F.when(F.col("month") <= "1998-06", "a").otherwise("b"), "balance": F.sum(move).over(whole).cast(CENTS), "move": move})
    rows = rows.withColumns({"part_id": F.concat_ws("/", "account_id", "w", F.year("date").cast("string")), "seq": F.row_number().over(Window.partitionBy("account_id").orderBy("date", "id"))})
    search = Window.partitionBy("account_id", "w")
    total = lambda side: F.coalesce(F.sum(F.when(F.col("tx_type") == side, F.col("amount"))).over(search), F.lit(0)).cast(CENTS)
    marked = rows.withColumns({"d": (total("debit") + F.when(n % 5 == 2, F.lit("0.01").cast(CENTS)).otherwise(F.lit(0))).cast(CENTS), "c": total("credit")})
    parts = marked.groupBy("account_id", "part_id", "w", "d", "c").agg(
        F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.min_by(F.col("balance") - F.col("move"), "seq").alias("opening"), F.max_by("balance", "seq").alias("closing")
    ).select("account_id", "part_id", F.col("w").alias("search_start"), F.col("w").alias("search_end"), F.col("d").alias("debits"), F.col("c").alias("credits"), "period_start", "period_end", "opening", "closing")
    windows, ordered = B.combine_exports(parts, rows.select("part_id", "seq", "tx_type", "amount", "balance", "move"))
    sums = ordered.groupBy("window_id").agg(F.count("*").alias("n"), F.sum("move").cast(CENTS).alias("net"))
    return windows.join(sums, "window_id").select("account_id", "period_start", "period_end", "parts", "reconciled", "n", "net")


@query("s5_merged_pages", """
SELECT conv_id AS doc_id, (SELECT role FROM conversations d WHERE d.conv_id = c.conv_id AND turn = min(c.turn)) AS holder, count(DISTINCT upper(role)) > 1 AS conflict
FROM conversations c GROUP BY conv_id""")
def s5_merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("role").alias("holder"))
    meta, conflicts = B.merge_pages(pages, {"holder": "holder"})
    return meta.join(conflicts, "doc_id", "left").select("doc_id", "holder", F.col("field").isNotNull().alias("conflict"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with all balances printed; every second one is listed newest first, every sixth with one wrong balance."""
    ledger = orders_ledger(spark, sf_dir)
    st = orders_statements(spark, sf_dir).select("stmt_id", "opening")
    move = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    w = Window.partitionBy("stmt_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger.join(st, "stmt_id").withColumn("balance", (F.col("opening") + F.sum(move).over(w)).cast(CENTS))
    n = F.count("*").over(Window.partitionBy("stmt_id"))
    odd = F.when((F.col("stmt_ord") % 6 == 0) & (F.col("seq") == 1), F.lit(1)).otherwise(F.lit(0))
    return rows.withColumn("_n", n).withColumns({
        "balance": (F.col("balance") + odd).cast(CENTS), "seq": F.when(F.col("stmt_ord") % 2 == 0, F.col("_n") + 1 - F.col("seq")).otherwise(F.col("seq")),
    }).drop("_n", "opening")


@query("s6_d18_proven_order", over_orders(""", n AS (
    SELECT stmt_id, count(*) AS n, count(DISTINCT date) > 1 AS falls FROM ledger GROUP BY 1
)
SELECT l.id, CASE WHEN l.stmt_ord % 2 = 0 AND NOT (falls AND l.stmt_ord % 6 <> 0) THEN n + 1 - l.seq ELSE l.seq END AS source_sequence, l.stmt_ord % 2 = 0 AND falls AND l.stmt_ord % 6 <> 0 AS turned
FROM ledger l JOIN n USING (stmt_id) JOIN statements s USING (stmt_id)"""))
def s6_proven_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.proven_order(_listing(spark, sf_dir), orders_statements(spark, sf_dir)).select("id", "source_sequence", "turned")


@query("d18_derived_openings", over_orders("""
SELECT stmt_id, CAST(CASE WHEN stmt_ord % 6 = 0 THEN opening + 1 ELSE opening END AS DECIMAL(18,2)) AS derived_opening FROM statements WHERE stmt_ord % 2 <> 0 OR stmt_ord % 2 = 0"""))
def d18_derived_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listing(spark, sf_dir)
    forward = B.proven_order(rows, orders_statements(spark, sf_dir))
    oldest = forward.withColumn("seq", F.row_number().over(Window.partitionBy("stmt_id").orderBy("date", "id")))
    return B.derived_openings(oldest)


@query("s7_valid_pages", """
WITH r AS (
    SELECT l_orderkey % 300 AS doc_id, l_linenumber AS page, CASE WHEN l_orderkey % 100 = 0 THEN 'bad' WHEN l_orderkey % 100 = 1 THEN 'both' ELSE 'ok' END AS k FROM lineitem
)
SELECT doc_id, page FROM r GROUP BY ALL HAVING bool_and(k = 'ok')""")
def s7_valid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("l_orderkey") % 100, F.col("l_extendedprice").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 300).alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit("x").alias("description"),
        F.when(k == 0, "n/a").when((k == 1) | (F.col("l_orderkey") % 2 == 0), v).alias("debit"), F.when((k == 1) | (F.col("l_orderkey") % 2 != 0), v).alias("credit"),
    )
    return B.valid_pages(rows)


@query("s8_checkpoint_differences", over_orders(""", k AS (
    SELECT l.*, s.opening FROM ledger l JOIN statements s USING (stmt_id) WHERE l.balance IS NOT NULL
), p AS (
    SELECT k.*, (SELECT max(seq) FROM k q WHERE q.stmt_id = k.stmt_id AND q.seq < k.seq) AS back FROM k
), d AS (
    SELECT stmt_id, seq, balance - coalesce((SELECT q.balance FROM k q WHERE q.stmt_id = p.stmt_id AND q.seq = p.back), opening)
        - (SELECT sum(move) FROM ledger l WHERE l.stmt_id = p.stmt_id AND l.seq > coalesce(p.back, 0) AND l.seq <= p.seq) AS x FROM p
)
SELECT stmt_id, seq, CAST(x AS DECIMAL(18,2)) AS difference FROM d WHERE x <> 0"""))
def s8_checkpoint_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = orders_statements(spark, sf_dir)
    return B.checkpoint_differences(orders_ledger(spark, sf_dir).join(st.select("stmt_id"), "stmt_id", "left_semi"), st)


@query("s9_retry_pages", over_orders(""", p AS (
    SELECT stmt_id, seq, (seq + 2) // 3 AS page, id FROM ledger
), f AS (
    SELECT * FROM p WHERE id % 29 = 0
)
SELECT DISTINCT stmt_id, page FROM f
UNION SELECT f.stmt_id, q.page FROM f JOIN p q ON q.stmt_id = f.stmt_id AND q.seq = f.seq - 1
UNION SELECT stmt_id, page FROM p WHERE stmt_id IN (SELECT stmt_id FROM p WHERE id % 31 = 0) AND stmt_id NOT IN (SELECT stmt_id FROM f)"""))
def s9_retry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_ledger(spark, sf_dir).select("stmt_id", "seq", "id", F.floor((F.col("seq") + 2) / 3).alias("page"))
    local = rows.where("id % 29 = 0").select("stmt_id", "seq", F.lit("balance_mismatch").alias("code"))
    whole = rows.where("id % 31 = 0").select("stmt_id", F.lit(None).cast("int").alias("seq"), F.lit("closing_wrong").alias("code"))
    return B.retry_pages(local.unionByName(whole), rows)


@query("g2_g3_merged_windows", over_orders(""", w AS (
    SELECT l.*, 'a' AS window_id FROM ledger l WHERE month <= '1998-06' UNION ALL SELECT l.*, 'b' FROM ledger l WHERE month >= '1998-03' AND NOT (number % 4 = 1 AND month = '1998-05' AND id % 3 = 0)
), bad AS (
    SELECT DISTINCT account_id FROM ledger WHERE number % 4 = 1 AND month = '1998-05' AND id % 3 = 0
)
SELECT id, window_id, account_id NOT IN (SELECT account_id FROM bad) AS merged, account_id IN (SELECT account_id FROM bad) OR window_id = 'a' OR month > '1998-06' AS kept FROM w"""))
def g3_merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports an account that share four months; in accounts 4k + 1 the second lacks some of them."""
    ledger = orders_ledger(spark, sf_dir)
    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    a = ledger.where("month <= '1998-06'").withColumn("window_id", F.lit("a"))
    b = ledger.where("month >= '1998-03'").where(~((n % 4 == 1) & (F.col("month") == "1998-05") & (F.col("id") % 3 == 0))).withColumn("window_id", F.lit("b"))
    day = lambda x: F.lit(x).cast("date")
    windows = ledger.select("account_id").distinct().select("account_id", F.explode(F.array(
        F.struct(F.lit("a").alias("window_id"), day("1990-01-01").alias("period_start"), day("1998-06-30").alias("period_end")),
        F.struct(F.lit("b").alias("window_id"), day("1998-03-01").alias("period_start"), day("2010-12-31").alias("period_end")),
    )).alias("x")).select("account_id", "x.*")
    rows = a.unionByName(b).select("account_id", "window_id", "seq", "id", "date", "description", "tx_type", "amount", "balance")
    return B.merge_windows(windows, rows).select("id", "window_id", "merged", "kept")


# ---- Document texts -------------------------------------------------------------------------------------------------------------


@query("d9_text_quality", r"""
SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) = 0 THEN 'no_text'
    WHEN contains(text, '(cid:') OR contains(text, chr(65533)) OR length(text) - length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) > 0.01 * length(text) THEN 'garbled'
    ELSE 'text_present' END AS quality, CASE WHEN length(trim(coalesce(text, ''))) >= 40 THEN 'text' ELSE 'image_or_sparse' END AS kind FROM documents""")
def d9_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", D.text_quality(F.col("text")).alias("quality"), D.page_kind(F.col("text")).alias("kind"))


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_LINES = """
WITH lines AS (
    SELECT doc_id, t.line, t.pos - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d,
        LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) t
)"""


@query("d4_stitched_rows", f"""{_LINES}, marked AS (
    SELECT *, length(line) % 3 = 0 AS is_row, sum(CASE WHEN length(line) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM lines
)
SELECT doc_id, max(CASE WHEN is_row THEN pos END) AS pos, md5(string_agg(line, ' ' ORDER BY pos)) AS text_md5 FROM marked WHERE i > 0 GROUP BY doc_id, i""")
def d4_stitched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.stitched(_doc_lines(spark, sf_dir), F.length("line") % 3 == 0, ["doc_id"], "pos")
    return out.select("doc_id", "pos", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("d5_u5_sections", f"""{_LINES}, heads AS (
    SELECT *, (SELECT max(pos) FROM lines h WHERE h.doc_id = l.doc_id AND h.pos <= l.pos AND length(h.line) % 4 = 0) AS at,
        (SELECT max(pos) FROM lines h WHERE h.doc_id = l.doc_id AND h.pos <= l.pos AND length(h.line) % 11 = 1 AND length(h.line) % 4 <> 0) AS shut FROM lines l
)
SELECT h.doc_id, h.pos, CASE WHEN h.at IS NOT NULL AND (h.shut IS NULL OR h.shut < h.at) THEN (SELECT length(line)::VARCHAR FROM lines x WHERE x.doc_id = h.doc_id AND x.pos = h.at) END AS section FROM heads h""")
def d5_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("line")
    out = D.sections(_doc_lines(spark, sf_dir), F.when(n % 4 == 0, n.cast("string")), ["doc_id"], "pos", (n % 11 == 1) & (n % 4 != 0))
    return out.select("doc_id", "pos", "section")


@query("d3_carried_dates", over_orders(""", r AS (
    SELECT *, id % 3 = 0 AS shown, id % 17 = 0 AS broken FROM ledger
), b AS (
    SELECT r.*, coalesce((SELECT max(seq) FROM r q WHERE q.stmt_id = r.stmt_id AND q.seq <= r.seq AND q.broken), 0) AS cut FROM r
)
SELECT id, (SELECT q.date FROM r q WHERE q.stmt_id = b.stmt_id AND q.seq = (SELECT max(seq) FROM r z WHERE z.stmt_id = b.stmt_id AND z.seq <= b.seq AND z.seq >= b.cut AND z.shown)) AS carried FROM b"""))
def d3_carried_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_ledger(spark, sf_dir).withColumn("printed", F.when(F.col("id") % 3 == 0, F.col("date")))
    return D.carried_dates(rows, "printed", F.col("id") % 17 == 0, ["stmt_id"], "seq").select("id", "carried")


@query("f11_leading_dates", over_orders("""
SELECT l.id, CASE WHEN l.date BETWEEN s.period_start AND s.period_end OR l.id % 3 = 2 THEN l.date END AS leading,
    CASE WHEN l.id % 4 = 1 AND (l.date BETWEEN s.period_start AND s.period_end OR l.id % 3 = 2) AND l.date + 1 BETWEEN s.period_start AND s.period_end THEN CAST(l.date + 1 AS DATE) END AS second
FROM ledger l JOIN statements s USING (stmt_id)"""))  # fmt: skip
def f11_leading_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forms of a date; every fourth line has the next day as a second one."""
    k = F.col("id") % 3
    text = F.when(k == 0, F.date_format("date", "MMM d")).when(k == 1, F.date_format("date", "d MMM")).otherwise(F.date_format("date", "yyyy/M/d"))
    rows = orders_ledger(spark, sf_dir).join(orders_statements(spark, sf_dir).select("stmt_id", "period_start", "period_end"), "stmt_id")
    second = F.when(F.col("id") % 4 == 1, F.date_format(F.date_add("date", 1), "dMMM"))
    dates = D.leading_dates(F.concat_ws(" ", F.lit(" "), text, second, F.col("description")), F.col("period_start"), F.col("period_end"))
    return rows.select("id", F.get(dates, F.lit(0)).alias("leading"), F.get(dates, F.lit(1)).alias("second"))


#: A first page of each layout, in the order of the routes; then one that meets none, and one without text.
_FIRST_PAGES = [
    ("neo", "Neo Everyday Account Summary"), ("wise", "Wise Payments\nyour statement"), ("vancity", "Independent Business\nAccount # 7 VANCITY"),
    ("rbc_french", "RBCBanqueRoyale.com Sommaire de votre compte"), ("atb", "atb.com Deposit Account Statement"),
    ("activity_screen", "Scotiabank Current Account Transactions"), ("rbc", "Royal Bank of Canada\nAccount Summary for this Period"),
    ("scotia", "The Bank of Nova Scotia Business Account 12345 67890 12 Account Summary for this Period"), ("td", "CHEQUE/DEBIT Statement of Account"),
    ("td", "Account Activity Withdrawals Deposits"), ("flinks", "see dashboard.flinks.com"), ("servus", "SERVUS.CA Business Plan 150 #1"),
    ("cibc", "CIBC Account Statement Account Number 1 Transaction Details"), ("bmo_business", "bmo.com Business Banking statement"),
    ("bmo_business_french", "BMO.com Période terminée le 31 mai"), ("national_french", "MM JJ Période du 01-02-2024"), ("unsupported", "Wise Payments"),
    ("image_only", " "),
]
_PAGE_ROWS = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(_FIRST_PAGES))


@query("d7_layout_routes", f"""
WITH p(i, layout) AS (VALUES {_PAGE_ROWS})
SELECT doc_id, layout FROM documents JOIN p ON p.i = doc_id % {len(_FIRST_PAGES)}""")
def d7_layout_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document follows the first page of a layout; those without text of their own stay as short as that."""
    page = F.element_at(F.array(*[F.lit(t) for _, t in _FIRST_PAGES]), (F.col("doc_id") % len(_FIRST_PAGES) + 1).cast("int"))
    body = F.when(F.trim(page) != "", F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)statement", "")).otherwise("")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return docs.select("doc_id", D.routed(F.concat_ws("\n", page, body)).alias("layout"))


def _stamped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages of a document, stamped with a bank and a printed page number by their keys."""
    k = F.col("conv_id")
    bank = F.element_at(F.array(*[F.lit(x) for x in ("CIBC statement", "ATB", "CIBC and ATB", "no bank")]), (k % 4 + 1).cast("int"))
    stamp = F.concat_ws("\n", bank, F.concat(F.lit("Page "), (F.col("turn") + 1).cast("string"), F.lit(" of "), (k % 9 + 1).cast("string")))
    return table(spark, sf_dir, "conversations").where("conv_id is not null").select(
        k.alias("doc_id"), (F.col("turn") + 1).alias("page"), F.when((k % 5 == 0) & (F.col("turn") > 0), "").otherwise(stamp).alias("text")
    )


@query("d8_identified_documents", """
WITH p AS (
    SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE NOT (conv_id % 5 = 0 AND turn > 0)) AS readable FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
)
SELECT conv_id AS doc_id, CASE conv_id % 4 WHEN 0 THEN 'CIBC' WHEN 1 THEN 'ATB' END AS institution, CASE WHEN readable = n THEN 'text' WHEN readable = 0 THEN 'image-only' ELSE 'mixed' END AS format,
    n AS pages, readable > 0 AND conv_id % 9 + 1 > n AS pages_missing FROM p""")
def d8_identified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.identified(_stamped_pages(spark, sf_dir))


@query("d6_captured_fields", """
SELECT conv_id AS doc_id, turn + 1 AS page, CASE WHEN NOT (conv_id % 5 = 0 AND turn > 0) THEN (turn + 1)::VARCHAR END AS printed_page,
    CASE WHEN NOT (conv_id % 5 = 0 AND turn > 0) THEN (conv_id % 9 + 1)::VARCHAR END AS printed_total FROM conversations WHERE conv_id IS NOT NULL""")
def d6_captured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.captured(_stamped_pages(spark, sf_dir), {"printed_page": r"Page (\d+) of", "printed_total": r"of (\d+)"}).drop("text")


@query("d10_a15_header_names", """
SELECT s_suppkey AS doc_id, 'ACMELTD' || s_suppkey % 7 || 'INC' AS key, 'Acme Ltd. ' || s_suppkey % 7 || ' Inc.' AS name FROM supplier
UNION ALL SELECT s_suppkey, '123456' || s_suppkey || 'CANADAINC', '123456' || s_suppkey || ' CANADA INC.' FROM supplier
UNION ALL SELECT s_suppkey, 'JOESCAFE' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Joe''s Café ' || s_suppkey ELSE 'JOES CAFE ' || s_suppkey END FROM supplier""")
def d10_header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header for each supplier: a company twice, a numbered company, a payee below the table's title, and below that a
    labelled name, which every other header spells in its own way."""
    k = F.col("s_suppkey").cast("string")
    own = F.concat(F.lit("Acme Ltd. "), (F.col("s_suppkey") % 7).cast("string"))
    pretty = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Joe's Café "), k, F.lit("  For questions call us")))
    text = F.concat_ws("\n", F.lit("Statement"), pretty, F.concat(own, F.lit("   Inc.")), F.upper(F.concat(own, F.lit(" inc."))),
                       F.concat(F.lit("123 456 "), k, F.lit(" Canada inc")), F.lit("Transaction details"), F.lit("Payee Corp."),
                       F.lit("Operating as :"), F.concat(F.lit(" JOES CAFE "), k))
    return D.header_names(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))


@query("d13_a13_verified_dates", over_orders(""", r AS (
    SELECT *, balance IS NOT NULL AND id % 4 <> 0 AND (id % 7 <> 0 OR id % 3 = 0) AS settled FROM ledger
)
SELECT stmt_id, count(*) FILTER (WHERE settled AND id % 5 <> 0) AS verified, count(*) FILTER (WHERE settled AND id % 5 = 0) AS mismatches,
    count(*) FILTER (WHERE NOT settled) AS unverified FROM r GROUP BY stmt_id"""))
def d13_verified_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is printed once on its page, four units off the place of every fourth row, a day late for every fifth; every
    seventh line has two dates, of which rows with a posted date (every third) count the second."""
    rows = orders_ledger(spark, sf_dir).withColumns({
        "page": F.floor(F.col("seq") / 40), "top": F.col("seq") * 12.0, "posted_date": F.when(F.col("id") % 3 == 0, F.col("date")),
    })
    day = F.when(F.col("id") % 5 == 0, F.date_add("date", 1)).otherwise(F.col("date"))
    printed = rows.where("balance is not null").select(
        "stmt_id", "page", (F.col("top") + F.when(F.col("id") % 4 == 0, 4.0).otherwise(1.0)).alias("top"), "amount", "balance",
        F.when(F.col("id") % 7 == 0, F.array(F.date_sub(day, 2), day)).otherwise(F.array(day)).alias("dates"),
    )
    out = D.verified_dates(rows, printed)
    count = lambda x: F.count_if(F.col("date_check") == x)
    return out.groupBy("stmt_id").agg(count("verified").alias("verified"), count("mismatch").alias("mismatches"), count("unverified").alias("unverified"))


@query("d14_d15_f14_reports", """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 AND 250 + c_custkey % 700 BETWEEN 300 AND 900 THEN 250 + c_custkey % 700 END AS score,
    CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS balance, c_custkey % 30 BETWEEN 1 AND 24 AS term_ok FROM customer""")
def d14_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    score = (250 + k % 700).cast("string")
    other = F.when(k % 3 == 1, F.lit("FICO Score 8: 600 fico score 8 601")).otherwise("no score")
    text = F.concat_ws("\n", F.when(k % 3 == 0, F.concat(F.lit("FICO Score 8 - "), score, F.lit(" FICO SCORE 8: "), score)).otherwise(other),
                       F.concat(F.lit("Loan #"), k.cast("string"), F.lit(" balance $"), F.format_number(F.abs("c_acctbal"), 2)))
    docs = table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"), (k % 30).cast("string").alias("term"))
    loans = D.disclosed_loans(docs).select("doc_id", "balance")
    return docs.join(loans, "doc_id").select("doc_id", D.credit_score(F.col("text")).alias("score"), "balance", setting_ok("repayment_term", F.col("term")).alias("term_ok"))


@query("a15_first_names", """
SELECT s_nationkey % 5 AS case_id, upper(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS key, min_by(s_name, s_suppkey) AS name FROM supplier GROUP BY 1, 2""")
def a15_first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("case_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    return M.first_names(names.unionByName(names.withColumns({"ord": F.col("ord") + 100000, "name": F.upper("name")})))


@query("u1_u2_u3_sets", over_orders(""", a AS (
    SELECT number AS n, date, amount FROM ledger
), b AS (
    SELECT number // 20 * 20 + (number % 20 + 15) % 20 AS n, date, amount FROM ledger
), shared AS (
    SELECT n, count(*) AS k FROM (SELECT n, date FROM a INTERSECT SELECT n, date FROM b) GROUP BY 1
), every AS (
    SELECT n, count(*) AS k FROM (SELECT n, date FROM a UNION SELECT n, date FROM b) GROUP BY 1
), one AS (
    SELECT n, count(*) AS k FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1
), two AS (
    SELECT n, count(*) AS k FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY 1
)
SELECT every.n AS number, coalesce(shared.k, 0) AS shared_days, every.k AS all_days, coalesce(one.k, 0) AS only_first, coalesce(two.k, 0) AS only_second,
    coalesce(one.k, 0) + coalesce(two.k, 0) = 0 AS equal
FROM every LEFT JOIN shared ON shared.n = every.n LEFT JOIN one ON one.n = every.n LEFT JOIN two ON two.n = every.n"""))
def u_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account against the next one of its case, as if that were its second upload."""
    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    rows = orders_ledger(spark, sf_dir).select(n.alias("number"), "date", "amount")
    before = F.col("number") - F.col("number") % 20 + (F.col("number") % 20 + 15) % 20
    return B.compare_uploads(rows, rows.withColumn("number", before), ["number"])


@query("s8_extracted_findings", over_orders(""", r AS (
    SELECT l.stmt_id, l.seq, l.tx_type, l.balance, CASE WHEN id % 61 = 0 THEN 0 ELSE amount END AS amount, CASE WHEN id % 61 = 0 THEN 0 ELSE move END AS move,
        CASE WHEN id % 67 = 0 THEN NULL ELSE l.date END AS date, id % 71 = 0 AS blank,
        CASE WHEN id % 73 = 0 THEN greatest(l.seq - 1, 0) ELSE l.seq END AS shown, s.opening, s.period_start, s.period_end FROM ledger l JOIN statements s USING (stmt_id)
), t AS (
    SELECT *, row_number() OVER (PARTITION BY stmt_id, shown ORDER BY seq) AS nth, lag(date) OVER (PARTITION BY stmt_id ORDER BY seq) AS before FROM r
), g AS (
    SELECT * FROM t WHERE amount > 0
), steps AS (
    SELECT g.*, (SELECT max(seq) FROM g q WHERE q.stmt_id = g.stmt_id AND q.seq < g.seq AND q.balance IS NOT NULL) AS back FROM g WHERE balance IS NOT NULL
), st AS (
    SELECT s.*, CASE WHEN stmt_ord % 5 = 0 THEN debits + 1 WHEN stmt_ord % 5 < 3 THEN debits END AS d, CASE WHEN stmt_ord % 6 = 0 THEN 0 WHEN stmt_ord % 6 = 1 THEN 1 END AS dc,
        CASE WHEN stmt_ord % 8 <> 0 THEN 0 WHEN stmt_ord % 16 = 0 THEN 1 ELSE 2 END AS cur,
        (SELECT coalesce(sum(amount) FILTER (WHERE tx_type = 'debit'), 0) FROM g WHERE g.stmt_id = s.stmt_id) AS sd, (SELECT coalesce(sum(amount) FILTER (WHERE tx_type = 'credit'), 0) FROM g WHERE g.stmt_id = s.stmt_id) AS sc,
        (SELECT count(*) FILTER (WHERE tx_type = 'debit') FROM g WHERE g.stmt_id = s.stmt_id) AS nd, (SELECT count(*) FROM g WHERE g.stmt_id = s.stmt_id) AS n,
        (SELECT max(seq) FROM steps x WHERE x.stmt_id = s.stmt_id) AS at FROM statements s
), closed AS (
    SELECT st.*, coalesce((SELECT balance FROM g WHERE g.stmt_id = st.stmt_id AND g.seq = st.at), opening)
        + coalesce((SELECT sum(move) FROM g WHERE g.stmt_id = st.stmt_id AND g.seq > coalesce(st.at, 0)), 0) AS reached FROM st
)
SELECT stmt_id, shown AS seq, 'sequence_invalid' AS code FROM t WHERE shown < 1 OR nth > 1 UNION ALL SELECT stmt_id, shown, 'date_missing' FROM t WHERE date IS NULL
UNION ALL SELECT stmt_id, shown, 'date_outside_period' FROM t WHERE date NOT BETWEEN period_start AND period_end UNION ALL SELECT stmt_id, shown, 'dates_out_of_order' FROM t WHERE date < before
UNION ALL SELECT stmt_id, shown, 'description_missing' FROM t WHERE blank UNION ALL SELECT stmt_id, shown, 'not_one_positive_side' FROM t WHERE amount = 0
UNION ALL SELECT stmt_id, shown, 'checkpoint_difference' FROM steps x WHERE balance - coalesce((SELECT q.balance FROM g q WHERE q.stmt_id = x.stmt_id AND q.seq = x.back), opening)
    <> (SELECT sum(move) FROM g q WHERE q.stmt_id = x.stmt_id AND q.seq > coalesce(x.back, 0) AND q.seq <= x.seq)
UNION ALL SELECT stmt_id, NULL, unnest(list_filter([CASE WHEN cur = 2 THEN 'currency_missing' END, CASE WHEN cur = 1 THEN 'currency_unsupported' END, CASE WHEN n = 0 THEN 'no_rows' END,
    CASE WHEN n > 0 AND d <> sd THEN 'debits_differ' END, CASE WHEN n > 0 AND credits <> sc THEN 'credits_differ' END, CASE WHEN n > 0 AND dc <> nd THEN 'debits_count_differs' END,
    CASE WHEN reached <> closing THEN 'closing_not_reached' END, CASE WHEN n > 0 AND opening + sc - sd <> closing THEN 'equation_fails' END], lambda x: x IS NOT NULL)) FROM closed"""))  # fmt: skip
def s8_extracted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted rows with repeated numbers, missing dates, texts and amounts, under statements whose printed figures are off."""
    k, o = F.col("id"), F.col("stmt_ord")
    st = orders_statements(spark, sf_dir).withColumns({
        "debits": F.when(o % 5 == 0, F.col("debits") + 1).when(o % 5 < 3, F.col("debits")).cast(CENTS),
        "debits_count": F.when(o % 6 == 0, 0).when(o % 6 == 1, 1), "credits_count": F.lit(None).cast("int"),
        "currency": F.when(o % 8 != 0, F.col("currency")).when(o % 16 == 0, F.lit("EUR")),
    })
    rows = orders_ledger(spark, sf_dir).join(st.select("stmt_id"), "stmt_id", "left_semi").withColumns({
        "place": F.col("seq"), "seq": F.when(k % 73 == 0, F.greatest(F.col("seq") - 1, F.lit(0))).otherwise(F.col("seq")),
        "amount": F.when(k % 61 == 0, F.lit(0)).otherwise(F.col("amount")).cast(CENTS), "date": F.when(k % 67 != 0, F.col("date")),
        "description": F.when(k % 71 == 0, F.lit(" ")).otherwise(F.col("description")),
    })
    return B.extracted_findings(rows, st)


# ---- Words, cells and bytes ---------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as words on a page: two a line of text, two units of height apart."""
    k = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") % 3 + 1).alias("page"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_quantity") * 4.0 + k / 100.0).alias("x0"),
        (F.col("l_quantity") * 4.0 + k / 100.0 + 10.0).alias("x1"), (k * 2.0).alias("top"), k.alias("k"),
    )


@query("d1_lines_of_words", """
WITH RECURSIVE w AS (
    SELECT l_orderkey AS doc_id, l_orderkey % 3 + 1 AS page, l_returnflag || l_linestatus AS text, l_quantity * 4.0 + l_linenumber / 100.0 AS x0, l_linenumber * 2.0 AS top FROM lineitem
), anchors AS (
    SELECT doc_id, min(top) AS top, 1 AS line FROM w GROUP BY 1
    UNION ALL SELECT a.doc_id, (SELECT min(top) FROM w WHERE w.doc_id = a.doc_id AND w.top > a.top + 3), a.line + 1 FROM anchors a
    WHERE EXISTS (SELECT 1 FROM w WHERE w.doc_id = a.doc_id AND w.top > a.top + 3)
)
SELECT w.doc_id, w.page, a.line, min(w.top)::DOUBLE AS top, string_agg(text, ' ' ORDER BY x0, text) AS text FROM w JOIN anchors a ON a.doc_id = w.doc_id
    AND a.top = (SELECT max(b.top) FROM anchors b WHERE b.doc_id = w.doc_id AND b.top <= w.top) GROUP BY ALL""")
def d1_lines_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lines_of_words(_words(spark, sf_dir))


@query("d2_line_cells", """
SELECT l_orderkey AS doc_id, l_orderkey % 3 + 1 AS page, l_linenumber // 3 AS line, CASE WHEN x < 60 THEN 'date' WHEN x < 120 THEN 'description' ELSE 'debit' END AS role,
    string_agg(l_returnflag || l_linestatus, ' ' ORDER BY x, l_returnflag || l_linestatus) AS text FROM (SELECT *, l_quantity * 4.0 + l_linenumber / 100.0 AS x FROM lineitem) WHERE x < 120 OR (x + 10 >= 150 AND x + 10 < 190)
GROUP BY ALL""")
def d2_line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns by the left edge and one by the right edge; what stands in none of them is left out."""
    layout = spark.createDataFrame([("l", "date", 0.0, 60.0, "x0"), ("l", "description", 60.0, 120.0, "x0"), ("l", "debit", 150.0, 190.0, "x1")],
                                   "layout string, role string, lo double, hi double, edge string")
    return D.cells(_words(spark, sf_dir).withColumns({"layout": F.lit("l"), "line": F.floor(F.col("k") / 3)}), layout)


@query("d12_glyph_cells", """
WITH g AS (
    SELECT l_orderkey AS doc_id, l_linenumber AS line, printf('%d.%02d', (l_quantity * 13)::INT % 900, l_orderkey % 100) AS cell FROM lineitem
), three AS (
    SELECT DISTINCT doc_id, line // 2 AS line, cell FROM g
)
SELECT doc_id, 1 AS page, line, min(cell) AS cell FROM three GROUP BY doc_id, line HAVING count(*) = 1""")
def d12_glyph_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts printed glyph by glyph, two order lines near one line of text: one amount is taken, two are not. Words beside
    them are no amounts."""
    cell = F.format_string("%d.%02d", (F.col("l_quantity") * 13).cast("int") % 900, F.col("l_orderkey") % 100)
    printed = F.array(F.struct(cell.alias("text"), F.lit(8.0).alias("size")), F.struct(F.concat("l_returnflag", "l_linestatus").alias("text"), F.lit(6.0).alias("size")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(printed).alias("p"))
    glyphs = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode(F.split("p.text", "")).alias("i", "text"), "p.size")
    chars = glyphs.where("text <> ''").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.floor(F.col("l_linenumber") / 2).alias("line"), ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000 + F.col("i") * 0.001).alias("top"),
        (F.col("i") * 5.0).alias("x0"), "size", "text",
    )
    return D.glyph_cells(chars)


@query("d11_integrity_flags", """
SELECT doc_id, code FROM (SELECT doc_id, unnest([CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'PDF_REVISIONS' END, CASE WHEN doc_id % 4 = 1 THEN 'EDITING_SOFTWARE' END,
    CASE WHEN trim(coalesce(text, '')) = '' THEN 'NO_TEXT_LAYER' END, CASE WHEN doc_id % 7 = 0 THEN 'ANNOTATIONS' END, CASE WHEN doc_id % 11 = 0 THEN 'UNREADABLE' END,
    CASE WHEN doc_id % 5 = 0 THEN 'OVERLAPPING_DIGITS' END]) AS code FROM documents WHERE doc_id IS NOT NULL) WHERE code IS NOT NULL""")
def d11_integrity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(
        "doc_id", "text", F.concat_ws("\n", F.lit("%%EOF"), F.when(k % 3 == 0, F.lit("/Prev 17\n%%EOF"))).alias("raw_"), F.when(k % 4 == 1, "Adobe Photoshop 9").otherwise("bank").alias("producer"),
        F.when(k % 7 == 0, F.array(F.lit("Link"), F.lit("FreeText"))).otherwise(F.array(F.lit("Link"))).alias("annotations"), (k % 11 != 0).alias("readable"),
    )
    docs = docs.withColumn("raw", F.when(k % 2 == 0, F.col("raw_")).otherwise("%%EOF")).drop("raw_")
    at = docs.where(k % 5 == 0).select("doc_id", F.explode(F.array(F.lit("4"), F.lit("9"))).alias("text"))
    chars = at.select("doc_id", F.lit(1).alias("page"), "text", F.lit(1.0).alias("x0"), F.lit(2.0).alias("top"), F.lit(3.0).alias("x1"))
    return D.integrity_flags(docs, chars)


@query("s3_expanded_documents", over_orders("""
SELECT case_id, account_id, n, false AS blocker FROM (SELECT case_id, account_id, count(*) AS n FROM statements GROUP BY ALL) WHERE case_id % 3 <> 2
UNION ALL SELECT DISTINCT case_id, NULL, NULL, true FROM statements WHERE case_id % 3 <> 0"""))
def s3_expanded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a case with its accounts: every third has issues as well, every third has no accounts at all."""
    own = orders_statements(spark, sf_dir).groupBy("case_id", "account_id").agg(F.count("*").alias("n"))
    docs = own.groupBy("case_id").agg(F.collect_list(F.struct("account_id", "n")).alias("found")).select(
        "case_id", F.col("case_id").alias("doc_id"), F.when(F.col("case_id") % 3 != 2, F.col("found")).alias("account_statements"),
        F.when(F.col("case_id") % 3 == 1, F.array(F.lit("page 2 missing"))).alias("issues"),
    )
    return B.expand_documents(docs).select("case_id", "account_id", "n", "blocker")
