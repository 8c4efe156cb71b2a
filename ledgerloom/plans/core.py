"""Queries over the bridge ledger: classification, summaries, validation, coverage."""

from __future__ import annotations

from ledgerloom.functions import money, text
from ledgerloom.lineage import written
from ledgerloom.operators import classify as K
from ledgerloom.operators import coverage as C
from ledgerloom.operators import ledger as L
from ledgerloom.operators import metrics as M
from ledgerloom.plans.bridge import events_ledger, orders_ledger, orders_statements, table
from ledgerloom.plans.oracle_base import over_events, over_orders
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify_local(K.classify(orders_ledger(spark, sf_dir)))


def ratio(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


@query("a1_bank_summary", over_orders("""
SELECT case_id, currency, account_id, month, CAST(coalesce(sum(amount) FILTER (WHERE tx_type = 'credit'), 0) AS DECIMAL(18,2)) AS gross_credits,
    CAST(coalesce(sum(amount) FILTER (WHERE tx_type = 'debit'), 0) AS DECIMAL(18,2)) AS debits,
    CAST(coalesce(sum(amount) FILTER (WHERE revenue_status = 'True Revenue'), 0) AS DECIMAL(18,2)) AS reviewed_revenue
FROM ledger GROUP BY ALL"""))  # fmt: skip
def a1_bank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bank_summary(classified(spark, sf_dir))


@query("k1_k2_k5_classification", over_orders("""
SELECT id, category, revenue_status, revenue_status <> 'Review Required' AS reviewed FROM ledger"""))
def k_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify(orders_ledger(spark, sf_dir)).select("id", "category", "revenue_status", "reviewed")


@query("k3_k4_creditors", over_orders("""
SELECT id, tier, lender, reference FROM ledger WHERE tx_type = 'debit' AND lender IS NOT NULL"""))
def k3_k4_creditors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.operators.debt import debt_payments

    return debt_payments(orders_ledger(spark, sf_dir)).select("id", "tier", "lender", "reference")


@query("p1_contains_filters", over_orders("""
SELECT id, description FROM ledger WHERE description ILIKE '%interac%' AND currency ILIKE '%cad%'"""))
def p1_contains_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"description": " INTERAC", "currency": "cad", "nowhere": "x", "month": " "}
    return K.contains_filters(orders_ledger(spark, sf_dir), filters).select("id", "description")


@query("p2_reviewed_revenue", over_orders("""
SELECT id, amount FROM ledger WHERE revenue_status = 'True Revenue'"""))
def p2_reviewed_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).where(K.is_revenue()).select("id", "amount")


@query("a2_currency_totals", over_orders(""", sums AS (
    SELECT case_id, currency, sum(amount) AS s FROM ledger GROUP BY ALL)
SELECT case_id, string_agg(currency || ' ' || format('{:,.2f}', s::DOUBLE), ' | ' ORDER BY currency) AS totals FROM sums GROUP BY case_id"""))
def a2_currency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.currency_totals(orders_ledger(spark, sf_dir))


@query("a3_lender_payments", over_orders("""
SELECT case_id, lender, tier, account_id, count(*) AS observed_payments, CAST(sum(amount) AS DECIMAL(18,2)) AS observed_total, max(date) AS last_seen
FROM ledger WHERE tx_type = 'debit' AND lender IN ('GREENBOX', 'BIZFUND', 'BDC') GROUP BY ALL"""))
def a3_lender_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lender_payments(orders_ledger(spark, sf_dir))


_FLAGS = """, flagged AS (
    SELECT *, description = 'RETURNED ITEM CREDIT' AS unspecified,
        description IN ('Cheque returned NSF', 'RETURNED ITEM CREDIT') AS returned, description = 'NSF item fee 3 @ $45.00' AS fee, description = 'NSF PAID FEE' AS paid
    FROM ledger)"""
_RETURNS = """count(*) FILTER (WHERE returned) AS returned_items, count(DISTINCT date) FILTER (WHERE returned) AS affected_dates,
    CAST(coalesce(sum(amount) FILTER (WHERE returned), 0) AS DECIMAL(18,2)) AS returned_amount,
    CAST(coalesce(sum(amount) FILTER (WHERE fee), 0) AS DECIMAL(18,2)) AS fee_amount,
    CAST(coalesce(sum(amount) FILTER (WHERE paid), 0) AS DECIMAL(18,2)) AS paid_item_fee_amount,
    count(*) FILTER (WHERE fee) AS fee_rows, count(*) FILTER (WHERE paid) AS paid_item_fee_rows,
    3 * count(*) FILTER (WHERE fee) AS fee_disclosed_items, count(*) FILTER (WHERE unspecified) AS unspecified_return_items"""


@query("a5_returned_payments", over_orders(f"""{_FLAGS}, charges AS (
    SELECT s.case_id, sum(s.amount) AS c FROM ledger s WHERE s.description = 'TRANSACTION SERVICE CHARGE' AND EXISTS (
        SELECT 1 FROM flagged f WHERE f.unspecified AND f.account_id = s.account_id AND f.date = s.date) GROUP BY 1)
SELECT f.case_id, {_RETURNS}, CAST(coalesce(max(c), 0) AS DECIMAL(18,2)) AS associated_service_charges
FROM flagged f LEFT JOIN charges USING (case_id) GROUP BY f.case_id"""))  # fmt: skip
def a5_returned_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.returned_payments(orders_ledger(spark, sf_dir))


@query("a5_returned_payments_by_month", over_orders(f"""{_FLAGS}
SELECT case_id, month, {_RETURNS} FROM flagged WHERE returned OR fee OR paid GROUP BY ALL"""))
def a5_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.returned_payments_by_month(orders_ledger(spark, sf_dir))


# ---- Functions ----------------------------------------------------------------------------------------------------------

_FORMS = ["plain", "($ grouped)", "trailing minus", "DR", "comma decimal", "CR", "CR and minus", "bad groups", "three decimals",
          "unicode minus", "OD", "brackets and minus"]


@query("f1_f2_f4_money", """
WITH base AS (
    SELECT o_orderkey AS id, o_orderkey % 12 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v, format('{:,.2f}', o_totalprice) AS g,
        format('{:.2f}', o_totalprice) AS p FROM orders
), cells AS (
    SELECT id, v, k, CASE k WHEN 0 THEN p WHEN 1 THEN '($' || g || ')' WHEN 2 THEN g || '-' WHEN 3 THEN g || ' DR'
        WHEN 4 THEN replace(replace(replace(g, ',', ';'), '.', ','), ';', '.') WHEN 5 THEN '$' || p || 'CR' WHEN 6 THEN '-' || p || ' CR'
        WHEN 7 THEN '1,23.45' WHEN 8 THEN p || '5' WHEN 9 THEN chr(8722) || p WHEN 10 THEN p || 'OD' ELSE '(-' || p || ')' END AS cell FROM base
)
SELECT id, cell, CAST(CASE WHEN k IN (0, 4, 5) THEN v WHEN k IN (1, 2, 3, 9, 10) THEN -v END AS DECIMAL(18,2)) AS parsed,
    CAST(CASE WHEN k = 0 THEN v END AS DECIMAL(18,2)) AS exact,
    CAST(CASE WHEN k = 0 THEN v WHEN k = 8 THEN CASE WHEN (v * 100)::BIGINT % 2 = 0 THEN v ELSE v + 0.01 END END AS DECIMAL(18,2)) AS extracted
FROM cells""")  # fmt: skip
def f_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_totalprice").cast(money.CENTS)
    p, g = v.cast("string"), F.format_number("o_totalprice", 2)
    european = F.translate(g, ",.", ".,")
    forms = [p, F.concat(F.lit("($"), g, F.lit(")")), F.concat(g, F.lit("-")), F.concat(g, F.lit(" DR")), european,
             F.concat(F.lit("$"), p, F.lit("CR")), F.concat(F.lit("-"), p, F.lit(" CR")), F.lit("1,23.45"), F.concat(p, F.lit("5")),
             F.concat(F.lit("−"), p), F.concat(p, F.lit("OD")), F.concat(F.lit("(-"), p, F.lit(")"))]
    cells = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.element_at(F.array(*forms), (F.col("o_orderkey") % len(_FORMS) + 1).cast("int")).alias("cell")
    )
    c = F.col("cell")
    return cells.select("id", "cell", money.parse_money(c).alias("parsed"), money.decimal_value(c).alias("exact"),
                        money.extracted_decimal(c).alias("extracted"))


@query("f3_f16_days", """
WITH t AS (
    SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders
), cells AS (
    SELECT id, d, k, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y/%m/%d') WHEN 2 THEN year(d) || '-' || month(d) || '-' || day(d)
        WHEN 3 THEN strftime(d, '%Y-%m') || '-32' ELSE strftime(d, '%Y.%m.%d') END AS cell FROM t
)
SELECT id, cell, CASE WHEN k = 0 OR (k = 2 AND month(d) > 9 AND day(d) > 9) THEN d END AS strict, CASE WHEN k <> 3 THEN d END AS lenient,
    strftime(d, '%Y-%m') AS month, day(last_day(d)) AS calendar_days FROM cells""")  # fmt: skip
def f_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy/MM/dd"), F.concat_ws("-", F.year(d), F.month(d), F.dayofmonth(d)),
             F.concat(F.date_format(d, "yyyy-MM"), F.lit("-32")), F.date_format(d, "yyyy.MM.dd")]
    cell = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), d.alias("d"), cell.alias("cell")).select(
        "id", "cell", money.strict_day(F.col("cell")).alias("strict"), money.lenient_day(F.col("cell")).alias("lenient"),
        money.month_of(F.col("d")).alias("month"), money.days_in_month(F.col("d")).alias("calendar_days"),
    )


_UNACCENT = f"replace(translate(text, '{text.MARKED}', '{text.PLAIN}'), 'ß', 'ss')"


@query("f5_text_keys", f"""
SELECT doc_id, md5(trim(regexp_replace(upper({_UNACCENT}), '[^A-Z0-9]+', ' ', 'g'))) AS key_md5,
    md5(regexp_replace(upper({_UNACCENT}), '[^A-Z0-9]', '', 'g')) AS compact_md5 FROM documents WHERE lang IN ('fr', 'de', 'es')""")  # fmt: skip
def f5_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "de", "es"))
    return docs.select("doc_id", F.md5(text.description_key(F.col("text")).cast("binary")).alias("key_md5"),
                       F.md5(text.compact(F.col("text")).cast("binary")).alias("compact_md5"))


@query("f7_f8_f12_f13_f15_names", over_orders("""
SELECT id, description IN ('INTERAC e-Transfer Received', 'BUSINESS DEPOSIT', 'Virement Interac reçu') AS generic,
    'ai:' || (1000000 + number) AS account, description AS printed_once, description NOT LIKE '4%' AS searchable,
    'Bill Payment ' || description AS repaired FROM ledger"""))
def f_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_ledger(spark, sf_dir)
    number = F.element_at(F.split("account_id", ":"), 2).cast("long")
    doubled = F.concat(F.array_join(F.transform(F.split("description", ""), lambda x: F.concat(x, x)), ""), F.lit(""))
    return rows.select(
        "id", text.is_generic(F.col("description")).alias("generic"),
        text.account_key(F.concat(F.lit("ai: 6615-"), (number + 1000000).cast("string"))).alias("account"),
        text.single_glyphs(doubled).alias("printed_once"), text.searchable_company(F.col("description")).alias("searchable"),
        text.unglued(F.concat(F.lit("BillPayment"), F.col("description"))).alias("repaired"),
    )


# ---- Assembly and validation ----------------------------------------------------------------------------------------------


@query("g1_multiset_dedupe", over_orders(""", uploads AS (
    SELECT *, 0 AS again FROM ledger UNION ALL SELECT *, 1 FROM ledger WHERE id % 3 = 0
), keyed AS (
    SELECT id, again, case_id, account_id, currency, date, tx_type, amount, upper(description) AS t, stmt_id, stmt_ord + again * 100000 AS o, seq FROM uploads
), counted AS (
    SELECT *, row_number() OVER (PARTITION BY case_id, account_id, currency, date, tx_type, amount, t, o ORDER BY seq) AS k FROM keyed
), per AS (
    SELECT case_id, account_id, currency, date, tx_type, amount, t, o, count(*) AS n FROM keyed GROUP BY ALL
)
SELECT c.id, c.again, c.k > coalesce((SELECT max(n) FROM per p WHERE p.case_id = c.case_id AND p.account_id = c.account_id AND p.currency = c.currency
    AND p.date = c.date AND p.tx_type = c.tx_type AND p.amount = c.amount AND p.t = c.t AND p.o < c.o), 0) AS kept FROM counted c"""))  # fmt: skip
def g1_multiset_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_ledger(spark, sf_dir).withColumn("again", F.lit(0))
    again = rows.where("id % 3 = 0").withColumns(
        {"again": F.lit(1), "stmt_ord": F.col("stmt_ord") + 100000, "stmt_id": F.concat("stmt_id", F.lit("/2"))}
    )
    return L.drop_repeated_activity(rows.unionByName(again)).select("id", "again", "kept")


_RUNNING = """, anchors AS (
    SELECT l.*, s.opening, s.closing, s.debits, s.credits, s.period_start, s.period_end FROM ledger l JOIN statements s USING (stmt_id)
), running AS (
    SELECT a.*, (SELECT max(p.seq) FROM ledger p WHERE p.stmt_id = a.stmt_id AND p.seq < a.seq AND p.balance IS NOT NULL) AS back FROM anchors a
), summed AS (
    SELECT r.*, CAST(CASE WHEN back IS NULL THEN r.opening ELSE (SELECT p.balance FROM ledger p WHERE p.stmt_id = r.stmt_id AND p.seq = r.back) END
        + (SELECT sum(p.move) FROM ledger p WHERE p.stmt_id = r.stmt_id AND p.seq > coalesce(r.back, 0) AND p.seq <= r.seq) AS DECIMAL(18,2)) AS run
    FROM running r
)"""


@query("v1_row_findings", over_orders(f"""{_RUNNING}
SELECT stmt_id, seq, 'balance_mismatch' AS code FROM summed WHERE balance <> run
UNION ALL SELECT stmt_id, seq, 'date_outside_period' FROM summed WHERE date < period_start OR date > period_end"""))
def v1_row_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.validate_rows(orders_ledger(spark, sf_dir), orders_statements(spark, sf_dir)).select("stmt_id", "seq", "code")


@query("v1_statement_checks", over_orders(f"""{_RUNNING}, last AS (
    SELECT stmt_id, coalesce(balance, run) AS final FROM summed s WHERE seq = (SELECT max(seq) FROM ledger l WHERE l.stmt_id = s.stmt_id)
), numbers AS (
    SELECT stmt_id, count(*) FILTER (WHERE tx_type = 'debit') AS nd, count(*) FILTER (WHERE tx_type = 'credit') AS nc FROM ledger GROUP BY 1
), printed AS (
    SELECT stmt_id, CASE WHEN stmt_ord % 4 = 0 THEN debits + 1 ELSE debits END AS d, CASE WHEN stmt_ord % 3 <> 0 THEN nd + (stmt_ord % 6 = 1)::INT END AS dn, stmt_ord % 9 = 4 AS reversed
    FROM statements JOIN numbers USING (stmt_id)
)
SELECT s.stmt_id, count(*) AS n_rows, max(debits) AS sum_debits, max(credits) AS sum_credits, count(*) FILTER (WHERE balance <> run) AS balance_errors,
    max(d) <> max(debits) AS debits_wrong, false AS credits_wrong, false AS equation_wrong, max(final) <> max(closing) AS closing_wrong, bool_or(reversed) AS period_invalid,
    coalesce(max(dn) <> max(nd), false) AS debits_count_wrong, false AS credits_count_wrong
FROM summed s JOIN last USING (stmt_id) JOIN numbers USING (stmt_id) JOIN printed USING (stmt_id) GROUP BY s.stmt_id"""))  # fmt: skip
def v1_statement_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.validate_statements(orders_ledger(spark, sf_dir), _printed_statements(spark, sf_dir)).drop("case_id")


def _printed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with printed numbers of rows, some of them and some totals off by one, some periods turned round (V5)."""
    ledger, o = orders_ledger(spark, sf_dir), F.col("stmt_ord")
    numbers = ledger.groupBy("stmt_id").agg(F.count_if(F.col("tx_type") == "debit").alias("nd"), F.count_if(F.col("tx_type") == "credit").alias("credits_count"))
    st = orders_statements(spark, sf_dir).join(numbers, "stmt_id")
    turned = o % 9 == 4
    return st.withColumns({
        "debits_count": F.when(o % 3 != 0, F.col("nd") + (o % 6 == 1).cast("int")), "debits": F.when(o % 4 == 0, F.col("debits") + 1).otherwise(F.col("debits")).cast(money.CENTS),
        "period_start": F.when(turned, F.date_add("period_end", 1)).otherwise(F.col("period_start")),
    })


@query("v1_statement_status", over_orders(f"""{_RUNNING}, bad AS (
    SELECT stmt_id FROM summed WHERE balance <> run OR date < period_start OR date > period_end UNION SELECT stmt_id FROM statements WHERE stmt_ord % 4 = 0 OR stmt_ord % 9 = 4 OR stmt_ord % 6 = 1
)
SELECT s.stmt_id, CASE WHEN s.stmt_id IN (SELECT stmt_id FROM bad) OR coalesce(l.balance, l.run) <> s.closing THEN 'review_required' ELSE 'reconciled' END AS status
FROM statements s JOIN summed l ON l.stmt_id = s.stmt_id AND l.seq = (SELECT max(seq) FROM ledger x WHERE x.stmt_id = s.stmt_id)"""))  # fmt: skip
def v1_statement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = written(_printed_statements(spark, sf_dir).withColumn("status", F.lit("reconciled")))
    rows = orders_ledger(spark, sf_dir).join(st.select("stmt_id"), "stmt_id", "left_semi")
    return L.statement_status(st, L.validate_rows(rows, st), L.validate_statements(rows, st)).select("stmt_id", "status")


@query("p4_ledger_exclusion", over_orders(""", own AS (
    SELECT * FROM statements WHERE stmt_ord % 10 <> 0
), d2 AS (
    SELECT DISTINCT case_id, account_id, unnest(generate_series(period_start, period_end, INTERVAL 1 DAY))::DATE AS day FROM own
), c2 AS (
    SELECT case_id, day FROM d2 GROUP BY case_id, day HAVING count(*) = (SELECT count(DISTINCT account_id) FROM own o WHERE o.case_id = d2.case_id)
)
SELECT case_id, 'covered days' AS what, count(*) AS n FROM c2 GROUP BY case_id
UNION ALL SELECT case_id, 'gaps', count(*) FROM (SELECT case_id, period_start, max(period_end) OVER (PARTITION BY account_id ORDER BY stmt_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM own)
    WHERE period_start > e + 1 GROUP BY case_id
UNION ALL SELECT l.case_id, 'rows', count(*) FROM ledger l WHERE l.stmt_ord % 10 <> 0 GROUP BY l.case_id"""))  # fmt: skip
def p4_ledger_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of every tenth month are excluded: from the covered days, the gaps and the assembled ledger."""
    mark = lambda df: df.withColumn("exclude_from_ledger", F.when(F.col("stmt_ord") % 10 == 0, F.lit(True)))
    st, rows = mark(orders_statements(spark, sf_dir)), mark(orders_ledger(spark, sf_dir))
    count = lambda df, what: df.groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit(what).alias("what"), "n")
    parts = [count(C.covered_days(st), "covered days"), count(C.coverage_gaps(st), "gaps"), count(L.drop_repeated_activity(rows).where("kept"), "rows")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _shifted(statements: DataFrame) -> DataFrame:
    """Every third statement reaches five days into the next month, every fifth begins a day early."""
    return statements.withColumns({
        "period_end": F.when(F.col("stmt_ord") % 3 == 0, F.date_add("period_end", 5)).otherwise(F.col("period_end")),
        "period_start": F.when(F.col("stmt_ord") % 5 == 0, F.date_sub("period_start", 1)).otherwise(F.col("period_start")),
    })


@query("v3_overlapping_periods", over_orders(""", s AS (
    SELECT case_id, account_id, stmt_id, stmt_ord, CASE WHEN stmt_ord % 5 = 0 THEN period_start - 1 ELSE period_start END AS a,
        CASE WHEN stmt_ord % 3 = 0 THEN period_end + 5 ELSE period_end END AS b FROM statements
)
SELECT x.case_id, x.account_id, x.stmt_id, y.stmt_id AS other_id FROM s x JOIN s y ON x.account_id = y.account_id AND x.stmt_ord < y.stmt_ord
WHERE greatest(x.a, y.a) <= least(x.b, y.b) AND NOT (x.a <> y.a AND (x.b = y.a OR y.b = x.a))"""))
def v3_overlapping_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.overlapping_periods(_shifted(orders_statements(spark, sf_dir)))


@query("v4_balance_continuity", over_orders(""", s AS (
    SELECT *, opening + CASE WHEN stmt_ord % 4 = 0 THEN 1 ELSE 0 END AS o FROM statements
)
SELECT y.case_id, y.account_id, y.stmt_id, CAST(y.o AS DECIMAL(18,2)) AS opening, x.stmt_id AS previous_id, x.closing AS previous_closing
FROM s x JOIN s y ON x.account_id = y.account_id AND x.stmt_ord = (SELECT max(stmt_ord) FROM s p WHERE p.account_id = y.account_id AND p.stmt_ord < y.stmt_ord)
WHERE x.period_end + 1 = y.period_start AND x.closing <> y.o"""))
def v4_balance_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.when(F.col("stmt_ord") % 4 == 0, F.lit(1)).otherwise(F.lit(0))
    return L.balance_continuity(orders_statements(spark, sf_dir).withColumn("opening", (F.col("opening") + off).cast(money.CENTS)))


# ---- Coverage -------------------------------------------------------------------------------------------------------------


@query("c1_coverage_gaps", over_orders("""
SELECT case_id, account_id, CAST(prev + 1 AS DATE) AS missing_from, CAST(period_start - 1 AS DATE) AS missing_through FROM (
    SELECT *, (SELECT max(p.period_end) FROM statements p WHERE p.account_id = s.account_id AND p.stmt_ord < s.stmt_ord) AS prev FROM statements s)
WHERE period_start > prev + 1"""))
def c1_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage_gaps(orders_statements(spark, sf_dir))


@query("c2_c3_coverage_summary", over_orders("""
SELECT case_id, month, covered_days, calendar_days, round(covered_days / calendar_days, 6) AS coverage_fraction,
    covered_days = calendar_days AS complete FROM coverage"""))
def c2_c3_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.coverage_summary(C.covered_spans(orders_statements(spark, sf_dir)))
    return out.withColumn("coverage_fraction", ratio(F.col("coverage_fraction")))


_FULL = """, full_months AS (SELECT case_id, month FROM coverage WHERE covered_days = calendar_days)"""


@query("c4_full_months", over_orders(f"""{_FULL} SELECT * FROM full_months"""))
def c4_full_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.full_months(orders_statements(spark, sf_dir))


_OFFER = f"""{_FULL}, base AS (
    SELECT case_id, month FROM full_months WHERE case_id IN (SELECT case_id FROM full_months GROUP BY 1 HAVING count(*) >= 3)
    UNION ALL SELECT case_id, month FROM coverage WHERE case_id NOT IN (SELECT case_id FROM full_months GROUP BY 1 HAVING count(*) >= 3)
), numbered AS (
    SELECT *, substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT AS i FROM base
), chain AS (
    SELECT case_id, i, month FROM numbered n WHERE i = (SELECT max(i) FROM numbered m WHERE m.case_id = n.case_id)
    UNION ALL SELECT n.case_id, n.i, n.month FROM numbered n JOIN chain c ON c.case_id = n.case_id AND n.i = c.i - 1
), offer AS (
    SELECT b.case_id, b.month FROM base b WHERE (SELECT count(*) FROM chain c WHERE c.case_id = b.case_id) < 3
        OR EXISTS (SELECT 1 FROM chain c WHERE c.case_id = b.case_id AND c.month = b.month)
)"""


@query("c5_offer_months", over_orders(f"""{_OFFER} SELECT * FROM offer""", recursive=True))
def c5_offer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.offer_months(orders_statements(spark, sf_dir))


@query("c7_partial_months_left_out", over_orders(f"""{_OFFER}
SELECT case_id, month, covered_days, covered_days = calendar_days AS complete FROM coverage c
WHERE NOT EXISTS (SELECT 1 FROM offer o WHERE o.case_id = c.case_id AND o.month = c.month)""", recursive=True))
def c7_partial_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.partial_months_left_out(orders_statements(spark, sf_dir))


@query("p3_covered_rows", over_orders(f"""{_OFFER}
SELECT l.id FROM ledger l JOIN covered d ON d.case_id = l.case_id AND d.day = l.date JOIN offer o ON o.case_id = l.case_id AND o.month = l.month""", recursive=True))
def p3_covered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = orders_statements(spark, sf_dir)
    return C.covered_rows(orders_ledger(spark, sf_dir), C.covered_spans(statements), C.offer_months(statements)).select("id")


def events_statements(ledger: DataFrame) -> DataFrame:
    """One statement an account, of the whole time that the ledger of its case spans; openings are 100 by account number."""
    span = ledger.groupBy("case_id").agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"))
    own = ledger.select("case_id", "account_id", "currency").distinct().join(span, "case_id")
    return own.select("*", F.concat(F.lit("e:"), F.col("account_id")).alias("stmt_id"), F.lit(1).alias("stmt_ord"),
                      (F.col("account_id").cast("long") % 100).cast(money.CENTS).alias("opening"), F.lit(1).cast("decimal(18,6)").alias("rate"))


@query("c6_daily_balances", over_events(""", span AS (
    SELECT case_id, min(date) AS a, max(date) AS b FROM daily GROUP BY 1
), spine AS (
    SELECT DISTINCT d.case_id, account_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM daily d JOIN span s ON s.case_id = d.case_id
), ordered AS (
    SELECT *, account_id::BIGINT % 100 + sum(move) OVER (PARTITION BY account_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS after FROM daily
), ends AS (
    SELECT p.case_id, p.account_id, p.day, account_id::BIGINT % 100 + coalesce((SELECT sum(move) FROM daily d WHERE d.account_id = p.account_id AND d.date <= p.day), 0) AS v,
        account_id::BIGINT % 100 + coalesce((SELECT sum(move) FROM daily d WHERE d.account_id = p.account_id AND d.date < p.day), 0) AS before,
        (SELECT min(after) FROM ordered o WHERE o.account_id = p.account_id AND o.date = p.day) AS lowest FROM spine p
), totals AS (
    SELECT case_id, day, sum(v) AS total, bool_or(v < 0) AS neg, bool_or(before < 0 OR coalesce(lowest < 0, false)) AS below FROM ends GROUP BY 1, 2
), bad AS (
    SELECT DISTINCT case_id FROM daily WHERE amount IS NULL OR amount <= 0
)
SELECT case_id, round(avg(total)::DOUBLE, 4) AS average_daily_balance, count(*) FILTER (WHERE neg) AS negative_days,
    count(*) FILTER (WHERE below) AS intraday_negative_days, count(*) AS covered_days FROM totals WHERE case_id NOT IN (SELECT case_id FROM bad) GROUP BY 1"""))  # fmt: skip
def c6_daily_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = events_ledger(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("account_id").orderBy("ts", "id")))
    statements = events_statements(ledger)
    out = C.daily_balances(statements, ledger.withColumn("statement_period_start", F.lit(None).cast("date")))
    return out.withColumn("average_daily_balance", F.round("average_daily_balance", 4))


@query("a8_account_coverage", over_orders(""", own AS (
    SELECT case_id, account_id, strftime(day, '%Y-%m') AS month FROM days GROUP BY ALL HAVING count(*) = max(day(last_day(day)))
)
SELECT s.case_id, s.account_id, min(period_start) AS first_day, max(period_end) AS last_day,
    coalesce((SELECT string_agg(month, ', ' ORDER BY month) FROM own o WHERE o.account_id = s.account_id), 'None') AS complete_months
FROM statements s GROUP BY s.case_id, s.account_id"""))  # fmt: skip
def a8_account_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = orders_statements(spark, sf_dir)
    return M.account_coverage(statements, C.full_months(statements, per_account=True))


@query("a7_latest_account", over_orders("""
SELECT case_id, account_id, period_end FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY period_end DESC, account_id DESC) AS r FROM statements) WHERE r = 1"""))
def a7_latest_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest_account(orders_statements(spark, sf_dir))


@query("a4_revenue_metrics", over_orders(f"""{_OFFER}, m AS (
    SELECT c.case_id, c.month, c.covered_days / c.calendar_days AS f, c.covered_days = c.calendar_days AS whole
    FROM coverage c JOIN offer o ON o.case_id = c.case_id AND o.month = c.month
), rev AS (
    SELECT l.* FROM ledger l JOIN covered d ON d.case_id = l.case_id AND d.day = l.date WHERE revenue_status = 'True Revenue'
), filled AS (
    SELECT m.case_id, m.month, m.whole, coalesce((SELECT sum(amount) FROM rev r WHERE r.case_id = m.case_id AND r.month = m.month), 0)::DOUBLE / m.f AS r,
        (SELECT count(*) FROM rev r WHERE r.case_id = m.case_id AND r.month = m.month) / m.f AS k FROM m
), own AS (
    SELECT case_id, avg(r) AS a, stddev_pop(r) AS sd, avg(k) AS k, count(*) AS n, min_by(r, month) AS r1, max_by(r, month) AS r2, bool_and(whole) AS whole FROM filled GROUP BY 1
), pay AS (
    SELECT case_id, max(s)::DOUBLE / sum(s)::DOUBLE * 100 AS top FROM (SELECT r.case_id, description, sum(amount) AS s FROM rev r JOIN m ON m.case_id = r.case_id AND m.month = r.month GROUP BY ALL) GROUP BY 1
)
SELECT own.case_id, round(a, 4) AS average, round(k, 6) AS deposits, round(CASE WHEN whole AND n > 1 AND a > 0 THEN sd / a * 100 END, 6) AS volatility,
    round(CASE WHEN whole AND n > 1 AND r1 > 0 THEN (r2 - r1) / r1 * 100 END, 6) AS trend, round(coalesce(top, 0), 6) AS concentration
FROM own LEFT JOIN pay ON pay.case_id = own.case_id""", recursive=True))  # fmt: skip
def a4_revenue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = case_metrics(spark, sf_dir)
    return out.select("case_id", F.round("average", 4).alias("average"), *[ratio(F.col(c)).alias(c) for c in ("deposits", "volatility", "trend", "concentration")])


def chosen_months(statements: DataFrame) -> DataFrame:
    """Offer months with their coverage."""
    spans = written(C.covered_spans(statements))
    return C.coverage_summary(spans, C.offer_months(statements, spans))


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = written(orders_statements(spark, sf_dir))
    months = written(chosen_months(statements))
    rows = C.covered_rows(classified(spark, sf_dir), C.covered_spans(statements), months)
    return M.revenue_metrics(rows, months)


@query("v2_replaced_findings", over_orders("""
SELECT stmt_id, 'total' AS code, 'totals' AS rule_set FROM statements WHERE stmt_ord % 2 = 0
UNION ALL SELECT stmt_id, 'new', 'shared' FROM statements WHERE stmt_ord % 5 = 0"""))
def v2_replaced_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement has an old finding of the shared rules, every second one of the totals; every fifth gets a new shared one, twice."""
    st = orders_statements(spark, sf_dir)
    old = st.select("stmt_id", F.lit("old").alias("code"), F.lit("shared").alias("rule_set")).unionByName(
        st.where("stmt_ord % 2 = 0").select("stmt_id", F.lit("total").alias("code"), F.lit("totals").alias("rule_set"))
    )
    fresh = st.where("stmt_ord % 5 = 0").select("stmt_id", F.lit("new").alias("code"))
    return L.replace_findings(old, fresh.unionByName(fresh), "shared")


@query("j7_refreshed_currency", over_orders("""
SELECT l.id, CASE WHEN s.stmt_id IS NULL THEN l.currency WHEN s.stmt_ord % 3 = 0 THEN 'EUR' ELSE s.currency END AS currency
FROM ledger l LEFT JOIN statements s ON s.stmt_id = l.stmt_id"""))
def j7_refreshed_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = orders_statements(spark, sf_dir)
    new = st.withColumn("currency", F.when(F.col("stmt_ord") % 3 == 0, "EUR").otherwise(F.col("currency")))
    return L.refresh_currency(orders_ledger(spark, sf_dir), new).select("id", "currency")
