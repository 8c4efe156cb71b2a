"""Queries over whole cases: transfers, currency, debt, advances, policy and the decision run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from ledgerloom.functions.money import CENTS
from ledgerloom.lineage import kept_by, shared_folder, written
from ledgerloom.operators import classify as K
from ledgerloom.operators import coverage as C
from ledgerloom.operators import debt as D
from ledgerloom.operators import decision as X
from ledgerloom.operators import ledger as L
from ledgerloom.operators import metrics as M
from ledgerloom.operators import policy as P
from ledgerloom.plans.bridge import events_ledger, orders_ledger, orders_statements, table
from ledgerloom.plans.core import _OFFER, case_metrics, chosen_months, classified, query, ratio
from ledgerloom.plans.oracle_base import over_events, over_orders
from ledgerloom.sources import verified_csv as V
from ledgerloom.sources.statement_csv import StatementCsv
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: ratio(F.col(n)) for n in names})


# ---- Transfers and currency -----------------------------------------------------------------------------------------------


def _fx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in pairs of keys 2k, 2k + 1 (dates and sides of the even one mixed) as FX legs."""
    rows = orders_ledger(spark, sf_dir)
    group = F.floor(F.col("id") / 8)
    return rows.withColumns({
        "date": F.date_add(F.lit("1999-01-01").cast("date"), (group % 300).cast("int")),
        "description": F.concat(F.lit("FX TFR C# "), (group % 977).cast("string")),
        "amount": F.when(F.col("id") % 3 == 0, F.col("amount")).otherwise(F.lit(500).cast(CENTS)),
    })


_FX = """, legs AS (
    SELECT id, case_id, account_id, currency, tx_type, DATE '1999-01-01' + CAST((id // 8) % 300 AS INT) AS date, (id // 8) % 977 AS ref,
        CASE WHEN id % 3 = 0 THEN amount ELSE 500 END AS amount FROM ledger
)"""


@query("j1_fx_transfers", over_orders(f"""{_FX}
SELECT c.case_id, c.date, c.ref::VARCHAR AS reference, c.id AS credit_id, d.id AS debit_id FROM legs c
JOIN legs d ON c.case_id = d.case_id AND c.date = d.date AND c.ref = d.ref AND c.tx_type = 'credit' AND d.tx_type = 'debit'
WHERE c.account_id <> d.account_id AND NOT (c.currency = d.currency AND c.amount <> d.amount)
  AND (SELECT count(*) FROM legs x WHERE x.case_id = c.case_id AND x.date = c.date AND x.ref = c.ref AND x.tx_type = 'credit') = 1
  AND (SELECT count(*) FROM legs x WHERE x.case_id = c.case_id AND x.date = c.date AND x.ref = c.ref AND x.tx_type = 'debit') = 1"""))  # fmt: skip
def j1_fx_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.match_fx_transfers(_fx_rows(spark, sf_dir))


@query("j1_marked_ledger", over_orders(f"""{_FX}, pairs AS (
    SELECT c.id AS c, d.id AS d FROM legs c
    JOIN legs d ON c.case_id = d.case_id AND c.date = d.date AND c.ref = d.ref AND c.tx_type = 'credit' AND d.tx_type = 'debit'
    WHERE c.account_id <> d.account_id AND NOT (c.currency = d.currency AND c.amount <> d.amount)
      AND (SELECT count(*) FROM legs x WHERE x.case_id = c.case_id AND x.date = c.date AND x.ref = c.ref) = 2)
SELECT id, 'Non-Revenue - Own-Account / Internal Transfer' AS category, CASE WHEN tx_type = 'credit' THEN 'Non-Revenue' ELSE 'Not Applicable' END AS revenue_status
FROM ledger WHERE id IN (SELECT c FROM pairs UNION ALL SELECT d FROM pairs)"""))  # fmt: skip
def j1_marked_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.classify(_fx_rows(spark, sf_dir))
    marked = L.mark_transfers(rows, L.match_fx_transfers(rows))
    return marked.where("internal_transfer").select("id", "category", "revenue_status")


def _reciprocal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row names the account five numbers on (credits) or back (debits), on one of 200 days and of one of 40 amounts."""
    n = F.element_at(F.split("account_id", ":"), 2).cast("long")
    family = F.when(n % 5 == 0, "vancity:").when(n % 5 == 1, "scotia:").otherwise("bmo_business:")
    other = n - n % 20 + F.when(F.col("tx_type") == "credit", n + 5).otherwise(n + 15) % 20
    return orders_ledger(spark, sf_dir).withColumns({
        "account_id": F.concat(family, n.cast("string")), "target": F.when(F.col("id") % 7 != 0, F.concat(family, other.cast("string"))),
        "date": F.date_add(F.lit("1999-01-01").cast("date"), (F.col("id") % 200).cast("int")),
        "amount": (F.col("id") % 40 + 1).cast(CENTS), "currency": F.lit("CAD"),
        "holder": F.when(n % 5 != 2, F.concat(F.lit("Acme "), (n % 5).cast("string"), F.when(n % 20 > 9, " Inc").otherwise(" INC."))),
    })


@query("j2_reciprocal_transfers", over_orders(""", r AS (
    SELECT id, case_id, tx_type, number % 5 AS f, CASE WHEN number % 5 = 0 THEN 'vancity:' WHEN number % 5 = 1 THEN 'scotia:' ELSE 'bmo_business:' END || number AS acc,
        CASE WHEN id % 7 <> 0 THEN CASE WHEN number % 5 = 0 THEN 'vancity:' WHEN number % 5 = 1 THEN 'scotia:' ELSE 'bmo_business:' END
            || (number // 20 * 20 + CASE WHEN tx_type = 'credit' THEN (number + 5) % 20 ELSE (number + 15) % 20 END) END AS target, id % 200 AS d, id % 40 AS a FROM ledger
), met AS (
    SELECT c.case_id, c.id AS cid, x.id AS did, c.f FROM r c JOIN r x ON c.tx_type = 'credit' AND x.tx_type = 'debit' AND c.case_id = x.case_id
        AND x.acc = c.target AND x.target = c.acc AND c.acc <> x.acc AND c.d = x.d AND c.a = x.a
), once AS (
    SELECT * FROM met WHERE cid IN (SELECT cid FROM met GROUP BY cid HAVING count(*) = 1)
)
SELECT case_id, cid AS credit_id, did AS debit_id FROM once WHERE did IN (SELECT did FROM once GROUP BY did HAVING count(*) = 1) AND f <> 2"""))  # fmt: skip
def j2_reciprocal_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.match_reciprocal_transfers(_reciprocal_rows(spark, sf_dir))


@query("j2_transfer_targets", over_orders(""", n AS (
    SELECT id, tx_type, number % 3 AS f, lpad((id % 10000)::VARCHAR, 4, '0') AS a, lpad((id * 7 % 10000)::VARCHAR, 4, '0') AS b, lpad((id % 1000)::VARCHAR, 3, '0') AS c FROM ledger
)
SELECT id, CASE f WHEN 0 THEN 'bmo_business:' || a || b || '-' || c WHEN 1 THEN CASE WHEN (tx_type = 'debit') = (id % 5 <> 0) THEN 'scotia:1' || a || '2' || b || right(c, 2) END
    ELSE CASE WHEN id % 7 <> 0 AND (tx_type = 'debit') = (id % 5 <> 0) THEN 'vancity:' || a || b END END AS target FROM n"""))  # fmt: skip
def j2_transfer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three families that print the other account in their own ways; in two of them 'to' and 'from' must fit the side."""
    k, n = F.col("id"), F.element_at(F.split("account_id", ":"), 2).cast("long")
    a, b, c = F.lpad((k % 10000).cast("string"), 4, "0"), F.lpad((k * 7 % 10000).cast("string"), 4, "0"), F.lpad((k % 1000).cast("string"), 3, "0")
    told = F.when(k % 5 != 0, "TO").otherwise("FROM")
    bmo = F.concat(F.lit("Transfer, "), a, F.lit("-"), b, F.lit("-"), c, F.lit(" ref"))
    scotia = F.concat(F.lit("TRANSFER "), told, F.lit(" 1"), a, F.lit(" 2"), b, F.lit(" "), F.right(c, F.lit(2)))
    vancity = F.concat(F.lit("Funds Trans fer - Online "), told, F.lit(" #"), F.when(k % 7 != 0, "10").otherwise("20"), a, F.lit(" "), b)
    rows = orders_ledger(spark, sf_dir).select(
        "id", "tx_type", F.when(n % 3 == 0, "bmo_business:1").when(n % 3 == 1, "scotia:1").otherwise("vancity:1").alias("account_id"),
        F.when(n % 3 == 0, bmo).when(n % 3 == 1, scotia).otherwise(vancity).alias("description"),
    )
    return rows.select("id", L.transfer_target(F.col("account_id"), F.col("tx_type"), F.col("description")).alias("target"))


@query("j6_reporting_currency", over_orders("""
SELECT id, CAST(CASE WHEN currency = 'USD' THEN amount * 1.365 ELSE amount END AS DECIMAL(18,4)) AS reporting_amount FROM ledger WHERE case_id <> 3"""))
def j6_reporting_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates are known for USD alone; one row of case 3 is in an unknown currency, which voids that case."""
    rows = orders_ledger(spark, sf_dir)
    first = rows.where("case_id = 3").agg(F.min("id").alias("m"))
    odd = rows.join(F.broadcast(first), F.col("id") == F.col("m"), "left").withColumn(
        "currency", F.when(F.col("m").isNotNull(), "XXX").otherwise(F.col("currency"))
    ).drop("m")
    rates = spark.createDataFrame([("USD",)], "currency string").select("currency", F.lit("1.365").cast("decimal(18,6)").alias("rate"))
    return L.to_reporting_currency(odd, rates).select("id", F.col("reporting_amount").cast("decimal(18,4)").alias("reporting_amount"))


@query("r1_currency_policy", over_orders("""
SELECT stmt_id, CASE WHEN stmt_ord % 11 = 0 THEN 'USD' WHEN stmt_ord % 3 <> 0 THEN currency END AS currency,
    CASE WHEN stmt_ord % 11 = 0 THEN 'underwriter_confirmation' WHEN stmt_ord % 3 <> 0 THEN 'printed' ELSE 'not_printed' END AS currency_source,
    stmt_ord % 11 <> 0 AND stmt_ord % 3 = 0 AS currency_unknown FROM statements"""))
def r1_currency_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = orders_statements(spark, sf_dir)
    choices = st.where("stmt_ord % 11 = 0").select("stmt_id", F.lit("USD").alias("choice"))
    printed = st.withColumn("currency", F.when(F.col("stmt_ord") % 3 != 0, F.col("currency")).when(F.col("stmt_ord") % 2 == 0, "Unknown"))
    return L.currency_of(printed, True, choices).select("stmt_id", "currency", "currency_source", "currency_unknown")


# ---- Debt and advances ------------------------------------------------------------------------------------------------------


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debits of the daily ledger, each event type of a user as one creditor, amounts rounded to tens."""
    rows = events_ledger(spark, sf_dir).where("tx_type = 'debit'")
    return rows.select(
        "case_id", "account_id", F.col("event_type").alias("lender"), F.lit("").alias("reference"), "date", "id",
        F.row_number().over(Window.partitionBy("account_id", "event_type").orderBy("ts", "id")).alias("seq"),
        (F.round(F.col("amount") / 100) * 100 + 100).cast(CENTS).alias("amount"),
    )


@query("g6_payment_cadence", over_events(""", p AS (
    SELECT account_id, event_type AS lender, date, id, row_number() OVER (PARTITION BY account_id, event_type ORDER BY ts, id) AS seq,
        CAST(round(amount / 100) * 100 + 100 AS DECIMAL(18,2)) AS a FROM daily WHERE tx_type = 'debit'
), six AS (
    SELECT *, row_number() OVER (PARTITION BY account_id, lender ORDER BY date DESC, seq DESC) AS r FROM p
    WHERE date >= (SELECT max(date) FROM p q WHERE q.account_id = p.account_id AND q.lender = p.lender) - 44
), modal AS (
    SELECT account_id, lender, a, count(*) AS k, max(r) AS oldest FROM six WHERE r <= 6 GROUP BY ALL
), picked AS (
    SELECT account_id, lender, arg_max(a, k * 100 + oldest) AS a, max(k) AS k, sum(k) AS n FROM modal GROUP BY 1, 2
), gaps AS (
    SELECT account_id, lender, d, d - lag(d) OVER (PARTITION BY account_id, lender ORDER BY d) AS g FROM (SELECT DISTINCT account_id, lender, date AS d FROM six)
), shape AS (
    SELECT account_id, lender, count(*) AS nd, count(g) AS ng, median(g) AS md, avg((g <= 4)::INT) AS f4, avg((g BETWEEN 6 AND 8)::INT) AS f7, avg((g BETWEEN 12 AND 16)::INT) AS f14 FROM gaps GROUP BY 1, 2
)
SELECT s.account_id, s.lender, CAST(CASE WHEN p.k >= greatest(2, 0.6 * p.n) THEN p.a ELSE l.a END AS DECIMAL(18,2)) AS installment,
    CASE WHEN nd >= 6 AND md <= 2 AND f4 >= 0.8 THEN 'Daily' WHEN ng >= 2 AND f7 >= 0.6 THEN 'Weekly' WHEN ng >= 2 AND f14 >= 0.6 THEN 'Bi-Weekly'
         WHEN ng >= 3 AND md BETWEEN 2 AND 4 THEN '2-3x Weekly' WHEN md BETWEEN 26 AND 35 THEN 'Monthly' WHEN nd > 1 THEN NULL ELSE 'Monthly' END AS frequency
FROM shape s JOIN picked p USING (account_id, lender) JOIN six l ON l.account_id = s.account_id AND l.lender = s.lender AND l.r = 1"""))  # fmt: skip
def g6_payment_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.payment_pattern(_payments(spark, sf_dir), ["account_id", "lender"]).select("account_id", "lender", "installment", "frequency")


def _streams_sql(rows: str, group: str) -> str:
    """CTEs up to `streamed`: the rows (id, date, seq, amount and `group`) with their stream, payment by payment in a recursion."""
    same = lambda x, y: " AND ".join(f"{x}.{c.strip()} IS NOT DISTINCT FROM {y}.{c.strip()}" for c in group.split(","))
    of = lambda x: ", ".join(f"{x}.{c.strip()}" for c in group.split(","))
    return f"""per_day AS (
    SELECT {group}, date, count(*) AS n, list({{'amount': amount, 'id': id}} ORDER BY seq, id) AS paid,
        row_number() OVER (PARTITION BY {group} ORDER BY date DESC) AS r FROM {rows} GROUP BY {group}, date
), usual AS (
    SELECT {group}, n, count(*) AS k FROM per_day WHERE r <= 6 GROUP BY {group}, n
), gated AS (
    SELECT u.*, (SELECT list_sort(list_transform(arg_min(d.paid, d.r), lambda x: x.amount)) FROM per_day d WHERE {same("d", "u")} AND d.n = u.n) AS anchors
    FROM usual u WHERE n >= 2 AND k >= 3 AND k >= 0.6 * (SELECT least(6, max(r)) FROM per_day d WHERE {same("d", "u")})
), walk AS (
    SELECT {of("g")}, n, 1 AS r, d.paid AS todo, range(1, n + 1) AS free, anchors, NULL::BIGINT AS id, NULL::BIGINT AS stream
    FROM gated g JOIN (SELECT * EXCLUDE (n) FROM per_day) d ON d.r = 1 AND {same("d", "g")}
    UNION ALL
    SELECT {of("p")}, p.n, p.r + (len(p.rest) = 0)::INT, CASE WHEN len(p.rest) = 0 THEN d.paid ELSE p.rest END,
        CASE WHEN len(p.rest) = 0 THEN range(1, p.n + 1) ELSE p.unused END, p.anchors, p.id, p.stream
    FROM (
        SELECT {of("w")}, n, r, todo[best.place].id AS id, best.stream AS stream,
            list_transform(range(1, n + 1), lambda s: CASE WHEN s = best.stream THEN todo[best.place].amount ELSE anchors[s] END) AS anchors,
            [todo[j] for j in range(1, len(todo) + 1) if j <> best.place] AS rest, list_filter(free, lambda s: s <> best.stream) AS unused
        FROM (
            SELECT *, list_sort(flatten(list_transform(CASE WHEN len(free) > 0 THEN free ELSE range(1, n + 1) END, lambda s: list_transform(
                range(1, len(todo) + 1), lambda j: {{'gap': abs(todo[j].amount - anchors[s]), 'stream': s, 'place': j}}))))[1] AS best
            FROM walk WHERE todo IS NOT NULL
        ) w
    ) p LEFT JOIN per_day d ON d.r = p.r + 1 AND {same("d", "p")}
), streamed AS (
    SELECT x.*, coalesce(w.stream, 1) AS stream FROM {rows} x LEFT JOIN walk w ON w.id = x.id AND {same("w", "x")}
)"""


def _pattern_sql(key: str) -> str:
    """CTEs from `streamed` to `pattern`: installment and frequency of each stream."""
    same = lambda x, y: " AND ".join(f"{x}.{c.strip()} IS NOT DISTINCT FROM {y}.{c.strip()}" for c in key.split(","))
    return f"""six AS (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date DESC, seq DESC) AS r FROM streamed s
    WHERE date >= (SELECT max(date) FROM streamed q WHERE {same("q", "s")}) - 44
), modal AS (
    SELECT {key}, amount, count(*) AS k, max(r) AS oldest FROM six WHERE r <= 6 GROUP BY ALL
), picked AS (
    SELECT {key}, arg_max(amount, k * 100 + oldest) AS a, max(k) AS k, sum(k) AS n FROM modal GROUP BY {key}
), gaps AS (
    SELECT {key}, d, d - lag(d) OVER (PARTITION BY {key} ORDER BY d) AS g FROM (SELECT DISTINCT {key}, date AS d FROM six)
), shape AS (
    SELECT {key}, count(*) AS nd, count(g) AS ng, median(g) AS md, avg((g <= 4)::INT) AS f4, avg((g BETWEEN 6 AND 8)::INT) AS f7,
        avg((g BETWEEN 12 AND 16)::INT) AS f14 FROM gaps GROUP BY {key}
), pattern AS (
    SELECT {", ".join("s." + c.strip() for c in key.split(","))}, CAST(CASE WHEN p.k >= greatest(2, 0.6 * p.n) THEN p.a ELSE l.amount END AS DECIMAL(18,2)) AS installment,
        CASE WHEN nd >= 6 AND md <= 2 AND f4 >= 0.8 THEN 'Daily' WHEN ng >= 2 AND f7 >= 0.6 THEN 'Weekly' WHEN ng >= 2 AND f14 >= 0.6 THEN 'Bi-Weekly'
             WHEN ng >= 3 AND md BETWEEN 2 AND 4 THEN '2-3x Weekly' WHEN md BETWEEN 26 AND 35 THEN 'Monthly' WHEN nd > 1 THEN NULL ELSE 'Monthly' END AS frequency
    FROM shape s JOIN picked p ON {same("p", "s")} JOIN six l ON {same("l", "s")} AND l.r = 1
)"""


_EVENT_PAYMENTS = """, paid AS (
    SELECT case_id, event_type AS lender, date, id, row_number() OVER (PARTITION BY case_id, event_type ORDER BY date, id) AS seq,
        CAST(round(amount / 100) * 100 + 100 AS DECIMAL(18,2)) AS amount FROM daily WHERE tx_type = 'debit'
), """


@query("g5_payment_streams", over_events(f"""{_EVENT_PAYMENTS}{_streams_sql("paid", "case_id, lender")}
SELECT case_id, lender, id, date, amount, CAST(stream AS INT) AS stream FROM streamed""", recursive=True))
def g5_payment_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of a case and creditor on the days of its accounts: many groups have several payments a day."""
    rows = _payments(spark, sf_dir).withColumn("account_id", F.lit("all")).withColumn(
        "seq", F.row_number().over(Window.partitionBy("case_id", "lender").orderBy("date", "id"))
    )
    return D.concurrent_streams(rows).select("case_id", "lender", "id", "date", "amount", "stream")


def _g7(rows: DataFrame) -> DataFrame:
    return M.ranked_latest(rows, ["account_id"], [F.desc("date"), F.desc("id")], 6)


@query("g7_latest_payments", over_orders("""
SELECT account_id, id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date DESC, id DESC) AS r FROM ledger) WHERE r <= 6"""))
def g7_latest_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _g7(orders_ledger(spark, sf_dir)).select("account_id", "id", "rank")


def _debit_days(ledger: DataFrame) -> DataFrame:
    """The daily ledger with the accounts of a case taken together, so that creditors are paid several times a day."""
    return ledger.withColumns({"account_id": F.lit("all"), "seq": F.row_number().over(Window.partitionBy("case_id").orderBy("date", "id"))})


@query("a10_seed_positions", over_events(f"""), matched AS (
    SELECT case_id, lender, tier, reference, description, date, id, amount, row_number() OVER (PARTITION BY case_id ORDER BY date, id) AS seq, tx_type FROM daily
), paid AS (
    SELECT * FROM matched WHERE tx_type = 'debit' AND lender IS NOT NULL
), {_streams_sql("paid", "case_id, lender, reference")}, {_pattern_sql("case_id, lender, reference, stream")}, seen AS (
    SELECT case_id, lender, reference, stream, any_value(tier) AS tier, count(*) AS observed_payments, CAST(sum(amount) AS DECIMAL(18,2)) AS observed_total,
        max(date) AS last_seen, string_agg(strftime(date, '%Y-%m-%d') || ':' || id, ',' ORDER BY date, id) AS evidence,
        max(stream) OVER (PARTITION BY case_id, lender, reference) AS streams FROM streamed GROUP BY case_id, lender, reference, stream
)
SELECT s.case_id, s.lender, s.stream::INT AS stream, CASE WHEN s.reference <> '' THEN s.reference ELSE s.lender END
        || CASE WHEN streams > 1 THEN ' / payment stream ' || s.stream ELSE '' END AS reference,
    CASE WHEN tier = 'Bank' THEN 'Other debt' WHEN tier IN ('Premium', 'Standard') THEN 'MCA' END AS kind, frequency, installment AS payment, observed_payments,
    observed_total, last_seen, evidence FROM seen s JOIN pattern p ON p.case_id = s.case_id AND p.lender = s.lender AND p.reference = s.reference AND p.stream = s.stream
""".removeprefix(")"), recursive=True))  # fmt: skip
def a10_seed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeded = D.seeded_payments(_debit_days(events_ledger(spark, sf_dir)))
    rows = D.position_evidence(seeded).groupBy("position_id").agg(F.array_sort(F.collect_list(F.struct("date", "id"))).alias("evidence"))
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["date"].cast("string"), e["id"].cast("string"))), ",")
    return D.positions_of(seeded).join(rows, "position_id").select(
        "case_id", "lender", "stream", "reference", "kind", "frequency", "payment", "observed_payments", "observed_total", "last_seen", shown.alias("evidence")
    )


@query("a10_position_evidence", over_events(f"""), paid AS (
    SELECT case_id, lender, reference, date, id, amount, row_number() OVER (PARTITION BY case_id ORDER BY date, id) AS seq FROM (
        SELECT *, tx_type = 'debit' AND lender IS NOT NULL AS mine FROM daily) WHERE mine
), {_streams_sql("paid", "case_id, lender, reference")}
SELECT case_id, lender, reference AS contract, stream::INT AS stream, id, date, amount FROM streamed""".removeprefix(")"), recursive=True))  # fmt: skip
def a10_position_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments that each seeded position rests on, by its id."""
    seeded = D.seeded_payments(_debit_days(events_ledger(spark, sf_dir)))
    named = D.positions_of(seeded).select("position_id", "lender", "contract", "stream")
    return D.position_evidence(seeded).join(named, "position_id").select("case_id", "lender", "contract", "stream", "id", "date", "amount")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A debt schedule made of suppliers: case, kind, frequency and payment from their keys and balances."""
    k = F.col("s_suppkey")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("position_id"), (F.col("s_nationkey") % 5).cast("long").alias("case_id"), F.lit("a").alias("account_id"),
        F.col("s_name").alias("lender"), F.lit("").alias("reference"), F.lit("").alias("contract"), pick("MCA", "Other debt", "MCA", None).alias("kind"),
        pick("Active", "Active", "Closed", "Active", "Not debt").alias("status"),
        pick("Daily", "Weekly", "Monthly", "Bi-Weekly", "2-3x Weekly", "Monthly", None).alias("frequency"),
        F.col("s_acctbal").cast(CENTS).alias("payment"), (k % 3 != 0).alias("verified"),
        F.array(F.struct((k * 7).cast("long").alias("id"))).alias("evidence"),
    )


_POSITIONS = """
WITH p AS (
    SELECT s_suppkey AS k, s_nationkey % 5 AS case_id, s_name AS lender, CASE s_suppkey % 4 WHEN 0 THEN 'MCA' WHEN 1 THEN 'Other debt' WHEN 2 THEN 'MCA' END AS kind,
        CASE s_suppkey % 5 WHEN 2 THEN 'Closed' WHEN 4 THEN 'Not debt' ELSE 'Active' END AS status,
        CASE s_suppkey % 7 WHEN 0 THEN 21 WHEN 1 THEN 52.0::DOUBLE / 12 WHEN 2 THEN 1 WHEN 3 THEN 26.0::DOUBLE / 12 WHEN 4 THEN 9 WHEN 5 THEN 1 END::DOUBLE AS m,
        CAST(s_acctbal AS DECIMAL(18,2)) AS pay, s_suppkey % 3 <> 0 AS verified FROM supplier
), g AS (
    SELECT *, verified AND (status <> 'Active' OR (kind IS NOT NULL AND m IS NOT NULL AND pay > 0)) AS good FROM p
)"""


@query("a9_debt_summary", f"""{_POSITIONS}
SELECT case_id, round(coalesce(sum(pay::DOUBLE * m) FILTER (WHERE good AND status = 'Active'), 0), 4) AS monthly_debt,
    count(*) FILTER (WHERE good AND status = 'Active' AND kind = 'MCA') AS mca_positions, count(*) FILTER (WHERE good AND status = 'Active') AS active_positions,
    count(*) FILTER (WHERE NOT good) AS unverified,
    round(CASE WHEN bool_and(status <> 'Active' OR (pay > 0 AND m IS NOT NULL)) THEN coalesce(sum(pay::DOUBLE * m) FILTER (WHERE status = 'Active'), 0) END, 4) AS suggested_monthly_debt
FROM g GROUP BY case_id""")  # fmt: skip
def a9_debt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.debt_summary(_positions(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("monthly_debt", "suggested_monthly_debt")})


@query("a12_debt_revenue_ratios", over_orders(""", rev AS (
    SELECT case_id, month, coalesce(sum(amount) FILTER (WHERE revenue_status = 'True Revenue'), 0) AS r FROM ledger GROUP BY 1, 2
), p AS (
    SELECT s_suppkey::VARCHAR AS id, s_nationkey % 5 AS case_id, CAST(s_acctbal AS DECIMAL(18,2))::DOUBLE * CASE s_suppkey % 7 WHEN 0 THEN 21 WHEN 1 THEN 52.0::DOUBLE / 12 WHEN 2 THEN 1
        WHEN 3 THEN 26.0::DOUBLE / 12 WHEN 4 THEN 9 WHEN 5 THEN 1 END::DOUBLE AS o FROM supplier
    WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 NOT IN (2, 4) AND s_acctbal > 0 AND s_suppkey % 7 <> 6 AND s_suppkey % 4 <> 3
), each AS (
    SELECT rev.case_id, month, id AS position_id, r, o FROM rev JOIN p ON p.case_id = rev.case_id
    UNION ALL SELECT rev.case_id, month, 'Total', r, sum(o) FROM rev JOIN p ON p.case_id = rev.case_id GROUP BY ALL
)
SELECT case_id, month, position_id, round(CASE WHEN r > 0 THEN o / r::DOUBLE * 100 END, 6) AS ratio FROM each"""))  # fmt: skip
def a12_debt_revenue_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = classified(spark, sf_dir).groupBy("case_id", "month").agg(
        F.coalesce(F.sum(F.when(K.is_revenue(), F.col("amount"))), F.lit(0)).cast(CENTS).alias("revenue")
    )
    good = _positions(spark, sf_dir).where("verified and status = 'Active'").where(F.size(D.position_issues()) == 0)
    return _six(M.debt_revenue_ratios(revenue, good), "ratio")


def _schedule(seeded: DataFrame) -> DataFrame:
    """Seeded positions, those of BIZFUND in cases 0 and 1 verified as no debt."""
    no = (F.col("lender") == "BIZFUND") & (F.col("case_id") < 2)
    return D.positions_of(seeded).withColumns({"status": F.when(no, "Not debt").otherwise(F.col("status")), "verified": no})


@query("p5_debt_payment_mask", over_orders("""
SELECT id, lender, amount FROM ledger WHERE tx_type = 'debit' AND lender IS NOT NULL AND NOT (lender = 'BIZFUND' AND case_id < 2)"""))
def p5_debt_payment_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = orders_ledger(spark, sf_dir)
    seeded = D.seeded_payments(ledger)
    return D.debt_payment_rows(ledger, _schedule(seeded), evidence=D.position_evidence(seeded)).select("id", "lender", "amount")


@query("r4_position_edits", f"""{_POSITIONS}, e AS (
    SELECT *, k % 2 = 0 AS edited, CASE WHEN k % 2 = 0 AND k % 4 = 0 THEN pay + 1 ELSE pay END AS new_pay, CASE WHEN k % 2 = 0 THEN true ELSE verified END AS asked FROM g
), j AS (
    SELECT *, verified AND new_pay <> pay AS voided, status <> 'Active' OR (kind IS NOT NULL AND m IS NOT NULL AND new_pay > 0) AS fine FROM e
)
SELECT k::VARCHAR AS position_id, edited AND asked AND NOT voided AND NOT fine AS rejected, NOT (edited AND asked AND NOT voided AND NOT fine) AND voided AS verification_voided,
    CASE WHEN NOT edited THEN verified WHEN asked AND NOT voided AND NOT fine THEN verified ELSE asked AND NOT voided END AS verified,
    CAST(CASE WHEN edited AND NOT (asked AND NOT voided AND NOT fine) THEN new_pay ELSE pay END AS DECIMAL(18,2)) AS payment FROM j""")  # fmt: skip
def r4_position_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _positions(spark, sf_dir)
    edits = own.where("cast(position_id as long) % 2 = 0").select(
        "position_id", F.when(F.col("position_id").cast("long") % 4 == 0, F.col("payment") + 1).cast(CENTS).alias("payment"), F.lit(True).alias("verified")
    )
    return D.save_positions(own, edits).select("position_id", "rejected", "verification_voided", "verified", "payment")


@query("r4_position_split", f"""{_POSITIONS}
SELECT lender, verified AND k % 10 <> 0 AS verified, pay AS payment FROM g UNION ALL SELECT lender, false, 0 FROM g WHERE k % 10 = 0""")
def r4_position_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _positions(spark, sf_dir)
    return D.split_positions(own, own.where("cast(position_id as long) % 10 = 0")).select("lender", "verified", "payment")


@query("a6_advances", over_orders(""", key AS (
    SELECT id, case_id, account_id, currency, lender, date, amount, tx_type FROM ledger WHERE tier IN ('Premium', 'Standard')
), back AS (
    SELECT account_id, currency, date, amount FROM ledger WHERE description IN ('STRIPE REFUND', 'GST REFUND CANADA REVENUE', 'Cheque returned NSF', 'RETURNED ITEM CREDIT')
), groups AS (
    SELECT DISTINCT case_id, account_id, currency, lender FROM key
), doubt AS (
    SELECT DISTINCT p.account_id, p.lender FROM key p JOIN back b ON p.tx_type = 'debit' AND b.account_id = p.account_id AND b.currency = p.currency AND b.amount = p.amount AND b.date - p.date BETWEEN 0 AND 7
), adv AS (
    SELECT g.*, a.id AS advance_id, a.date AS funded, a.amount AS principal FROM groups g LEFT JOIN key a ON a.tx_type = 'credit' AND a.account_id = g.account_id AND a.lender = g.lender
), paid AS (
    SELECT v.*, (SELECT coalesce(sum(amount), 0) FROM key p WHERE p.tx_type = 'debit' AND p.account_id = v.account_id AND p.lender = v.lender AND (v.funded IS NULL OR p.date >= v.funded)) AS observed,
        (SELECT count(*) FROM key p WHERE p.tx_type = 'debit' AND p.account_id = v.account_id AND p.lender = v.lender AND (v.funded IS NULL OR p.date >= v.funded)) AS payments,
        (SELECT count(*) FROM key p WHERE p.tx_type = 'credit' AND p.account_id = v.account_id AND p.lender = v.lender) > 1
          OR EXISTS (SELECT 1 FROM doubt d WHERE d.account_id = v.account_id AND d.lender = v.lender) AS unclear,
        floor(principal * 146 + 0.5) / 100 AS target FROM adv v
)
SELECT account_id, lender, advance_id, CAST(target AS DECIMAL(18,2)) AS target, CAST(observed AS DECIMAL(18,2)) AS observed, payments,
    CAST(CASE WHEN NOT unclear AND funded IS NOT NULL THEN greatest(0, target - observed) END AS DECIMAL(18,2)) AS remaining,
    CASE WHEN funded IS NULL THEN 'unknown: no funding deposit' WHEN unclear THEN 'unknown: contract or returned payment' WHEN observed >= target THEN 'expected completed' ELSE 'not shown complete' END AS status
FROM paid"""))  # fmt: skip
def a6_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.advances(orders_ledger(spark, sf_dir)).select("account_id", "lender", "advance_id", "target", "observed", "payments", "remaining", "status")


# ---- Policy -------------------------------------------------------------------------------------------------------------------


def _policy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case of each customer, its measures drawn from the customer's key and balance."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    industries = sorted(P.rules.INDUSTRIES)
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("case_id"), (b * 25).alias("revenue"), F.when(k % 11 != 0, b / 200).alias("trend"), F.when(k % 13 != 0, F.abs(b) / 150).alias("volatility"),
        (k % 60).cast("double").alias("deposits"), (k % 50).cast("double").alias("concentration"), (k % 30).cast("double").alias("burden"), (k % 6).alias("positions"),
        (k % 4).alias("lenders"), (k % 7).alias("returned"), (k % 100).alias("months_in_business"), pick([*industries, "none"]).alias("industry"),
        F.when(k % 9 != 0, 400 + k % 450).alias("credit_score"), pick(list(P.RECORDS)).alias("public_records"), pick(list(P.VERIFICATION)).alias("bank_verification"),
        (F.abs(b) * 15).alias("operating_outflows"), (F.abs(b) * 5).alias("monthly_debt"),
    )


def _ladder(column: str, steps: list[tuple], last: int, op: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 0 " + " ".join(f"WHEN {column} {op} {b} THEN {p}" for b, p in steps) + f" ELSE {last} END"


_INDUSTRY_ROWS = ", ".join("({}, '{}', {}, {})".format(i, n.replace("'", "''"), *P.rules.INDUSTRIES[n]) for i, n in enumerate(sorted(P.rules.INDUSTRIES)))
#: Points of cases `c` (r revenue, t trend, v volatility, n deposits, con concentration, b burden, pos, len lenders, ret returned, mon months,
#: ind industry, cr credit, q records, u verification, margin) and their total.
_POINTS = """s AS (
    SELECT case_id, CASE WHEN r >= 150000 THEN 17 WHEN r >= 75000 THEN 14 WHEN r >= 40000 THEN 11 WHEN r >= 20000 THEN 8 WHEN r >= 10000 THEN 6 ELSE 0 END AS revenue,
        CASE WHEN t IS NULL THEN 0 WHEN t > 15 THEN 6 WHEN t >= 5 THEN 5 WHEN t >= -5 THEN 4 WHEN t >= -10 THEN 2 WHEN t >= -20 THEN 1 ELSE 0 END AS trend,
        CASE WHEN n >= 40 THEN 5 WHEN n >= 20 THEN 4 WHEN n >= 10 THEN 3 WHEN n >= 5 THEN 2 ELSE 0 END AS deposits,
        CASE WHEN v IS NULL THEN 0 WHEN v <= 10 THEN 5 WHEN v <= 20 THEN 4 WHEN v <= 30 THEN 3 WHEN v <= 40 THEN 2 WHEN v <= 50 THEN 1 ELSE 0 END AS volatility,
        CASE pos WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS positions,
        CASE WHEN b <= 8 THEN 10 WHEN b <= 12 THEN 8 WHEN b <= 16 THEN 6 WHEN b <= 20 THEN 4 WHEN b <= 25 THEN 2 ELSE 0 END AS burden,
        CASE len WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END AS velocity, CASE WHEN ret = 0 THEN 4 WHEN ret = 1 THEN 3 WHEN ret = 2 THEN 2 WHEN ret <= 4 THEN 1 ELSE 0 END AS returned,
        CASE WHEN mon >= 84 THEN 6 WHEN mon >= 48 THEN 5 WHEN mon >= 24 THEN 4 WHEN mon >= 12 THEN 3 WHEN mon >= 6 THEN 1 ELSE 0 END AS time,
        points AS industry, season AS seasonality,
        CASE WHEN cr IS NULL THEN 0 WHEN cr >= 750 THEN 6 WHEN cr >= 700 THEN 5 WHEN cr >= 650 THEN 4 WHEN cr >= 600 THEN 3 WHEN cr >= 550 THEN 2 WHEN cr >= 500 THEN 1 ELSE 0 END AS credit,
        CASE q WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS records, CASE u WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS verification,
        CASE WHEN con <= 20 THEN 2 WHEN con <= 35 THEN 1 ELSE 0 END AS concentration,
        CASE WHEN margin IS NULL THEN 0 WHEN margin >= 10 THEN 7 WHEN margin >= 5 THEN 6 WHEN margin >= 3 THEN 5 WHEN margin >= 0 THEN 4 WHEN margin >= -5 THEN 2 WHEN margin >= -10 THEN 1 ELSE 0 END AS cash
    FROM c LEFT JOIN ind ON ind.i = c.ind
), total AS (
    SELECT *, revenue + trend + deposits + volatility + positions + burden + velocity + returned + time + industry + seasonality + credit + records + verification + concentration + cash AS score FROM s"""
_SCORE = f"""
WITH ind(i, name, points, season) AS (VALUES {_INDUSTRY_ROWS}), c AS (
    SELECT c_custkey AS case_id, c_acctbal * 25 AS r, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 200 END AS t, CASE WHEN c_custkey % 13 <> 0 THEN abs(c_acctbal) / 150 END AS v,
        c_custkey % 60 AS n, c_custkey % 50 AS con, c_custkey % 30 AS b, c_custkey % 6 AS pos, c_custkey % 4 AS len, c_custkey % 7 AS ret, c_custkey % 100 AS mon,
        c_custkey % {len(P.rules.INDUSTRIES) + 1} AS ind, CASE WHEN c_custkey % 9 <> 0 THEN 400 + c_custkey % 450 END AS cr, c_custkey % 4 AS q, c_custkey % 4 AS u,
        CASE WHEN c_acctbal > 0 THEN (c_acctbal * 25 - abs(c_acctbal) * 15 - abs(c_acctbal) * 5) / (c_acctbal * 25) * 100 END AS margin FROM customer
), {_POINTS}
)"""


@query("r6_j8_scorecard", f"""{_SCORE}
SELECT case_id, score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 82 THEN 'A' WHEN score >= 74 THEN 'B' WHEN score >= 66 THEN 'C' WHEN score >= 58 THEN 'D' WHEN score IS NOT NULL THEN 'E' END AS grade,
    CASE WHEN score >= 90 THEN 1.0 WHEN score >= 82 THEN 0.85 WHEN score >= 74 THEN 0.7 WHEN score >= 66 THEN 0.55 WHEN score >= 58 THEN 0.35 WHEN score IS NOT NULL THEN 0 END::DOUBLE AS advance,
    CASE WHEN score >= 90 THEN 0.18 WHEN score >= 82 THEN 0.17 WHEN score >= 74 THEN 0.15 WHEN score >= 66 THEN 0.13 WHEN score >= 58 THEN 0.1 WHEN score IS NOT NULL THEN 0 END::DOUBLE AS max_burden FROM total""")  # fmt: skip
def r6_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scorecard(_policy_cases(spark, sf_dir)).select("case_id", "score", "grade", "advance", "max_burden")


@query("r6_component_points", f"""{_SCORE}
SELECT case_id, component, points FROM (SELECT case_id, revenue, trend, deposits, volatility, positions, burden, velocity, returned, time, industry, seasonality, credit, records, verification, concentration, cash FROM total)
UNPIVOT INCLUDE NULLS (points FOR component IN (revenue, trend, deposits, volatility, positions, burden, velocity, returned, time, industry, seasonality, credit, records, verification, concentration, cash))""")  # fmt: skip
def r6_component_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.component_points(P.scorecard(_policy_cases(spark, sf_dir)))


def _funding_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, b = F.col("c_custkey"), F.col("c_acctbal").cast(CENTS)
    return table(spark, sf_dir, "customer").select(
        k.alias("case_id"), (b * 3).cast(CENTS).alias("revenue"), (k % 900).cast(CENTS).alias("monthly_debt"), (k % 700).cast(CENTS).alias("operating_outflows"),
        F.lit(0).cast(CENTS).alias("reserve"), (k % 9).cast("int").alias("term"), F.lit("1.46").cast("decimal(6,4)").alias("factor"),
        F.element_at(F.array(*[F.lit(x).cast("decimal(6,4)") for x in ("1.0", "0.85", "0.7", "0.55", "0.35")]), (k % 5 + 1).cast("int")).alias("advance"),
        F.lit("0.15").cast("decimal(6,4)").alias("max_burden"), (k % 5).cast("int").alias("funding_position"), F.when(k % 2 == 0, (k * 11).cast(CENTS)).alias("cap"),
    )


@query("r7_funding_limits", """
WITH c AS (
    SELECT c_custkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) * 3 AS r, c_custkey % 900 AS d, c_custkey % 700 AS o, c_custkey % 9 AS term, c_custkey % 5 AS p,
        CASE c_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 85 WHEN 2 THEN 70 WHEN 3 THEN 55 ELSE 35 END AS a, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 11 END AS cap FROM customer
), t AS (
    SELECT *, CASE p WHEN 1 THEN 5 WHEN 0 THEN NULL ELSE 3 END AS lo, CASE p WHEN 1 THEN 8 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 4 END AS hi, floor(r * a) / 100 AS multiple FROM c
), x AS (
    SELECT *, CASE WHEN r < 0 THEN 'negative or missing amount' WHEN lo IS NULL THEN 'position below one' WHEN term NOT BETWEEN lo AND hi THEN 'term out of bounds' END AS problem,
        least(multiple, coalesce(cap, multiple)) AS amount FROM t
)
SELECT k AS case_id, problem, CAST(CASE WHEN problem IS NULL THEN amount END AS DECIMAL(18,2)) AS amount, round(CASE WHEN problem IS NULL THEN amount::DOUBLE * 1.46 / term END, 6) AS monthly_payment,
    round(CASE WHEN problem IS NULL THEN greatest(0, least(r * 0.15 - d, r - o - d))::DOUBLE END, 6) AS monthly_capacity FROM x""")  # fmt: skip
def r7_funding_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.funding_limits(_funding_cases(spark, sf_dir))
    return _six(out.select("case_id", "problem", "amount", "monthly_payment", "monthly_capacity"), "monthly_payment", "monthly_capacity")


@query("r8_r9_r10_ranges", """
WITH c AS (
    SELECT c_custkey AS k, CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS u, c_custkey % 40 AS pct FROM customer
), h AS (
    SELECT *, CAST(floor(u * 85) / 100 AS DECIMAL(18,2)) AS low FROM c
)
SELECT k AS case_id, CAST(low AS DECIMAL(18,2)) AS low, CAST(floor((low + u) * 50) / 100 AS DECIMAL(18,2)) AS median, u AS high,
    CAST(least(u, floor(u * 2 * CASE WHEN pct > 0 THEN pct END) / 100) AS DECIMAL(18,2)) AS capped,
    round(least(greatest(u::DOUBLE - 500, 0), least(least(u::DOUBLE * 2, u::DOUBLE), 5000)), 2) AS a_low, round(least(u::DOUBLE * 1.1, least(u::DOUBLE * 1.2, 5000)), 2) AS a_mid, round(least(u::DOUBLE * 1.2, 5000), 2) AS a_high
FROM h""")  # fmt: skip
def r8_r9_r10_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.abs("c_acctbal").cast(CENTS)
    pct = F.when(F.col("c_custkey") % 40 > 0, F.col("c_custkey") % 40)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), u.alias("u"), pct.alias("pct"))
    low, median, high = P.estimate_range(F.col("u"))
    d = F.col("u").cast("double")
    a_low, a_mid, a_high = P.clamped_range(d - 500, d * 1.1, d * 1.2, F.lit(5000.0))
    return rows.select("case_id", low.alias("low"), median.alias("median"), high.alias("high"),
                       P.capped_advance(F.col("u"), F.col("u") * 2, F.col("pct")).alias("capped"), a_low.alias("a_low"), a_mid.alias("a_mid"), a_high.alias("a_high"))


# ---- Statement files and exports ----------------------------------------------------------------------------------------------


def _statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement file for each account, oldest row first; texts with quotes, commas and line breaks; the flaw of a file depends on
    its account's number: 1 a wrong balance, 2 wrong totals, 3 a wrong closing balance, 4 a row of both sides, 5 a second currency."""
    k = F.element_at(F.split("account_id", ":"), 2).cast("long")
    rows = orders_ledger(spark, sf_dir).withColumn("source_file", F.concat(k.cast("string"), F.lit(".csv")))
    account = Window.partitionBy("source_file")
    by_time = account.orderBy("date", "id")
    total = lambda side: F.coalesce(F.sum(F.when(F.col("tx_type") == side, F.col("amount"))).over(account), F.lit(0).cast(CENTS))
    move = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    own = rows.withColumns({
        "k": k % 7, "seq": F.row_number().over(by_time), "shown": F.sum(move).over(by_time.rowsBetween(Window.unboundedPreceding, 0)), "closing": F.sum(move).over(account),
        "out": total("debit"), "in": total("credit"), "period_start": F.min("date").over(account), "period_end": F.max("date").over(account),
    })
    flaw = lambda kind, when=F.lit(True): F.when((F.col("k") == kind) & when, 1).otherwise(0)
    text = lambda c: c.cast(CENTS).cast("string")
    side = lambda name: F.when((F.col("tx_type") == name) | ((F.col("k") == 4) & (F.col("seq") == 1)), text(F.col("amount"))).otherwise("")
    other = F.when((F.col("k") == 5) & (F.col("seq") == 2), F.when(F.col("currency") == "CAD", "USD").otherwise("CAD")).otherwise(F.col("currency"))
    return own.select(
        "source_file", "seq", "account_id", other.alias("currency"),
        F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), F.lit("0.00").alias("opening_balance"),
        text(F.col("closing") + flaw(3)).alias("closing_balance"), text(F.col("out") + flaw(2)).alias("expected_debits"), text(F.col("in")).alias("expected_credits"),
        F.col("date").cast("string").alias("date"),
        F.when(F.col("id") % 5 == 0, F.concat("description", F.lit(' "quoted",\nsecond line'))).otherwise(F.col("description")).alias("description"),
        side("debit").alias("debit"), side("credit").alias("credit"), text(F.col("shown") + flaw(1, F.col("seq") == 2)).alias("balance"),
    )


@query("s1_s10_statement_files", over_orders(""", own AS (
    SELECT *, number % 7 AS k, row_number() OVER (PARTITION BY number ORDER BY date, id) AS s, count(*) OVER (PARTITION BY number) AS n FROM ledger
), files AS (
    SELECT number, k, count(*) AS n, coalesce(sum(amount) FILTER (WHERE tx_type = 'debit'), 0) AS debits, coalesce(sum(amount) FILTER (WHERE tx_type = 'credit'), 0) AS credits,
        sum(move) + CASE WHEN k = 1 AND count(*) = 2 THEN 1 ELSE 0 END AS last, sum(length(description) + CASE WHEN id % 5 = 0 THEN 22 ELSE 0 END) AS letters FROM own GROUP BY number, k
), judged AS (
    SELECT *, k = 4 OR (k = 5 AND n > 1) AS rejected FROM files
)
SELECT number, rejected, CASE WHEN NOT rejected THEN n END::BIGINT AS transactions, CASE WHEN NOT rejected THEN debits END::DECIMAL(18,2) AS debits,
    CASE WHEN NOT rejected THEN credits END::DECIMAL(18,2) AS credits, CASE WHEN NOT rejected THEN last END::DECIMAL(18,2) AS last_balance,
    CASE WHEN NOT rejected THEN letters END::BIGINT AS letters, CASE WHEN rejected THEN '' WHEN k = 1 AND n > 2 THEN 'balance_mismatch,balance_mismatch'
        WHEN k = 1 AND n = 2 THEN 'balance_mismatch,closing_differs' WHEN k = 2 THEN 'totals_differ' WHEN k = 3 THEN 'closing_differs' ELSE '' END AS findings FROM judged"""))  # fmt: skip
def s1_s10_statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written as files by the format `statement_csv`, read again by it and verified: a row for each file."""
    spark.dataSource.register(StatementCsv)
    folder = f"{shared_folder(spark)}/statements-{uuid.uuid4().hex}"
    rows = _statement_rows(spark, sf_dir).sortWithinPartitions("source_file", "seq")  # windows over files have dealt them
    rows.write.format("statement_csv").mode("append").save(folder)
    statements, transactions, findings, rejects = V.verified_statements(spark.read.format("statement_csv").load(folder))
    number = F.regexp_extract("source_file", r"(\d+)\.csv$", 1).cast("long")
    own = transactions.groupBy("source_file").agg(F.count("*").alias("transactions"), F.sum(F.length("description")).alias("letters"))
    codes = findings.groupBy("source_file").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("findings"))
    read = statements.join(own, "source_file").join(codes, "source_file", "left").select(
        number.alias("number"), F.lit(False).alias("rejected"), "transactions", "debits", "credits", "last_balance", "letters", F.coalesce("findings", F.lit("")).alias("findings")
    )
    return read.unionByName(rejects.select(number.alias("number"), F.lit(True).alias("rejected"), F.lit("").alias("findings")), allowMissingColumns=True)


@query("s10_exports", over_orders("""
SELECT export, case_id, count(*) AS rows, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM (
    SELECT 'ledger' AS export, case_id, amount FROM ledger
    UNION ALL SELECT 'advances', case_id, amount FROM ledger WHERE tx_type = 'debit'
    UNION ALL SELECT 'decision_memo', case_id, max(amount) FROM ledger GROUP BY case_id) GROUP BY ALL"""))  # fmt: skip
def s10_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the named exports of a portfolio, written by case and read again."""
    rows = orders_ledger(spark, sf_dir).select("case_id", "id", "tx_type", "amount")
    frames = {"ledger": rows, "advances": rows.where("tx_type = 'debit'"), "decision_memo": rows.groupBy("case_id").agg(F.max("amount").alias("amount"))}
    paths = V.write_exports(frames, f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}")
    kinds = "case_id long, id long, tx_type string, amount decimal(18,2)"
    read = lambda i, kind, schema: spark.read.schema(schema).option("header", True).format(kind).load(paths[i])
    memo = read(2, "json", "case_id long, memo string").select("case_id", F.from_json("memo", "amount decimal(18,2)").alias("m")).select("case_id", "m.amount")
    parts = [(read(0, "json", kinds), "ledger"), (read(1, "csv", kinds), "advances"), (memo, "decision_memo")]
    shown = [df.groupBy("case_id").agg(F.count("*").alias("rows"), F.sum("amount").cast(CENTS).alias("amount")).withColumn("export", F.lit(name)) for df, name in parts]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


# ---- The decision run ---------------------------------------------------------------------------------------------------------
#
# Every case differs by its number k: pending deposits are decided but for k % 5 = 4, amounts are small for k % 7 = 6, the opening
# balances of k % 11 = 10 are unknown, and what people stated and confirmed depends on k as well.

_FACTS = {
    "industry": "CASE WHEN k % 9 <> 8 THEN list_extract(['{}', '{}', 'none'], (k % 3 + 1)::INT) END".format(*sorted(P.rules.INDUSTRIES)[:2]),
    "credit": "CASE WHEN k % 4 <> 1 THEN 500 + k * 13 % 350 END",
}


def _decision_ledger(spark: SparkSession, sf_dir: str, keyed: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    k = F.col("case_id")
    rows = keyed(orders_ledger(spark, sf_dir)).withColumn("amount", F.when(k % 7 == 6, 1 + F.col("id") % 50).otherwise(F.col("amount")).cast(CENTS))
    own = K.classify_local(K.classify(rows)).withColumn("statement_period_start", F.trunc("date", "month"))
    late = (k % 6 == 5) & (F.col("description") == "RENT")
    decided = (k % 5 != 4) & (F.col("revenue_status") == P.rules.REVIEW)
    return own.withColumns({
        "description": F.when(late, F.lit("RENT PAST DUE")).otherwise(F.col("description")),
        "revenue_status": F.when(decided, F.lit(P.rules.NON)).otherwise(F.col("revenue_status")),
    })


def _decision_statements(spark: SparkSession, sf_dir: str, keyed: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    k, bad = F.col("case_id"), (F.col("stmt_ord") % 17 == 3) & (F.col("case_id") % 3 == 1)
    return keyed(orders_statements(spark, sf_dir)).withColumns({
        "opening": F.when(k % 11 != 10, F.col("opening")), "rate": F.lit(1).cast("decimal(18,6)"),
        "status": F.when(bad, F.lit("review_required")).otherwise(F.lit(X.ALLOWED_STATUSES[0])),
        "extraction_method": F.when(F.col("stmt_ord") % 29 == 0, F.lit(X.READ_BY_MODEL[0])).otherwise(F.lit("text")),
    })


def _schedule_of(ledger: DataFrame) -> DataFrame:
    """A position for every group of payments: those of BIZFUND in even cases are no debt, every fourth case isn't verified."""
    k = F.col("case_id")
    groups = D.debt_payments(ledger).groupBy("case_id", "account_id", "lender", F.col("reference").alias("contract")).agg(F.first("tier").alias("tier"))
    no = (F.col("lender") == "BIZFUND") & (k % 2 == 0)
    return groups.select(
        F.concat_ws("/", "account_id", "lender", "contract").alias("position_id"), "case_id", "account_id", "lender", "contract", F.lit("").alias("reference"),
        F.when(F.col("tier").isin("Premium", "Standard"), "MCA").otherwise("Other debt").alias("kind"), F.when(no, "Not debt").otherwise("Active").alias("status"),
        F.lit("Monthly").alias("frequency"), (100 + F.element_at(F.split("account_id", ":"), 2).cast("long") * 10).cast(CENTS).alias("payment"),
        (k % 4 != 1).alias("verified"), F.array().cast("array<struct<id: bigint>>").alias("evidence"),
    )


def _decision_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Everything that a decision run rests on."""
    ledger, statements = written(_decision_ledger(spark, sf_dir)), kept_by(_decision_statements(spark, sf_dir))
    spans = kept_by(C.covered_spans(statements))
    months = kept_by(C.coverage_summary(spans, C.offer_months(statements, spans)))
    k = F.col("case_id")
    positions = kept_by(_schedule_of(ledger))
    inputs = kept_by(X.underwriting_inputs(ledger, statements, months, positions, covered=spans))
    findings = statements.where("status = 'review_required'").select("case_id", "stmt_id", F.when(k % 13 == 7, "Suspected manipulation of text").otherwise("Totals differ").alias("code"))
    names = sorted(P.rules.INDUSTRIES)[:2]
    signed = X.data_signature(ledger, statements)
    cases = signed.select(
        "case_id", F.when(k % 9 != 8, F.element_at(F.array(*map(F.lit, [*names, "none"])), (k % 3 + 1).cast("int"))).alias("industry"),
        (6 + k * 7 % 100).alias("months_in_business"), F.element_at(F.array(*map(F.lit, P.RECORDS)), (k % 4 + 1).cast("int")).alias("public_records"),
        F.element_at(F.array(*map(F.lit, P.VERIFICATION)), (F.floor(k / 2) % 4 + 1).cast("int")).alias("bank_verification"),
        F.when(k % 4 != 1, 500 + k * 13 % 350).alias("credit_score"), (k % 2 == 0).alias("extraction_confirmed"), (k % 5 != 3).alias("pages_reviewed"),
        (k % 4 != 2).alias("coverage_acknowledged"), (k % 3 != 1).alias("integrity_reviewed"), F.when(k % 6 != 0, "letter 7").otherwise(" ").alias("integrity_note"),
        (k % 6 != 4).alias("compared"), (k % 8 != 5).alias("complete"), F.when(k % 3 == 0, F.col("signature")).when(k % 3 == 1, F.lit("of other data")).alias("override_signature"),
        (3 + k % 7).cast("int").alias("repayment_term"), F.lit(None).cast("decimal(6,4)").alias("repayment_factor"), F.when(k % 3 == 2, 40).cast("decimal(6,2)").alias("advance_pct_revenue"),
    )
    flags = cases.where("case_id % 2 = 1").select("case_id", F.when(k % 4 == 1, "page").otherwise("integrity").alias("kind"))
    return {"ledger": ledger, "statements": statements, "inputs": inputs, "findings": findings, "cases": kept_by(cases), "flags": flags}


_INPUTS = f"""{_OFFER}, dl AS (
    SELECT l.* REPLACE (CASE WHEN case_id % 7 = 6 THEN CAST(1 + id % 50 AS DECIMAL(18,2)) ELSE amount END AS amount,
        CASE WHEN case_id % 6 = 5 AND description = 'RENT' THEN 'RENT PAST DUE' ELSE description END AS description,
        CASE WHEN case_id % 5 <> 4 AND revenue_status = 'Review Required' THEN 'Non-Revenue' ELSE revenue_status END AS revenue_status) FROM ledger l
), m AS (
    SELECT c.case_id, c.month, c.covered_days / c.calendar_days AS f, c.covered_days = c.calendar_days AS whole FROM coverage c
    JOIN offer o ON o.case_id = c.case_id AND o.month = c.month
), rows AS (
    SELECT l.*, l.tx_type = 'debit' AND lender IS NOT NULL AND NOT (lender = 'BIZFUND' AND l.case_id % 2 = 0) AS debt
    FROM dl l JOIN covered d ON d.case_id = l.case_id AND d.day = l.date JOIN m ON m.case_id = l.case_id AND m.month = l.month
), sums AS (
    SELECT m.case_id, m.month, m.f, m.whole, (SELECT coalesce(sum(amount), 0)::DOUBLE FROM rows r WHERE r.case_id = m.case_id AND r.month = m.month AND r.tx_type = 'debit' AND NOT debt) / m.f AS o,
        (SELECT coalesce(sum(amount), 0)::DOUBLE FROM rows r WHERE r.case_id = m.case_id AND r.month = m.month AND revenue_status = 'True Revenue') / m.f AS v,
        (SELECT count(*) FROM rows r WHERE r.case_id = m.case_id AND r.month = m.month AND revenue_status = 'True Revenue') / m.f AS n FROM m
), averages AS (
    SELECT case_id, avg(o) AS o, avg(v) AS r, avg(n) AS n, count(*) AS months, bool_and(whole) AS whole, stddev_pop(v) AS sd, min_by(v, month) AS v1, max_by(v, month) AS v2 FROM sums GROUP BY 1
), payers AS (
    SELECT case_id, max(x)::DOUBLE / sum(x)::DOUBLE * 100 AS con FROM (SELECT case_id, description, sum(amount) AS x FROM rows WHERE revenue_status = 'True Revenue' GROUP BY ALL) GROUP BY 1
), moves AS (
    SELECT account_id, date, sum(CASE WHEN tx_type = 'credit' THEN amount ELSE -amount END) AS net FROM dl GROUP BY ALL
), rolled AS (
    SELECT s.case_id, s.day, s.opening + sum(coalesce(net, 0)) OVER (PARTITION BY s.stmt_id ORDER BY s.day) AS v FROM (
        SELECT case_id, account_id, stmt_id, opening, unnest(generate_series(period_start, period_end, INTERVAL 1 DAY))::DATE AS day FROM statements) s
    LEFT JOIN moves ON moves.account_id = s.account_id AND moves.date = s.day
), balances AS (
    SELECT case_id, round(avg(total)::DOUBLE, 2) AS adb, count(*) FILTER (WHERE below) AS negative FROM (
        SELECT r.case_id, r.day, sum(v) AS total, bool_or(v < 0) AS below FROM rolled r JOIN covered d ON d.case_id = r.case_id AND d.day = r.day
        JOIN m ON m.case_id = r.case_id AND m.month = strftime(r.day, '%Y-%m') WHERE r.case_id % 11 <> 10 GROUP BY 1, 2) GROUP BY 1
), positions AS (
    SELECT case_id, 100 + number * 10 AS pay, tier IN ('Premium', 'Standard') AS mca, lender = 'BIZFUND' AND case_id % 2 = 0 AS no_debt, case_id % 4 <> 1 AS verified
    FROM (SELECT DISTINCT case_id, number, lender, reference, tier FROM ledger WHERE tx_type = 'debit' AND lender IS NOT NULL)
), debts AS (
    SELECT case_id, coalesce(sum(pay) FILTER (WHERE verified AND NOT no_debt), 0)::DOUBLE AS debt, count(*) FILTER (WHERE verified AND NOT no_debt AND mca) AS mca,
        count(*) FILTER (WHERE NOT verified) AS unverified FROM positions GROUP BY 1
), inputs AS (
    SELECT DISTINCT s.case_id, coalesce(a.r, 0) AS r, coalesce(a.n, 0) AS n, round(coalesce(a.o, 0), 2) AS o, coalesce(a.months, 0) AS months, a.whole, b.adb, b.negative, coalesce(d.debt, 0) AS debt,
        coalesce(d.mca, 0) AS mca, coalesce(d.unverified, 0) AS unverified, CASE WHEN a.whole AND a.months > 1 AND a.r > 0 THEN sd / a.r * 100 END AS v,
        CASE WHEN a.whole AND a.months > 1 AND v1 > 0 THEN (v2 - v1) / v1 * 100 END AS t, coalesce(con, 0) AS con,
        (SELECT count(DISTINCT lender) FROM rows x WHERE x.case_id = s.case_id AND debt AND lender IN ('GREENBOX', 'BIZFUND', 'BDC')) AS len,
        (SELECT count(*) FROM dl x WHERE x.case_id = s.case_id AND description IN ('Cheque returned NSF', 'RETURNED ITEM CREDIT')) AS ret,
        (SELECT count(*) FROM dl x WHERE x.case_id = s.case_id AND description = 'NSF item fee 3 @ $45.00') AS fees
    FROM (SELECT DISTINCT case_id FROM statements) s LEFT JOIN averages a ON a.case_id = s.case_id LEFT JOIN balances b ON b.case_id = s.case_id LEFT JOIN debts d ON d.case_id = s.case_id
    LEFT JOIN payers p ON p.case_id = s.case_id
)"""


@query("a11_decision_inputs", over_orders(f"""{_INPUTS}
SELECT case_id, round(r, 4) AS revenue, o AS operating_outflows, debt AS monthly_debt, len AS lenders, ret AS returned, adb AS average_daily_balance, negative AS negative_days,
    mca AS mca_positions, unverified, CASE len WHEN 0 THEN '0 in 90 Days' WHEN 1 THEN '1 in 90 Days' ELSE '2+ in 90 Days' END AS velocity FROM inputs""", recursive=True))  # fmt: skip
def a11_decision_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decision_frames(spark, sf_dir)["inputs"].select(
        "case_id", F.round("revenue", 4).alias("revenue"), "operating_outflows", "monthly_debt", "lenders", "returned", "average_daily_balance", "negative_days",
        "mca_positions", "unverified", "velocity",
    )


@query("a7_account_figures", over_orders(f"""{_INPUTS}
SELECT case_id AS account_number, months, round(r, 4) AS revenue, o AS operating_outflows, adb AS average_daily_balance, negative AS negative_days FROM inputs""", recursive=True)
    .replace("o_custkey // 500 * 5 + o_custkey % 5 AS case_id", "o_custkey // 500 * 20 + o_custkey % 20 AS case_id"))
def a7_account_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account by itself, over its own available months: the same measures, with the account in place of the case."""
    own = lambda df: df.withColumn("case_id", F.element_at(F.split("account_id", ":"), 2).cast("long"))
    return X.account_figures(_decision_ledger(spark, sf_dir, own), _decision_statements(spark, sf_dir, own), _schedule_of).select(
        F.col("case_id").alias("account_number"), "months", F.round("revenue", 4).alias("revenue"), "operating_outflows", "average_daily_balance", "negative_days"
    )


_GATES = f"""{_INPUTS}, k AS (
    SELECT i.*, i.case_id AS k, i.case_id % 3 = 0 AS waived, {_FACTS["industry"]} AS industry, (i.case_id // 2) % 4 AS u,
        (SELECT count(*) FROM statements s WHERE s.case_id = i.case_id AND stmt_ord % 17 = 3 AND i.case_id % 3 = 1) AS bad,
        (SELECT count(*) FROM statements s WHERE s.case_id = i.case_id AND stmt_ord % 29 = 0) AS by_model,
        (SELECT count(*) FROM dl x WHERE x.case_id = i.case_id AND revenue_status = 'Review Required') AS pending,
        (SELECT count(*) FROM dl x WHERE x.case_id = i.case_id AND description = 'RENT PAST DUE') AS late FROM inputs i
), gates AS (
    SELECT k AS case_id, gate FROM (
        SELECT k, unnest([CASE WHEN NOT waived AND bad > 0 THEN 'statement_issues' END, CASE WHEN NOT waived AND bad > 0 THEN 'disallowed_status' END,
            CASE WHEN NOT waived AND by_model > 0 AND k % 2 = 1 THEN 'extraction_unconfirmed' END, CASE WHEN pending > 0 THEN 'pending_deposits' END,
            CASE WHEN months = 0 THEN 'no_common_months' END, CASE WHEN unverified > 0 THEN 'debt_unverified' END, CASE WHEN NOT waived AND adb IS NULL THEN 'no_daily_balances' END,
            CASE WHEN NOT waived AND fees > 0 AND ret = 0 THEN 'fees_without_returns' END, CASE WHEN industry IS NULL THEN 'inputs_incomplete' END,
            CASE WHEN NOT waived AND k % 4 = 1 AND k % 5 = 3 THEN 'pages_unreviewed' END, CASE WHEN NOT waived AND months > 0 AND NOT whole AND k % 4 = 2 THEN 'coverage_unacknowledged' END,
            CASE WHEN NOT waived AND k % 4 = 3 AND (k % 3 = 1 OR k % 6 = 0) THEN 'integrity_unreviewed' END, CASE WHEN k % 8 = 5 THEN 'completeness_unconfirmed' END,
            CASE WHEN NOT waived AND k % 6 = 4 THEN 'originals_not_compared' END,
            CASE WHEN NOT waived AND (late > 0 OR u = 3 OR (bad > 0 AND k % 13 = 7)) THEN 'hard_stop' END, CASE WHEN r < 10000 THEN 'revenue_below_minimum' END]) AS gate FROM k)
    WHERE gate IS NOT NULL
)"""


@query("v6_gates", over_orders(f"""{_GATES}
SELECT g.case_id, gate, CASE gate WHEN 'statement_issues' THEN bad ELSE 1 END AS details FROM gates g JOIN k ON k.case_id = g.case_id""", recursive=True))
def v6_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decision_frames(spark, sf_dir)
    found = X.gate_findings(d["cases"], d["ledger"], d["statements"], d["findings"], d["inputs"], d["flags"])
    return found.groupBy("case_id", "gate").agg(F.count("*").alias("details"))


@query("r11_decision_run", over_orders(f"""{_GATES}, ind(i, name, points, season) AS (VALUES {_INDUSTRY_ROWS}), c AS (
    SELECT k.*, k.debt / r * 100 AS b, k.mca AS pos, 6 + k * 7 % 100 AS mon, {_FACTS["credit"]} AS cr, k % 4 AS q,
        CASE WHEN r > 0 THEN (r - o - debt) / r * 100 END AS margin, ind.points, ind.season FROM k LEFT JOIN ind ON ind.name = k.industry
), {_POINTS.replace("FROM c LEFT JOIN ind ON ind.i = c.ind", "FROM c")}
), ranked AS (
    SELECT c.k, c.r, c.mca, t.score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 82 THEN 'A' WHEN score >= 74 THEN 'B' WHEN score >= 66 THEN 'C' WHEN score >= 58 THEN 'D' WHEN score IS NOT NULL THEN 'E' END AS grade,
        CASE WHEN score >= 90 THEN 100 WHEN score >= 82 THEN 85 WHEN score >= 74 THEN 70 WHEN score >= 66 THEN 55 WHEN score >= 58 THEN 35 WHEN score IS NOT NULL THEN 0 END AS pct,
        CASE c.mca WHEN 0 THEN 5 ELSE 3 END AS lo, CASE c.mca WHEN 0 THEN 8 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 4 END AS hi FROM c JOIN total t ON t.case_id = c.k
    WHERE c.k NOT IN (SELECT case_id FROM gates)
), amounts AS (
    SELECT *, floor(CAST(r AS DECIMAL(18,2)) * pct) / 100 AS multiple, CASE WHEN k % 3 = 2 THEN floor(CAST(r AS DECIMAL(18,2)) * 40) / 100 END AS cap FROM ranked
), ends AS (
    SELECT *, CAST(CASE WHEN score IS NOT NULL THEN least(multiple, coalesce(cap, multiple)) END AS DECIMAL(18,2)) AS high FROM amounts
)
SELECT i.case_id, (SELECT count(*) FROM gates g WHERE g.case_id = i.case_id) > 0 AS blocked, coalesce((SELECT string_agg(gate, ',' ORDER BY gate) FROM gates g WHERE g.case_id = i.case_id), '') AS gates,
    score, grade, mca + 1 AS funding_position, greatest(lo, least(hi, 3 + k % 7)) AS term, CASE WHEN k IS NOT NULL AND score IS NULL THEN 'no score' END AS problem,
    CAST(floor(high * 85) / 100 AS DECIMAL(18,2)) AS low, high FROM (SELECT case_id FROM inputs) i LEFT JOIN ends ON ends.k = i.case_id""", recursive=True))  # fmt: skip
def r11_decision_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decision_frames(spark, sf_dir)
    gates = kept_by(X.gate_findings(d["cases"], d["ledger"], d["statements"], d["findings"], d["inputs"], d["flags"]))
    out = X.decision_run(d["cases"], d["inputs"], gates)
    return out.select(
        "case_id", "blocked", F.array_join("gates", ",").alias("gates"), "score", "grade", "funding_position", "term", "problem", "low", "high"
    )
