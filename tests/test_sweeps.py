"""Advances by running sums and overlaps by months, against all pairs; layout routes over several pages."""

import random
import time
from datetime import date, timedelta
from decimal import Decimal

from ledgerloom.operators import debt, documents, ledger
from pyspark.sql import functions as F

LEDGER = "case_id long, account_id string, currency string, id long, date date, tx_type string, amount decimal(18,2), description string"


def test_payments_on_or_after_each_advance(spark):
    rng = random.Random(9)
    names = ["GREENBOX", "BIZFUND"]
    rows = [
        (1, rng.choice("abc"), "CAD", i, None if rng.random() < 0.05 else date(2026, 1, 1) + timedelta(rng.randint(0, 20)), rng.choice(["debit", "debit", "credit"]),
         Decimal(rng.randint(1, 50)), rng.choice(names)) for i in range(300)
    ] + [(2, "a", "CAD", 1000 + i, date(2026, 1, 1 + i), "debit", Decimal(7), "BIZFUND") for i in range(3)]
    groups = {(r[0], r[1], r[7]) for r in rows}
    want = {}
    for g in groups:
        own = [r for r in rows if (r[0], r[1], r[7]) == g]
        for a in [r for r in own if r[5] == "credit"] or [None]:
            since = None if a is None else a[4]
            paid = [r for r in own if r[5] == "debit" and r[4] is not None and (since is None or r[4] >= since)]
            want[(*g, a and a[3])] = (sum(r[6] for r in paid), len(paid), max((r[4] for r in paid), default=None))
    got = debt.advances(spark.createDataFrame(rows, LEDGER).repartition(3)).collect()
    assert {(r.case_id, r.account_id, r.lender, r.advance_id): (r.observed, r.payments, r.last_payment) for r in got} == want and len(got) == len(want)


def test_many_advances_and_payments_of_one_lender(spark):
    i = F.col("id")
    rows = spark.range(60_000).select(
        F.lit(1).cast("long").alias("case_id"), F.lit("a").alias("account_id"), F.lit("CAD").alias("currency"), "id", F.date_add(F.lit("2020-01-01").cast("date"), (i / 30).cast("int")).alias("date"),
        F.when(i % 12 == 0, "credit").otherwise("debit").alias("tx_type"), F.lit(5).cast("decimal(18,2)").alias("amount"), F.lit("GREENBOX").alias("description"),
    )
    began = time.time()
    out = debt.advances(rows)
    assert out.agg(F.count("*"), F.max("payments"), F.min("payments")).first()[:] == (5000, 55_000, 28)  # the last day has 30 rows, two of them advances
    assert time.time() - began < 60


PERIODS = "case_id long, account_id string, stmt_id string, stmt_ord int, period_start date, period_end date"


def test_overlapping_periods_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        start = date(2024, 1, 1) + timedelta(rng.randint(0, 700))
        rows.append((i % 4, rng.choice(["a", "b", None]), f"s{i}", i, start, start + timedelta(rng.choice([-1, 0, 14, 30, 31, 90, 400, 5000]))))
    rows += [(9, "a", "x", 1, date(2024, 1, 1), date(2024, 1, 31)), (9, "a", "y", 2, date(2024, 1, 31), date(2024, 2, 29)), (9, "a", "z", 3, date(2024, 1, 31), date(2024, 1, 31))]
    want = set()
    for a in rows:
        for b in rows:
            touch = a[4] != b[4] and (a[5] == b[4] or b[5] == a[4])
            if a[:2] == b[:2] and a[1] and a[3] < b[3] and a[4] <= a[5] and b[4] <= b[5] and a[4] <= b[5] and b[4] <= a[5] and not touch:
                want.add((a[2], b[2]))
    got = [(r.stmt_id, r.other_id) for r in ledger.overlapping_periods(spark.createDataFrame(rows, PERIODS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("y", "z") in want and ("x", "y") not in want


def test_an_account_of_many_statements(spark):
    i = F.col("id")
    day = F.date_add(F.lit("1900-01-01").cast("date"), (i / 2).cast("int"))
    rows = spark.range(40_000).select(F.lit(1).alias("case_id"), F.lit("a").alias("account_id"), i.cast("string").alias("stmt_id"), i.cast("int").alias("stmt_ord"),
                                      day.alias("period_start"), day.alias("period_end"))
    began = time.time()
    assert ledger.overlapping_periods(rows).count() == 20_000 and time.time() - began < 60


def test_a_route_may_rest_on_any_page(spark):
    first = "Business Account 12345 67890 12\nAccount Summary for this Period"
    rows = spark.createDataFrame([(1, [first, "The Bank of Nova Scotia"]), (2, [first, "another"]), (3, [first + " Scotiabank"]), (4, [None, "x"]), (5, [first, None])], "doc_id int, pages array<string>")
    got = {r.doc_id: r.layout for r in rows.select("doc_id", documents.routed(F.get("pages", F.lit(0)), pages=F.col("pages")).alias("layout")).collect()}
    assert got == {1: "scotia", 2: "unsupported", 3: "scotia", 4: "image_only", 5: "unsupported"}
