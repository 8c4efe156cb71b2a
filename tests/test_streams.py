"""Payment streams: the assignment of a day against a plain one, and walks over ranges that borders cut anywhere."""

import random
import time
from datetime import date, timedelta
from decimal import Decimal

from ledgerloom.operators import debt, streams
from pyspark.sql import functions as F

PAYMENTS = "case_id long, account_id string, lender string, reference string, date date, id long, amount decimal(18,2), seq long, stream_note string"


def plain_day(anchors, amounts):
    free, left, out = list(range(len(anchors))), list(range(len(amounts))), [None] * len(amounts)
    while left:
        _, s, p = min((abs(amounts[p] - anchors[s]), s, p) for s in free or range(len(anchors)) for p in left)
        out[p], anchors[s] = s, amounts[p]
        left.remove(p)
        free = [x for x in free if x != s]
    return out


def test_a_day_is_assigned_as_by_comparing_all_pairs(monkeypatch):
    rng = random.Random(0)
    for few in (0, 36):
        monkeypatch.setattr(streams, "FEW", few)
        for _ in range(3000):
            most = rng.choice([2, 5, 20, 1000])
            anchors = [rng.randint(0, most) for _ in range(rng.randint(1, 6))]
            amounts = [rng.randint(0, most) for _ in range(rng.randint(0, 9))]
            own, other = list(anchors), list(anchors)
            assert streams.assign_day(own, amounts) == plain_day(other, amounts) and own == other


def test_a_day_of_many_payments_ends_in_seconds():
    began = time.time()
    for kind in (lambda i: i * 7919 % 100_003, lambda i: 5, lambda i: i, lambda i: i % 2 * 1_000_000 + i):
        anchors = [kind(i + 1) for i in range(2000)]
        assert len(set(streams.assign_day(anchors, [kind(i) for i in range(2000)]))) == 2000
    assert time.time() - began < 20


def plain_streams(rows):
    """{id: stream} of one group's rows (date, id, amount, seq)."""
    days = {}
    for day, i, amount, seq in rows:
        days.setdefault(day, []).append((seq, i, int((amount or 0) * 100)))
    if None in days:
        return {r[1]: 1 for r in rows}
    last = sorted(days, reverse=True)[:6]
    for n in {len(days[d]) for d in last} - {1}:
        full = [d for d in last if len(days[d]) == n]
        if len(full) >= 3 and len(full) >= 0.6 * len(last):
            anchors, out = sorted(a for _, _, a in days[full[0]]), {}
            for d in sorted(days, reverse=True):
                own = sorted(days[d])
                for (_, i, _), s in zip(own, plain_day(anchors, [a for _, _, a in own]), strict=True):
                    out[i] = s + 1
            return out
    return {r[1]: 1 for r in rows}


def test_walks_over_any_ranges_are_those_of_whole_groups(spark, monkeypatch):
    rng = random.Random(3)
    groups, at = {}, 0
    for g in range(12):
        rows, usual = [], rng.choice([1, 2, 2, 3])
        for d in range(rng.choice([2, 8, 30])):
            for _ in range(usual if rng.random() < 0.9 else rng.randint(1, 4)):
                rows.append((date(2024, 1, 1) + timedelta(d), at, None if rng.random() < 0.01 else Decimal(rng.randint(1, 9) * 25), at))
                at += 1
        if g == 5:
            rows.append((None, at, Decimal(1), at))
            at += 1
        groups["L" if g else 'quote " and \\', g] = rows
    want = {i: s for rows in groups.values() for i, s in plain_streams(rows).items()}
    assert {2, 3} <= set(want.values())
    df = spark.createDataFrame([(1, f"a{g}", name, None if g == 7 else "", *r, "own") for (name, g), rows in groups.items() for r in rows], PAYMENTS)
    want |= {r[1]: 1 for r in groups["L", 7]}  # a part of the key is missing
    plain = streams.walk_streams
    for most in (10**6, 60):
        monkeypatch.setattr(debt, "walk_streams", lambda p, s, g, most=most: plain(p, s, g, most))
        out = debt.concurrent_streams(df.repartition(3))
        assert out.columns == [*df.columns, "stream"]
        got = {r.id: r.stream for r in out.collect()}
        assert out.count() == len(want) and got == want


def test_no_payments_and_no_groups(spark):
    none = spark.createDataFrame([], PAYMENTS)
    assert debt.concurrent_streams(none).count() == 0
    lone = spark.createDataFrame([(1, "a", "L", "", date(2024, 1, 1), 1, Decimal(5), 1, "x")], PAYMENTS)
    assert [r.stream for r in debt.concurrent_streams(lone).collect()] == [1]


def test_evidence_has_a_row_for_each_payment(spark):
    kind = "case_id long, account_id string, id long, date date, month string, tx_type string, amount decimal(18,2), description string, seq long"
    rows = [(1, "a", i, date(2026, 1, 1) + timedelta(i // 2), "2026-01", "debit", Decimal(10 + 40 * (i % 2)), "GREENBOX CAPITAL", i) for i in range(12)]
    seeded = debt.seeded_payments(spark.createDataFrame(rows, kind))
    evidence, positions = debt.position_evidence(seeded), debt.positions_of(seeded)
    sums = {r.position_id: (r.n, r.total) for r in evidence.groupBy("position_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total")).collect()}
    assert {r.position_id: (r.observed_payments, r.observed_total) for r in positions.collect()} == sums and len(sums) == 2
