"""Coverage by interval sweeps against sets of days, and plans over tables kept by case."""

import random
from datetime import date, timedelta

from ledgerloom.lineage import kept_by
from ledgerloom.operators import coverage

PERIODS = "case_id long, account_id string, stmt_id string, period_start date, period_end date"


def random_periods(seed, cases=40):
    rng = random.Random(seed)
    rows = []
    for c in range(cases):
        for a in range(rng.randint(1, 3)):
            day = date(2024, 1, 1) + timedelta(rng.choice([0, 0, 5]))
            for s in range(rng.randint(1, 8)):
                end = day + timedelta(rng.choice([0, 20, 29, 30, 31, 60]))
                rows.append((c, f"a{a}", f"{c}/{a}/{s}", day, end))
                day = end + timedelta(rng.choice([1, 1, 1, 0, -3, 4]))  # adjoining, touching, overlapping, apart
        if c % 11 == 5:
            rows.append((c, *rng.choice([(None, "n", day, day), ("a0", "n", day, day - timedelta(1)), ("a0", "n", None, day)])))
    return rows


def days_of(rows):
    """{case: days that all its accounts cover}; a flawed statement empties its case."""
    by = {}
    for c, a, _, s, e in rows:
        ok = a is not None and s is not None and s <= e
        by.setdefault(c, {}).setdefault(a if ok else None, set()).update({s + timedelta(i) for i in range((e - s).days + 1)} if ok else ())
    return {c: set() if None in accounts else set.intersection(*accounts.values()) for c, accounts in by.items()}


def test_swept_spans_are_the_days_of_all_accounts(spark):
    rows = random_periods(1)
    st = spark.createDataFrame(rows, PERIODS)
    spans = coverage.covered_spans(st).collect()
    got = {}
    for r in spans:
        days = {r.start + timedelta(i) for i in range((r.end - r.start).days + 1)}
        assert days and not days & got.get(r.case_id, set())
        got[r.case_id] = got.get(r.case_id, set()) | days
    want = {c: d for c, d in days_of(rows).items() if d}
    assert got == want
    assert {(r.case_id, r.day) for r in coverage.covered_days(st).collect()} == {(c, d) for c, days in want.items() for d in days}
    by_days = coverage.coverage_summary(coverage.covered_days(st))
    by_spans = coverage.coverage_summary(coverage.covered_spans(st))
    assert sorted(by_days.collect()) == sorted(by_spans.collect())


def plain_offer(rows):
    def run(months):
        if not months:
            return []
        number = lambda m: int(m[:4]) * 12 + int(m[5:])
        last = [months[-1]]
        for m in reversed(months[:-1]):
            if number(m) != number(last[0]) - 1:
                break
            last.insert(0, m)
        return last if len(last) >= 3 else months

    fine = [r for r in rows if r[1] is not None and r[3] is not None and r[3] <= r[4]]
    out = set()
    whole = days_of(fine)
    for c, strict in days_of(rows).items():
        months = sorted({d.strftime("%Y-%m") for d in whole.get(c, set())})
        length = lambda m: ((date(int(m[:4]) + int(m[5:]) // 12, int(m[5:]) % 12 + 1, 1)) - date(int(m[:4]), int(m[5:]), 1)).days
        full = [m for m in months if sum(d.strftime("%Y-%m") == m for d in whole[c]) == length(m)]
        base = full if len(full) >= 3 else sorted({d.strftime("%Y-%m") for d in strict})
        out |= {(c, m) for m in run(base)}
    return out


def test_offer_months_of_random_periods(spark):
    for seed in (2, 3):
        rows = random_periods(seed)
        st = spark.createDataFrame(rows, PERIODS)
        assert {(r.case_id, r.month) for r in coverage.offer_months(st).collect()} == plain_offer(rows)


def test_long_periods_are_not_laid_out_by_day(spark):
    st = spark.createDataFrame([(1, "a", "s", date(1, 1, 1), date(9999, 12, 30)), (2, "a", "s", date(2020, 1, 1), date(2029, 12, 31))], PERIODS)
    assert coverage.covered_spans(st).count() == 1  # the other is over-long
    assert [(r.case_id, r.covered_days) for r in coverage.coverage_summary(coverage.covered_spans(st)).groupBy("case_id").sum("covered_days")
            .withColumnRenamed("sum(covered_days)", "covered_days").collect()] == [(2, 3653)]


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange")


def test_tables_kept_by_case_meet_without_an_exchange(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = random_periods(4)
        st = spark.createDataFrame(rows, PERIODS)
        kept = kept_by(st)
        assert sorted(map(str, kept.collect())) == sorted(map(str, st.collect()))
        spans = coverage.covered_spans(kept)
        assert exchanges(coverage.covered_spans(st)) > 0 and exchanges(spans) == 0
        assert exchanges(coverage.coverage_summary(kept_by(spans))) == 0
        months = kept_by(coverage.coverage_summary(spans))
        assert exchanges(kept.join(months, "case_id")) == 0
        assert exchanges(kept.groupBy("case_id").count().join(months.groupBy("case_id").count(), "case_id")) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_large_tables_kept_by_case_are_merged_not_broadcast(spark, monkeypatch):
    """Their files are small, since rows of a case repeat: a broadcast of millions of rows would be built in the driver."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    st = spark.createDataFrame(random_periods(5), PERIODS)
    ledger = spark.createDataFrame([(c, date(2024, 1, 1) + timedelta(d)) for c in range(40) for d in range(0, 200, 7)], "case_id long, date date")
    small = kept_by(st)
    assert "BroadcastHashJoin" in plan(small.join(kept_by(ledger.limit(50)), "case_id"))
    want = sorted(map(str, small.join(ledger, "case_id").collect()))
    monkeypatch.setattr("ledgerloom.lineage.BROADCAST_ROWS", 20)
    large = kept_by(st)
    joined = large.join(ledger, "case_id")
    assert "Broadcast" not in plan(joined) and sorted(map(str, joined.collect())) == want
    spans = coverage.covered_spans(st)
    rows = coverage.covered_rows(ledger, spans, coverage.coverage_summary(spans).where("complete"))
    assert "BroadcastExchange" not in plan(rows).split("Initial Plan")[0].split("SortMergeJoin")[0] and "SortMergeJoin" in plan(rows)
