"""Calendar coverage of statements and daily balances rebuilt from their openings."""

from __future__ import annotations

from ledgerloom.functions.money import CENTS, days_in_month, month_of
from ledgerloom.lineage import written
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest period of a statement, in days after its first.
MOST_DAYS = 3660


def included(df: DataFrame) -> DataFrame:
    """Statements (or rows) that aren't marked exclude_from_ledger; all of them where there is no such column."""
    return df.where(~F.coalesce("exclude_from_ledger", F.lit(False))) if "exclude_from_ledger" in df.columns else df


def coverage_gaps(statements: DataFrame) -> DataFrame:
    """(case_id, account_id, missing_from, missing_through) between merged periods of an account."""
    w = Window.partitionBy("case_id", "account_id").orderBy("period_start", "period_end").rowsBetween(Window.unboundedPreceding, -1)
    valid = included(statements).where("period_start <= period_end and account_id is not null")
    return valid.withColumn("_end", F.max("period_end").over(w)).where("period_start > date_add(_end, 1)").select(
        "case_id", "account_id", F.date_add("_end", 1).alias("missing_from"), F.date_sub("period_start", 1).alias("missing_through")
    )


def _merged(statements: DataFrame, *account: str) -> DataFrame:
    """(case_id, *account, start, end): periods that touch or overlap as one span."""
    w = Window.partitionBy("case_id", *account).orderBy("period_start", "period_end")
    before = F.max("period_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("period_start") > F.date_add(before, 1), F.lit(True))
    island = F.sum(F.col("_begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = statements.withColumn("_begins", begins).withColumn("_island", island)
    return marked.groupBy("case_id", *account, "_island").agg(F.min("period_start").alias("start"), F.max("period_end").alias("end")).drop("_island")


def _common(statements: DataFrame) -> DataFrame:
    """(case_id, start, end): spans that every account of a case covers, by a sweep: an account adds one where a span of
    it begins and takes it back behind the span's end; where the running count is the number of accounts, all cover."""
    spans = _merged(statements, "account_id")
    first = F.row_number().over(Window.partitionBy("case_id", "account_id").orderBy("start"))
    edges = F.array(
        F.struct(F.col("start").alias("day"), F.lit(1).alias("step"), (F.col("_r") == 1).cast("int").alias("account")),
        F.struct(F.date_add("end", 1).alias("day"), F.lit(-1).alias("step"), F.lit(0).alias("account")),
    )
    events = spans.withColumn("_r", first).select("case_id", F.inline(edges)).groupBy("case_id", "day").agg(F.sum("step").alias("step"), F.sum("account").alias("account"))
    case = Window.partitionBy("case_id")
    swept = events.withColumns({
        "_k": F.sum("step").over(case.orderBy("day")), "_n": F.sum("account").over(case), "_next": F.lead("day").over(case.orderBy("day")),
    })
    return swept.where("_k = _n").select("case_id", F.col("day").alias("start"), F.date_sub("_next", 1).alias("end"))


def covered_spans(statements: DataFrame) -> DataFrame:
    """(case_id, start, end) of the days covered by every account; a statement without account, or with an invalid or
    over-long period, empties its case. All of it goes by case, so one exchange serves (none on tables kept by case)."""
    ok = F.col("account_id").isNotNull() & (F.col("period_start") <= F.col("period_end")) & (
        F.datediff("period_end", "period_start") <= MOST_DAYS
    )
    good = F.min(F.coalesce(ok, F.lit(False))).over(Window.partitionBy("case_id"))
    return _common(included(statements).withColumn("_good", good).where("_good"))


def covered_days(statements: DataFrame) -> DataFrame:
    """`covered_spans`, day by day."""
    return covered_spans(statements).select("case_id", F.explode(F.sequence("start", "end")).alias("day"))


def by_month(spans: DataFrame) -> DataFrame:
    """Spans cut at the ends of months: a column month, and start and end within it."""
    first = F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month")))
    return spans.withColumn("_m", first).withColumns({
        "month": month_of(F.col("_m")), "start": F.greatest("start", "_m"), "end": F.least("end", F.last_day("_m")),
    }).drop("_m")


def _days_of(covered: DataFrame, *key: str) -> DataFrame:
    """(case_id, *key, month, covered_days) of spans, or of single days."""
    if "day" in covered.columns:
        return covered.groupBy("case_id", *key, month_of(F.col("day")).alias("month")).agg(F.count("*").alias("covered_days"))
    return by_month(covered).groupBy("case_id", *key, "month").agg(F.sum(F.datediff("end", "start") + 1).alias("covered_days"))


def _first_of(month: str) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def coverage_summary(covered: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """(case_id, month, covered_days, calendar_days, coverage_fraction, complete); covered: `covered_spans` or
    `covered_days`; months: case_id, month to list, the others are left out."""
    counted = _days_of(covered)
    if months is not None:
        counted = months.select("case_id", "month").distinct().join(counted, ["case_id", "month"], "left")
    total = days_in_month(_first_of("month")).cast("long")
    out = counted.withColumn("covered_days", F.coalesce("covered_days", F.lit(0)).cast("long")).withColumn("calendar_days", total)
    return out.withColumn("coverage_fraction", F.col("covered_days") / F.col("calendar_days")).withColumn(
        "complete", F.col("covered_days") == F.col("calendar_days")
    )


def full_months(statements: DataFrame, per_account: bool = False) -> DataFrame:
    """C4: (case_id, month) that every account covers whole; incomplete statements are skipped. With per_account, each
    account by itself (A8)."""
    valid = included(statements).where("account_id is not null and period_start <= period_end")
    keys = ["account_id"] if per_account else []
    months = _days_of(_merged(valid, *keys) if per_account else _common(valid), *keys)
    return months.where(F.col("covered_days") == days_in_month(_first_of("month"))).select("case_id", *keys, "month")


def _index(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def latest_run(months: DataFrame) -> DataFrame:
    """The latest consecutive months of each case, with `run_length`."""
    place = _index(F.col("month")) - F.row_number().over(Window.partitionBy("case_id").orderBy("month"))
    runs = months.select("case_id", "month").distinct().withColumn("_run", place)
    last = Window.partitionBy("case_id")
    kept = runs.withColumn("_last", F.max("_run").over(last)).where("_run = _last")
    return kept.withColumn("run_length", F.count("*").over(last)).select("case_id", "month", "run_length")


def offer_months(statements: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Months that an offer rests on: complete months if a case has three, else all covered months; the latest run of
    these if it has three months, else all of them. covered: the covered spans or days, where they are at hand."""
    full = full_months(statements).select("case_id", "month", F.lit(1).alias("_full"))
    covered = _days_of(covered_spans(statements) if covered is None else covered).select("case_id", "month", F.lit(0).alias("_full"))
    both = full.unionByName(covered).groupBy("case_id", "month").agg(F.max("_full").alias("_full"), F.min("_full").alias("_covered"))
    case = Window.partitionBy("case_id")
    base = both.withColumn("_n", F.sum("_full").over(case)).where("_full = 1 and _n >= 3 or _covered = 0 and _n < 3")
    place = _index(F.col("month")) - F.row_number().over(case.orderBy("month"))
    runs = base.withColumn("_run", place).withColumn("_last", F.max("_run").over(case))
    ended = runs.withColumn("_length", F.sum((F.col("_run") == F.col("_last")).cast("int")).over(case))
    return ended.where("_run = _last or _length < 3").select("case_id", "month")


def partial_months_left_out(statements: DataFrame) -> DataFrame:
    """Covered months that the offer months leave out."""
    spans = covered_spans(statements)
    return coverage_summary(spans).join(offer_months(statements, spans), ["case_id", "month"], "left_anti").select(
        "case_id", "month", "covered_days", "complete"
    )


def _of_months(covered: DataFrame, months: DataFrame | None) -> DataFrame:
    """(case_id, month, start, end): covered spans (or days) cut at the ends of months, of chosen months alone. What is joined to
    them is merged: a span may be many months, which Spark's estimate of their size for a broadcast leaves out."""
    if "day" in covered.columns:
        pieces = covered.select("case_id", month_of(F.col("day")).alias("month"), F.col("day").alias("start"), F.col("day").alias("end"))
    else:
        pieces = by_month(covered)
    chosen = pieces if months is None else pieces.join(months.select("case_id", "month").distinct(), ["case_id", "month"], "left_semi")
    return chosen.hint("merge")


def covered_rows(ledger: DataFrame, covered: DataFrame, months: DataFrame) -> DataFrame:
    """Ledger rows on covered days of chosen months. covered: `covered_spans` or `covered_days`."""
    pieces = _of_months(covered, months).select(F.col("case_id").alias("_case"), F.col("month").alias("_month"), "start", "end")
    met = (F.col("case_id") == F.col("_case")) & (month_of(F.col("date")) == F.col("_month")) & F.col("date").between(F.col("start"), F.col("end"))
    return ledger.join(pieces, met, "left_semi")


def daily_balances(statements: DataFrame, ledger: DataFrame, months: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """(case_id, average_daily_balance, negative_days, intraday_negative_days, covered_days).

    Each statement is rolled from its opening over its days with a movement; a balance holds until the next of them, and is
    laid out day by day only at the end. A day takes a later statement's rows too, never an earlier one's. A case has no row
    if a rate, opening, reached amount or date is unusable, if statements disagree on a day, or if an account lacks a wanted
    day. statements: case_id, account_id, stmt_id, period_start, period_end, opening, rate; ledger: case_id, account_id, date,
    seq, tx_type, amount, statement_period_start. covered: the covered spans, where they are at hand.
    """
    statements, ledger = included(statements), included(ledger)
    wanted = _of_months(covered_spans(statements) if covered is None else covered, months)
    last = wanted.groupBy("case_id").agg(F.max("end").alias("_max"), F.sum(F.datediff("end", "start") + 1).alias("_wanted"))
    # statements and rows meet wanted spans and each other month by month
    key, own = ["case_id", "stmt_id"], ["case_id", "account_id", "stmt_id", "opening", "rate", "period_start", "period_end"]
    periods = statements.where("period_start <= period_end").select(*own, F.col("period_start").alias("start"), F.col("period_end").alias("end"))
    pieces = by_month(periods).withColumnsRenamed({"start": "_start", "end": "_end"})
    reaching = pieces.join(wanted, ["case_id", "month"]).where("_start <= end and start <= _end").select(*key).distinct()
    st = statements.select(*own).join(reaching, key, "left_semi").join(last, "case_id").withColumn("stop", F.least("period_end", "_max"))
    st = written(st)  # all branches below rest on it
    stops = by_month(st.withColumns({"start": F.col("period_start"), "end": F.col("stop")}).where("start <= end"))
    rows = ledger.select("case_id", "account_id", month_of(F.col("date")).alias("month"), F.col("date").alias("day"), "seq", "tx_type", "amount",
                         F.col("statement_period_start").alias("_origin"))
    reached = stops.select("case_id", "account_id", "stmt_id", "month", "period_start", "start", "end").join(rows, ["case_id", "account_id", "month"]).where(
        F.col("day").between(F.col("start"), F.col("end")) & ~F.coalesce(F.col("_origin") < F.col("period_start"), F.lit(False))
    )
    good = F.coalesce((F.col("amount") > 0) & F.col("tx_type").isin("credit", "debit"), F.lit(False))
    move = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    # the first day of a statement counts as one with a movement of nothing
    begun = st.select(*key, F.col("period_start").alias("day"), F.lit(None).cast("long").alias("seq"), F.lit(0).cast(CENTS).alias("_move"), F.lit(True).alias("_begins"), F.lit(False).alias("_bad"))
    moves = reached.select(*key, "day", F.col("seq").cast("long").alias("seq"), move.alias("_move"), F.lit(False).alias("_begins"), (~good).alias("_bad")).unionByName(begun)
    running = F.sum("_move").over(Window.partitionBy(*key).orderBy("day", F.desc("_begins"), "seq").rowsBetween(Window.unboundedPreceding, 0))
    by_day = written(moves.withColumn("_cum", running).groupBy(*key, "day").agg(
        F.sum("_move").alias("net"), F.min(F.when(~F.col("_begins"), F.col("_cum"))).alias("lowest"), F.bool_or("_bad").alias("_bad")
    ))
    undated = ledger.where("date is null").select("case_id", "account_id").distinct().join(st.select("case_id", "account_id").distinct(), ["case_id", "account_id"], "left_semi")
    unusable = F.coalesce((F.col("rate") <= 0) | F.col("rate").isNull() | F.col("opening").isNull(), F.lit(True))
    facts = st.groupBy("case_id").agg(F.bool_or(unusable).alias("_u"), F.count_distinct("account_id").alias("_accounts"), F.first("_wanted").alias("_wanted"))
    facts = facts.where("not _u").join(by_day.where("_bad").select("case_id"), "case_id", "left_anti").join(undated.select("case_id"), "case_id", "left_anti")
    by_time = Window.partitionBy(*key).orderBy("day")
    until = F.date_sub(F.lead("day").over(by_time), 1)
    held = by_day.withColumns({"_until": until, "_cn": F.sum("net").over(by_time)}).join(st.select(*key, "account_id", "opening", "rate", "stop"), key)
    value = F.col("opening") + F.col("_cn")
    first_below = (value - F.col("net") < 0) | F.coalesce(F.col("opening") + F.col("lowest") < 0, F.lit(False))
    days = wanted.select("case_id", F.explode(F.sequence("start", "end")).alias("day"))
    held = held.select(
        "case_id", "account_id", (value * F.col("rate")).alias("v"), first_below.alias("_first"), (value < 0).alias("_later"), F.col("day").alias("_from"),
        F.coalesce("_until", "stop").alias("_through"),
    )
    closed = held.withColumn("day", F.explode(F.sequence("_from", "_through"))).join(days, ["case_id", "day"], "left_semi").withColumn("below", F.when(F.col("day") == F.col("_from"), F.col("_first")).otherwise(F.col("_later")))
    by_account = closed.groupBy("case_id", "account_id", "day").agg(
        F.first("v").alias("v"), (F.min("v") != F.max("v")).alias("conflict"), F.bool_or("below").alias("below")
    )
    total = by_account.groupBy("case_id", "day").agg(
        F.sum("v").alias("total"), F.bool_or(F.col("v") < 0).alias("negative"), F.bool_or("below").alias("below"), F.count("*").alias("_k"),
        F.bool_or("conflict").alias("_conflict"),
    )
    of_case = total.groupBy("case_id").agg(
        F.avg("total").cast("double").alias("average_daily_balance"), F.count_if("negative").alias("negative_days"),
        F.count_if("below").alias("intraday_negative_days"), F.count("*").alias("covered_days"), F.sum("_k").alias("_k"), F.bool_or("_conflict").alias("_conflict"),
    )
    # every account that has a wanted day has all of them
    return of_case.join(facts, "case_id").where("not coalesce(_conflict, false) and _k = _accounts * _wanted").select(
        "case_id", "average_daily_balance", "negative_days", "intraday_negative_days", "covered_days"
    )
