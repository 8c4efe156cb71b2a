"""Scorecard, terms and funding range of a case, as column expressions over one row a case."""

from __future__ import annotations

from ledgerloom import rules
from ledgerloom.functions.money import CENTS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ladders of the scorecard: (bound, points) from the best, and what is left.
AT_LEAST = {
    "revenue": ([(150000, 17), (75000, 14), (40000, 11), (20000, 8), (10000, 6)], 0),
    "deposits": ([(40, 5), (20, 4), (10, 3), (5, 2)], 0),
    "months_in_business": ([(84, 6), (48, 5), (24, 4), (12, 3), (6, 1)], 0),
    "credit_score": ([(750, 6), (700, 5), (650, 4), (600, 3), (550, 2), (500, 1)], 0),
    "cash_margin": ([(10, 7), (5, 6), (3, 5), (0, 4), (-5, 2), (-10, 1)], 0),
    "trend": ([(5, 5), (-5, 4), (-10, 2), (-20, 1)], 0),
}
AT_MOST = {
    "volatility": ([(10, 5), (20, 4), (30, 3), (40, 2), (50, 1)], 0),
    "positions": ([(0, 6), (1, 5), (2, 3), (3, 1)], 0),
    "burden": ([(8, 10), (12, 8), (16, 6), (20, 4), (25, 2)], 0),
    "returned": ([(0, 4), (1, 3), (2, 2), (4, 1)], 0),
    "concentration": ([(20, 2), (35, 1)], 0),
}
#: The top of the trend ladder, points of velocity, records and verification.
TREND_TOP = (15, 6)
VELOCITY = [(0, 5), (1, 3)]
VELOCITY_MORE = 1
RECORDS = {"Clean": 4, "Minor": 3, "Moderate": 1, "Severe": 0}
VERIFICATION = {"Bank Connect": 3, "Original PDF": 2, "Minor inconsistency": 1, "Suspected manipulation": 0}
#: Least score, grade, share of revenue advanced, largest burden.
GRADES = [(90, "A+", 1.0, 0.18), (82, "A", 0.85, 0.17), (74, "B", 0.70, 0.15), (66, "C", 0.55, 0.13), (58, "D", 0.35, 0.10)]
LOWEST_GRADE = ("E", 0.0, 0.0)
#: Months of repayment by position: from, to; the last one for all further positions.
TERMS = [(5, 8), (3, 6), (3, 5), (3, 4)]


def at_least(c: Column, name: str) -> Column:
    steps, out = AT_LEAST[name][0], F.lit(AT_LEAST[name][1])
    for bound, points in reversed(steps):
        out = F.when(c >= bound, F.lit(points)).otherwise(out)
    return F.when(c.isNull(), F.lit(0)).otherwise(out)


def at_most(c: Column, name: str) -> Column:
    steps, out = AT_MOST[name][0], F.lit(AT_MOST[name][1])
    for bound, points in reversed(steps):
        out = F.when(c <= bound, F.lit(points)).otherwise(out)
    return F.when(c.isNull(), F.lit(0)).otherwise(out)


def _named(c: Column, points: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in points.items():
        out = F.when(c == name, F.lit(value)).otherwise(out)
    return out


def industries(spark: SparkSession) -> DataFrame:
    """Industry, points, seasonality: a small fixed table, safe to broadcast."""
    rows = [(k, *v) for k, v in rules.INDUSTRIES.items()]
    return spark.createDataFrame(rows, "industry string, industry_points int, seasonality_points int")


def scorecard(cases: DataFrame) -> DataFrame:
    """Points by component, score, grade, advance and largest burden.

    cases: case_id, revenue, trend, volatility, deposits, concentration, burden, positions, lenders (distinct lenders paid),
    returned, months_in_business, industry, credit_score, public_records, bank_verification, operating_outflows,
    monthly_debt. A case of an unknown industry, record or verification has no score (null).
    """
    c = F.col
    out = cases.join(F.broadcast(industries(cases.sparkSession)), "industry", "left")
    usable = c("revenue").isNotNull() & c("operating_outflows").isNotNull() & c("monthly_debt").isNotNull() & (c("revenue") > 0) & (
        c("operating_outflows") >= 0) & (c("monthly_debt") >= 0)
    margin = F.when(usable, (c("revenue") - c("operating_outflows") - c("monthly_debt")) / F.nullif(c("revenue"), F.lit(0.0)) * 100)
    velocity = F.lit(VELOCITY_MORE)
    for n, points in reversed(VELOCITY):
        velocity = F.when(c("lenders") == n, F.lit(points)).otherwise(velocity)
    points = {
        "pts_revenue": at_least(c("revenue"), "revenue"),
        "pts_trend": F.when(c("trend") > TREND_TOP[0], F.lit(TREND_TOP[1])).otherwise(at_least(c("trend"), "trend")),
        "pts_deposits": at_least(c("deposits"), "deposits"),
        "pts_volatility": at_most(c("volatility"), "volatility"),
        "pts_positions": at_most(c("positions"), "positions"),
        "pts_burden": at_most(c("burden"), "burden"),
        "pts_velocity": velocity,
        "pts_returned": at_most(c("returned"), "returned"),
        "pts_time": at_least(c("months_in_business"), "months_in_business"),
        "pts_industry": c("industry_points"),
        "pts_seasonality": c("seasonality_points"),
        "pts_credit": at_least(c("credit_score"), "credit_score"),
        "pts_records": _named(c("public_records"), RECORDS),
        "pts_verification": _named(c("bank_verification"), VERIFICATION),
        "pts_concentration": at_most(c("concentration"), "concentration"),
        "pts_cash": at_least(margin, "cash_margin"),
    }
    out = out.select(*cases.columns, *[v.alias(k) for k, v in points.items()])
    total = sum((F.col(k) for k in points), F.lit(0))
    grade, advance, burden = (F.lit(x) for x in LOWEST_GRADE)
    for least, g, a, b in reversed(GRADES):
        grade, advance, burden = (F.when(F.col("score") >= least, F.lit(x)).otherwise(y) for x, y in ((g, grade), (a, advance), (b, burden)))
    scored = out.withColumn("score", total)
    known = lambda x: F.when(F.col("score").isNotNull(), x)
    return scored.select("*", known(grade).alias("grade"), known(advance).alias("advance"), known(burden).alias("max_burden"))


def component_points(scored: DataFrame) -> DataFrame:
    """R6 as a table: case_id, component, points."""
    names = [c for c in scored.columns if c.startswith("pts_")]
    return scored.unpivot(["case_id"], names, "component", "points").withColumn("component", F.substr("component", F.lit(5)))


def term_bounds(position: Column) -> tuple[Column, Column]:
    """Shortest and longest term; null for a position below one."""
    low = high = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(TERMS, 1))):
        at = position >= i if i == len(TERMS) else position == i
        low, high = F.when(at, F.lit(a)).otherwise(low), F.when(at, F.lit(b)).otherwise(high)
    return low, high


def _down(c: Column) -> Column:
    return F.floor(c.cast("decimal(30,10)"), F.lit(2)).cast(CENTS)


def funding_limits(cases: DataFrame) -> DataFrame:
    """The amount that policy allows, down to cents, its monthly payment, capacities and what binds; `problem` instead
    where an input is out of bounds. cases: case_id, revenue, monthly_debt, operating_outflows, reserve, term, factor,
    advance, max_burden, funding_position and cap (null: none), all decimal or whole."""
    c = F.col
    money = lambda x: c(x).cast("decimal(20,4)")
    low, high = term_bounds(c("funding_position"))
    negative = sum(((F.coalesce(c(x), F.lit(-1)) < 0).cast("int") for x in ("revenue", "monthly_debt", "operating_outflows", "reserve", "advance", "max_burden")), F.lit(0))
    problem = (
        F.when((negative > 0) | (F.coalesce(c("cap"), F.lit(0)) < 0), "negative or missing amount")
        .when(~F.coalesce(c("factor") >= 1, F.lit(False)), "factor below one")
        .when(low.isNull(), "position below one")
        .when(~F.coalesce(c("term").between(low, high), F.lit(False)), "term out of bounds")
        .when(c("max_burden") > 1, "burden above one")
    )
    multiple = money("revenue") * c("advance").cast("decimal(6,4)")
    amount = _down(F.least(multiple, money("cap")))  # least skips a missing cap
    burden_room = money("revenue") * c("max_burden").cast("decimal(6,4)") - money("monthly_debt")
    cash_room = money("revenue") - money("operating_outflows") - money("monthly_debt") - money("reserve")
    ok = lambda x: F.when(F.col("problem").isNull(), x)
    binding = F.concat_ws(",", F.when(money("cap").isNull() | (multiple <= money("cap")), F.lit("revenue_multiple")), F.when(money("cap") <= multiple, F.lit("product_cap")))
    return cases.withColumn("problem", problem).select(
        "case_id", "problem", low.alias("term_minimum"), high.alias("term_maximum"), ok(amount).alias("amount"),
        ok((amount.cast("double") * c("factor").cast("double") / F.nullif(c("term").cast("double"), F.lit(0.0)))).alias("monthly_payment"),
        ok(F.greatest(F.lit(0).cast("decimal(20,4)"), F.least(burden_room, cash_room)).cast("double")).alias("monthly_capacity"),
        ok(binding).alias("binding"),
    )


def estimate_range(upper: Column, reduction: int = 15) -> tuple[Column, Column, Column]:
    """Low, median and high of an estimate below `upper`, each down to cents."""
    high = _down(upper)
    low = _down(high * F.lit(100 - reduction).cast("decimal(5,0)") / F.lit(100).cast("decimal(5,0)"))
    median = _down((low + high) / F.lit(2).cast("decimal(3,0)"))
    return low, median, high


def capped_advance(cap: Column, revenue: Column, pct_of_revenue: Column) -> Column:
    """The program's cap under a case's share of revenue in percent (null: none), down to cents, never below zero."""
    share = revenue.cast("decimal(20,4)") * pct_of_revenue.cast("decimal(8,4)") / F.lit(100).cast("decimal(5,0)")
    return _down(F.greatest(F.lit(0).cast("decimal(20,4)"), F.least(cap.cast("decimal(20,4)"), share.cast("decimal(20,4)"))))


def clamped_range(low: Column, recommended: Column, high: Column, cap: Column) -> tuple[Column, Column, Column]:
    """An advisory range within zero and the program's cap, in order; null if any end isn't finite."""
    finite = ~(F.isnan(low) | F.isnan(recommended) | F.isnan(high)) & (F.greatest(F.abs(low), F.abs(recommended), F.abs(high)) < float("inf"))
    top = F.least(F.greatest(high, F.lit(0.0)), cap)
    mid = F.least(F.greatest(recommended, F.lit(0.0)), top)
    bottom = F.least(F.greatest(low, F.lit(0.0)), mid)
    return tuple(F.when(finite, F.round(x, 2)) for x in (bottom, mid, top))
