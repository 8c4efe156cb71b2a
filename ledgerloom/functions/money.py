"""Money, numbers and dates as printed, read strictly: what isn't plainly an amount or a day is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"
#: Payments in a month, by frequency.
MULTIPLIERS = {"Daily": 21.0, "2-3x Weekly": 9.0, "Weekly": 52 / 12, "Bi-Weekly": 26 / 12, "Monthly": 1.0}
#: Bounds of the settings that a case may change.
SETTING_BOUNDS = {"repayment_term": (1, 24), "credit_score": (300, 900), "months_business": (0, 1200)}


def parse_money(c: Column) -> Column:
    """A complete printed cell as decimal(18,2): (x), leading or trailing minus, $, DR, CR and OD suffixes, thousands in
    groups of three, one or two decimals after comma or point. Conflicting signs and odd groups give null."""
    own = F.trim(c)
    simple = F.regexp_like(own, F.lit(r"^-?\d{1,16}(\.\d{1,2})?\z"))  # as most are: cast as they stand, without the many patterns below
    text = F.regexp_replace(F.regexp_replace(F.trim(c), "[−–]", "-"), " ", " ")
    suffix = F.upper(F.regexp_extract(text, r"(?i)\s*(DR|CR|OD)$", 1))
    text = F.trim(F.regexp_replace(text, r"(?i)\s*(DR|CR|OD)$", ""))
    bracketed = F.regexp_like(text, F.lit(r"^\(.*\)$"))
    body = F.when(bracketed, F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text)
    stray = F.regexp_like(body, F.lit(r"[()]"))
    body = F.regexp_replace(body, r"[\s$]", "")
    front, back = F.regexp_extract(body, r"^([-+])", 1), F.regexp_extract(body, r"^[-+]?.*(-)$", 1)
    digits = F.regexp_replace(F.regexp_replace(body, r"^[-+]", ""), r"-$", "")
    minus = (front == "-").cast("int") + (back == "-").cast("int") + bracketed.cast("int")
    conflict = (minus > 1) | (bracketed & (front != "")) | ((suffix == "CR") & (minus > 0))
    comma = F.regexp_like(digits, F.lit(r"^(\d+|\d{1,3}(\.\d{3})+),\d{1,2}$"))
    point = F.regexp_like(digits, F.lit(r"^(\d+|\d{1,3}(,\d{3})+)(\.\d{1,2})?$"))
    plain = F.when(comma, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(
        point, F.replace(digits, F.lit(","), F.lit(""))
    )
    sign = F.when((minus > 0) | suffix.isin("DR", "OD"), F.lit(-1)).otherwise(F.lit(1))
    other = F.when(~stray & ~conflict, (plain.try_cast(CENTS) * sign).cast(CENTS))
    return F.when(own == "", F.lit(None).cast(CENTS)).when(simple, own.try_cast(CENTS)).otherwise(other)


def decimal_value(c: Column) -> Column:
    """A number with two decimals at most, else null: a third decimal isn't rounded away."""
    wide = F.when(F.regexp_like(F.trim(c), F.lit(r"^[-+]?(\d+(\.\d*)?|\.\d+)$")), F.trim(c).try_cast("decimal(38,10)"))
    return F.when(wide == F.round(wide, 2), wide.try_cast(CENTS))


def extracted_decimal(c: Column) -> Column:
    """An extracted number rounded to cents, halves to even; null if it isn't finite."""
    return F.bround(F.trim(c).try_cast("decimal(38,10)"), 2).try_cast(CENTS)


def strict_day(c: Column) -> Column:
    """YYYY-MM-DD and a real day, else null."""
    return F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), c.try_cast("date"))


def lenient_day(c: Column) -> Column:
    """As extracted pages write it: slashes or points for dashes, one or two digits."""
    text = F.regexp_replace(F.trim(c), r"[/.]", "-")
    part = lambda i, n: F.lpad(F.regexp_extract(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", i), n, "0")
    return F.when(
        F.regexp_like(text, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)).try_cast("date")
    )


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def setting_ok(name: str, c: Column) -> Column:
    """A whole number within the bounds of the setting."""
    low, high = SETTING_BOUNDS[name]
    return F.regexp_like(c, F.lit(r"^\d+$")) & F.coalesce(c.try_cast("long").between(low, high), F.lit(False))
