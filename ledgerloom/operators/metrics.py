"""Aggregates of a case's ledger: bank summary, revenue metrics, returned payments, lender payments, inputs of a decision."""

from __future__ import annotations

from ledgerloom.functions.money import CENTS, MULTIPLIERS
from ledgerloom.functions.text import compact
from ledgerloom.operators.classify import is_revenue, lender_match
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cents(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast(CENTS)


def bank_summary(ledger: DataFrame) -> DataFrame:
    """A1: by case, currency, account and month: gross credits, debits and reviewed revenue."""
    total = lambda when: _cents(F.sum(F.when(when, F.col("amount"))))
    return ledger.groupBy("case_id", "currency", "account_id", "month").agg(
        total(F.col("tx_type") == "credit").alias("gross_credits"), total(F.col("tx_type") == "debit").alias("debits"),
        total(is_revenue()).alias("reviewed_revenue"),
    )


def currency_totals(ledger: DataFrame) -> DataFrame:
    """A2: one text a case, such as 'CAD 1,234.50 | USD 10.00'."""
    sums = ledger.groupBy("case_id", F.coalesce("currency", F.lit("Unknown")).alias("code")).agg(F.sum("amount").alias("s"))
    shown = F.struct("code", F.concat_ws(" ", "code", F.format_number("s", 2)).alias("t"))
    return sums.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), " | ").alias("totals"))


def lender_payments(ledger: DataFrame) -> DataFrame:
    """A3: debits by lender, tier and account: number, sum and last day. Lenders are matched on distinct descriptions."""
    debits = ledger.where("tx_type = 'debit'")
    names = debits.select("description").distinct().withColumn("m", lender_match(F.col("description"))).where("m is not null")
    return debits.join(names, "description").groupBy("case_id", F.col("m.lender").alias("lender"), F.col("m.tier").alias("tier"), "account_id").agg(
        F.count("*").alias("observed_payments"), F.sum("amount").cast(CENTS).alias("observed_total"), F.max("date").alias("last_seen")
    )


def revenue_metrics(ledger: DataFrame, months: DataFrame) -> DataFrame:
    """A4: one row a case over its chosen months (case_id, month, coverage_fraction, complete), zero-filled: average monthly
    revenue and deposits by coverage, volatility (population deviation, %), trend (first to last month, %), the largest
    payer's share. Trend and volatility are null if any chosen month is partial."""
    revenue = ledger.where(is_revenue()).join(months, ["case_id", "month"], "left_semi")
    by_month = revenue.groupBy("case_id", "month").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    scale = F.nullif(F.col("coverage_fraction"), F.lit(0.0))
    filled = months.join(by_month, ["case_id", "month"], "left").select(
        "case_id", "month", "complete", (F.coalesce("s", F.lit(0)).cast("double") / scale).alias("r"),
        (F.coalesce("n", F.lit(0)).cast("double") / scale).alias("k"),
    )
    own = filled.groupBy("case_id").agg(
        F.avg("r").alias("average"), F.stddev_pop("r").alias("deviation"), F.avg("k").alias("deposits"), F.count("*").alias("months"),
        F.min_by("r", "month").alias("first"), F.max_by("r", "month").alias("last"), F.bool_and("complete").alias("whole"),
    )
    payers = revenue.groupBy("case_id", "description").agg(F.sum("amount").alias("s")).groupBy("case_id").agg(
        F.max("s").cast("double").alias("top"), F.sum("s").cast("double").alias("all")
    )
    many = (F.col("months") > 1) & F.col("whole")
    return own.join(payers, "case_id", "left").select(
        "case_id", F.coalesce("average", F.lit(0.0)).alias("average"), F.coalesce("deposits", F.lit(0.0)).alias("deposits"),
        F.when(many & (F.col("average") > 0), F.col("deviation") / F.nullif("average", F.lit(0.0)) * 100).alias("volatility"),
        F.when(many & (F.col("first") > 0), (F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0)) * 100).alias("trend"),
        F.coalesce(F.col("top") / F.nullif("all", F.lit(0.0)) * 100, F.lit(0.0)).alias("concentration"),
    )


def returned_payment_rows(ledger: DataFrame) -> DataFrame:
    """A5, row part: adds returned, unspecified, paid_fee, fee, service and disclosed (items named in a fee's text)."""
    text = F.upper(F.coalesce("description", F.lit("")))
    key = F.regexp_replace(text, r"[^A-Z0-9]", "")
    credit, debit = F.col("tx_type") == "credit", F.col("tx_type") == "debit"
    named = credit & F.regexp_like(key, F.lit(r"RETURNEDNSF|NSFRETURN|INSUFFICIENTFUNDS|RETOURNE?NSF"))
    unspecified = credit & (key == "RETURNEDITEMCREDIT") & ~named
    paid = debit & key.isin("NSFPAIDFEE", "PAYMENTCOVERAGEFEE")
    fee = (
        debit & ~paid & F.regexp_like(text, F.lit(r"\bNSF\b|\b(NON[ -]*SUFFICIENT|INSUFFICIENT)\s+FUNDS\b"))
        & F.regexp_like(text, F.lit(r"FEE|CHARGE|FRAIS"))
    ) | (debit & F.contains(key, F.lit("RETURNEDITEMFEE")))
    items = F.regexp_extract(text, r"\b(\d+)\s*@", 1).try_cast("long")
    return ledger.select(
        "*", (named | unspecified).alias("returned"), unspecified.alias("unspecified"), paid.alias("paid_fee"), fee.alias("fee"),
        (debit & (key == "TRANSACTIONSERVICECHARGE")).alias("service"), F.when(fee, items).alias("disclosed"),
    )


def _returns(rows: DataFrame, keys: list[str]) -> DataFrame:
    total = lambda flag: _cents(F.sum(F.when(F.col(flag), F.col("amount"))))
    return rows.groupBy(*keys).agg(
        F.count_if("returned").alias("returned_items"), F.count_distinct(F.when(F.col("returned"), F.col("date"))).alias("affected_dates"),
        total("returned").alias("returned_amount"), total("fee").alias("fee_amount"), total("paid_fee").alias("paid_item_fee_amount"),
        F.count_if("fee").alias("fee_rows"), F.count_if("paid_fee").alias("paid_item_fee_rows"),
        F.coalesce(F.sum("disclosed"), F.lit(0)).alias("fee_disclosed_items"), F.count_if("unspecified").alias("unspecified_return_items"),
    )


def returned_payments(ledger: DataFrame) -> DataFrame:
    """A5 with J10: one row a case; service charges on the day and account of an unspecified return count once each."""
    rows = returned_payment_rows(ledger)
    days = rows.where("unspecified").select("case_id", "account_id", "date").distinct()
    charges = rows.where("service").join(days, ["case_id", "account_id", "date"], "left_semi").groupBy("case_id").agg(
        F.sum("amount").alias("_charges")
    )
    return _returns(rows, ["case_id"]).join(charges, "case_id", "left").withColumn(
        "associated_service_charges", _cents(F.col("_charges"))
    ).drop("_charges")


def returned_payments_by_month(ledger: DataFrame) -> DataFrame:
    """A5, monthly: months with a return or a fee."""
    return _returns(returned_payment_rows(ledger).where("returned or fee or paid_fee"), ["case_id", "month"])


def latest_account(statements: DataFrame) -> DataFrame:
    """The account of each case whose statements reach furthest; ties to the later name."""
    return statements.groupBy("case_id").agg(
        F.max(F.struct("period_end", "account_id")).alias("m")
    ).select("case_id", F.col("m.account_id").alias("account_id"), F.col("m.period_end").alias("period_end"))


def account_coverage(statements: DataFrame, full: DataFrame) -> DataFrame:
    """First and last covered day and complete months of each account; full: case_id, account_id, month."""
    own = statements.where("account_id is not null").groupBy("case_id", "account_id").agg(
        F.min("period_start").alias("first_day"), F.max("period_end").alias("last_day")
    )
    months = full.groupBy("case_id", "account_id").agg(F.array_join(F.array_sort(F.collect_set("month")), ", ").alias("m"))
    return own.join(months, ["case_id", "account_id"], "left").select(
        "case_id", "account_id", "first_day", "last_day", F.coalesce("m", F.lit("None")).alias("complete_months")
    )


def monthly_average(rows: DataFrame, months: DataFrame, name: str) -> DataFrame:
    """Average over a case's chosen months (with coverage_fraction) of the sum of `amount`, months without rows as zero."""
    by = rows.groupBy("case_id", "month").agg(F.sum("amount").alias("s"))
    filled = months.join(by, ["case_id", "month"], "left").withColumn(
        "r", F.coalesce("s", F.lit(0)).cast("double") / F.nullif(F.col("coverage_fraction"), F.lit(0.0))
    )
    return filled.groupBy("case_id").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias(name))


def debt_revenue_ratios(revenue: DataFrame, positions: DataFrame) -> DataFrame:
    """By case, month and verified active position, and in total: monthly obligation to revenue, null if there is no
    revenue. revenue: case_id, month, revenue; positions: case_id, position_id, payment, frequency."""
    per_month = positions.withColumn("obligation", F.col("payment").cast("double") * multiplier(F.col("frequency")))
    each = revenue.join(per_month.select("case_id", "position_id", "obligation"), "case_id")
    total = each.groupBy("case_id", "month", "revenue").agg(F.sum("obligation").alias("obligation")).withColumn("position_id", F.lit("Total"))
    ratio = F.when(F.col("revenue") > 0, F.col("obligation") / F.nullif(F.col("revenue").cast("double"), F.lit(0.0)) * 100)
    return each.unionByName(total.select(*each.columns)).select("case_id", "month", "position_id", ratio.alias("ratio"))


def multiplier(frequency: Column) -> Column:
    """Payments in a month, null for an unknown frequency."""
    out = F.lit(None).cast("double")
    for name, value in MULTIPLIERS.items():
        out = F.when(frequency == name, F.lit(value)).otherwise(out)
    return out


def first_names(names: DataFrame) -> DataFrame:
    """Distinct business names of a case by compact key, the first spelling kept. names: case_id, ord, name."""
    keyed = names.withColumn("key", compact(F.col("name"))).where("key <> ''")
    return keyed.groupBy("case_id", "key").agg(F.min_by("name", "ord").alias("name"))


def ranked_latest(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the order given, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
