"""A bank ledger derived from the star-schema tables, so that every ledger operator can run on generated data.

`orders` become months of activity over several accounts a case; `events` become a daily ledger of one account a case.
"""

from __future__ import annotations

from ledgerloom.functions.money import CENTS, month_of
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CREDIT_TEXTS = [
    "MONERIS SETTLEMENT 4471", "STRIPE PAYOUT", "STRIPE REFUND", "INTERAC e-Transfer Received", "BUSINESS DEPOSIT",
    "CUSTOMER PAYMENT INV 881", "GREENBOX CAPITAL ADVANCE", "GST REFUND CANADA REVENUE", "ONLINE TRANSFER", "CREDIT INTEREST",
    "Cheque returned NSF", "RETURNED ITEM CREDIT", "Virement Interac reçu", "PAIEMENT CLIENT FACTURE 12", "ACME PROPERTY 123",
    "LOAN DISBURSEMENT",
]
DEBIT_TEXTS = [
    "RENT", "GREENBOX CAPITAL PMT 10000017", "BIZFUND PAYMENT TRACE", "NSF item fee 3 @ $45.00", "NSF PAID FEE",
    "TRANSACTION SERVICE CHARGE", "LEASE PAYMENT LEASE 88A", "BDC LOAN", "PAYROLL", "SUPPLIER INVOICE",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(side: Column, key: Column) -> Column:
    credit = F.element_at(F.array(*map(F.lit, CREDIT_TEXTS)), (key % len(CREDIT_TEXTS) + 1).cast("int"))
    debit = F.element_at(F.array(*map(F.lit, DEBIT_TEXTS)), (key % len(DEBIT_TEXTS) + 1).cast("int"))
    return F.when(side == "credit", credit).otherwise(debit)


def signed(amount: str = "amount", side: str = "tx_type") -> Column:
    return F.when(F.col(side) == "credit", F.col(amount)).otherwise(-F.col(amount))


#: Customers whose orders make five cases of four accounts each, so cases and accounts grow with the data.
BLOCK = 500


def account_number() -> Column:
    return (F.floor(F.col("o_custkey") / BLOCK) * 20 + F.col("o_custkey") % 20).cast("long")


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, account_id, currency, stmt_id, stmt_ord, seq, id, date, month, tx_type, amount, description, balance."""
    side = F.when(F.col("o_orderstatus") == "F", "debit").otherwise("credit")
    day = F.col("o_orderdate").cast("date")
    number = account_number()
    rows = table(spark, sf_dir, "orders").select(
        (F.floor(F.col("o_custkey") / BLOCK) * 5 + F.col("o_custkey") % 5).cast("long").alias("case_id"),
        F.concat(F.lit("acct:"), number.cast("string")).alias("account_id"),
        F.when(F.col("o_custkey") % 4 == 0, "USD").otherwise("CAD").alias("currency"),
        F.concat_ws(":", F.lit("acct"), number.cast("string"), month_of(day)).alias("stmt_id"),
        (F.year(day) * 12 + F.month(day)).cast("int").alias("stmt_ord"),
        F.col("o_orderkey").cast("long").alias("id"), day.alias("date"), month_of(day).alias("month"), side.alias("tx_type"),
        F.col("o_totalprice").cast(CENTS).alias("amount"), _text(side, F.col("o_orderkey")).alias("description"),
    )
    whole = Window.partitionBy("account_id").orderBy("date", "id")
    cum = F.sum(signed()).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    shown = F.when(F.col("id") % 13 != 0, cum + F.when(F.col("id") % 101 == 0, F.lit("0.01").cast(CENTS)).otherwise(F.lit(0)))
    return rows.select(
        "*", F.row_number().over(Window.partitionBy("stmt_id").orderBy("date", "id")).alias("seq"), shown.cast(CENTS).alias("balance")
    )


def orders_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement for each account and month with activity: two of seven parts of the time missing or cut short.

    Missing if (month number + account) is divisible by 7, ends on day 15 if it is divisible by 11, else a whole month.
    The opening balance is the sum of all earlier activity of the account.
    """
    ledger = orders_ledger(spark, sf_dir)
    number = F.element_at(F.split("stmt_id", ":"), 2).cast("long")
    own = ledger.groupBy("case_id", "account_id", "currency", "stmt_id", "stmt_ord").agg(
        F.trunc(F.min("date"), "month").alias("period_start"), F.last_day(F.min("date")).alias("month_end"),
        F.sum(signed()).alias("net"),
        F.sum(F.when(F.col("tx_type") == "debit", F.col("amount"))).alias("debits"),
        F.sum(F.when(F.col("tx_type") == "credit", F.col("amount"))).alias("credits"),
    )
    before = Window.partitionBy("account_id").orderBy("stmt_ord").rowsBetween(Window.unboundedPreceding, -1)
    opened = own.withColumn("opening", F.coalesce(F.sum("net").over(before), F.lit(0)).cast(CENTS))
    shorter = (F.col("stmt_ord") + number) % 11 == 0
    return opened.where((F.col("stmt_ord") + number) % 7 != 0).select(
        "case_id", "account_id", "currency", "stmt_id", "stmt_ord", "period_start",
        F.when(shorter, F.date_add("period_start", 14)).otherwise(F.col("month_end")).alias("period_end"), "opening",
        (F.col("opening") + F.col("net")).cast(CENTS).alias("closing"), F.coalesce("debits", F.lit(0)).cast(CENTS).alias("debits"),
        F.coalesce("credits", F.lit(0)).cast(CENTS).alias("credits"),
    )


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily ledger: case_id, account_id, date, month, tx_type, amount, seq, id, description, currency."""
    side = F.when(F.col("event_type").isin("purchase", "error"), "debit").otherwise("credit")
    day = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select(
        (F.col("user_id") % 50).cast("long").alias("case_id"), F.col("user_id").cast("string").alias("account_id"),
        F.lit("CAD").alias("currency"), day.alias("date"), month_of(day).alias("month"), side.alias("tx_type"),
        F.col("value").cast(CENTS).alias("amount"), F.col("ts"), F.col("event_id").cast("long").alias("id"),
        _text(side, F.col("event_id")).alias("description"), F.col("event_type"),
    )
