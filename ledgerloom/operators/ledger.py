"""Ledger assembly: multiset dedupe over uploads, statement validation, continuity, transfers between own accounts and
currency conversion. Windows are keyed by account or statement wherever the rule allows, never by case."""

from __future__ import annotations

from ledgerloom import rules
from ledgerloom.functions.money import CENTS, month_of
from ledgerloom.functions.text import compact
from ledgerloom.operators.coverage import included
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(*keys: str):
    return lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def drop_repeated_activity(rows: DataFrame) -> DataFrame:
    """G1: adds `kept`. The k-th copy of a row (account, currency, date, side, amount, description) in a later statement
    goes if an earlier statement has k copies of it or more; rows without a date always stay.

    rows: case_id, stmt_id, stmt_ord, seq and the columns of a ledger row; those marked exclude_from_ledger (P4) are left
    out.
    """
    rows = included(rows)
    text = F.upper(F.trim(F.regexp_replace("description", r"\s+", " ")))
    key = ["case_id", "account_id", "currency", "date", "tx_type", "_amount", "_text"]
    keyed = rows.withColumn("_amount", F.col("amount").cast(CENTS)).withColumn("_text", text)
    counted = keyed.withColumn("_occ", F.row_number().over(Window.partitionBy(*key, "stmt_id").orderBy("seq")))
    copies = keyed.groupBy(*key, "stmt_id", "stmt_ord").agg(F.count("*").alias("_n"))
    most = copies.withColumn("_prior", F.max("_n").over(_before(*key)("stmt_ord"))).drop("_n", "stmt_ord")
    match = [counted[c].eqNullSafe(most[c]) for c in [*key, "stmt_id"]]
    joined = counted.join(most, match, "left").select(*[counted[c] for c in counted.columns], most["_prior"])
    kept = F.col("date").isNull() | (F.col("_occ") > F.coalesce("_prior", F.lit(0)))
    return joined.withColumn("kept", kept).select(*rows.columns, "kept")


def running_balances(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """V1, row part: adds `running` (the balance that evidence supports) and `mismatch` to rows of
    case_id, stmt_id, seq, tx_type, amount, balance. A printed balance restarts the sum; after a bad row the balance is
    unknown until the next printed one."""
    ok = F.coalesce((F.col("amount") > 0) & F.col("tx_type").isin("credit", "debit"), F.lit(False))
    w = Window.partitionBy("case_id", "stmt_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_ok", ok).withColumn(
        "_cum",
        F.sum(
            F.when(ok, F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))).otherwise(F.lit(0).cast(CENTS))
        ).over(upto).cast(CENTS),
    )
    anchor = F.when(~F.col("_ok"), F.struct(F.lit(True).alias("poison"), F.lit(None).cast(CENTS).alias("base"))).when(
        F.col("balance").isNotNull(), F.struct(F.lit(False).alias("poison"), (F.col("balance") - F.col("_cum")).cast(CENTS).alias("base"))
    )
    own = own.withColumn("_anchor", anchor)
    prev = F.last("_anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_prev", prev).join(statements.select("case_id", "stmt_id", F.col("opening").alias("_open")), ["case_id", "stmt_id"], "left")
    running = F.when(F.col("_ok"), F.when(F.col("_prev").isNull(), F.col("_open") + F.col("_cum")).when(
        ~F.col("_prev.poison"), F.col("_prev.base") + F.col("_cum"))).cast(CENTS)
    own = own.withColumn("running", running)
    return own.withColumn(
        "mismatch", F.coalesce(F.col("_ok") & F.col("balance").isNotNull() & (F.col("running") != F.col("balance")), F.lit(False))
    ).drop("_open", "_prev")


def validate_rows(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """V1: one row for each finding: case_id, stmt_id, seq, code. Dates in the period and in source order (against the
    last valid date), month, unique id, description, one positive side, printed balances."""
    w = Window.partitionBy("case_id", "stmt_id").orderBy("seq")
    checked = running_balances(rows, statements).join(
        statements.select("case_id", "stmt_id", F.col("period_start").alias("_s"), F.col("period_end").alias("_e")), ["case_id", "stmt_id"]
    )
    checked = checked.withColumn("_last", F.last("date", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "_nth", F.row_number().over(Window.partitionBy("case_id", "stmt_id", "id").orderBy("seq"))
    )
    valid = F.coalesce(F.col("_s") <= F.col("_e"), F.lit(False))
    codes = {
        "date_missing": F.col("date").isNull(),
        "date_outside_period": valid & ~F.col("date").between(F.col("_s"), F.col("_e")),
        "date_not_in_order": F.col("date") < F.col("_last"),
        "month_differs": F.col("date").isNotNull() & ~F.col("month").eqNullSafe(month_of(F.col("date"))),
        "id_missing_or_repeated": F.col("id").isNull() | (F.col("_nth") > 1),
        "description_missing": F.coalesce(F.trim("description") == "", F.lit(True)),
        "not_one_positive_side": ~F.col("_ok"),
        "balance_mismatch": F.col("mismatch"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in codes.items()]))
    return checked.select("case_id", "stmt_id", "seq", F.explode(found).alias("code"))


def validate_statements(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """V1 and D16, statement part: one row for each statement that has rows: sums, and which of its printed figures fail:
    totals, numbers of debits and credits (debits_count, credits_count, where printed), the equation, the closing balance."""
    own = running_balances(rows, statements)
    by = own.groupBy("case_id", "stmt_id").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.when(F.col("_ok") & (F.col("tx_type") == "debit"), F.col("amount"))).alias("d"),
        F.sum(F.when(F.col("_ok") & (F.col("tx_type") == "credit"), F.col("amount"))).alias("c"),
        F.max(F.struct("seq", "_ok", "running", "balance")).alias("last"), F.count_if("mismatch").alias("balance_errors"),
        *[F.count_if(F.col("_ok") & (F.col("tx_type") == side)).alias(f"_n_{side}s") for side in ("debit", "credit")],
    )
    counted = [f"{side}_count" for side in ("debits", "credits") if f"{side}_count" in statements.columns]
    cents = lambda name: F.coalesce(F.col(name), F.lit(0)).cast(CENTS)
    final = F.when(F.col("last._ok"), F.coalesce("last.balance", "last.running"))
    out = by.join(statements, ["case_id", "stmt_id"])
    wrong = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "case_id", "stmt_id", "n_rows", cents("d").alias("sum_debits"), cents("c").alias("sum_credits"), "balance_errors",
        wrong(F.col("debits") != cents("d")).alias("debits_wrong"), wrong(F.col("credits") != cents("c")).alias("credits_wrong"),
        wrong(F.col("opening") + cents("c") - cents("d") != F.col("closing")).alias("equation_wrong"),
        wrong(final != F.col("closing")).alias("closing_wrong"),
        F.coalesce(F.col("period_start") > F.col("period_end"), F.lit(True)).alias("period_invalid"),
        *[wrong(F.col(c) != F.col(f"_n_{c.removesuffix('_count')}")).alias(f"{c}_wrong") for c in counted],
    )


def statement_status(statements: DataFrame, row_findings: DataFrame, checks: DataFrame) -> DataFrame:
    """V1: `statements` with `status` turned to review_required where a row has a finding or a printed figure fails; others
    keep theirs. row_findings as of `validate_rows`, checks as of `validate_statements`."""
    fails = [F.col(c) for c in checks.columns if c.endswith("_wrong") or c == "period_invalid"]
    any_fails = (F.col("balance_errors") > 0) | F.array_contains(F.array(*fails), F.lit(True))
    bad = row_findings.select("case_id", "stmt_id").unionByName(checks.where(any_fails).select("case_id", "stmt_id")).distinct().withColumn("_bad", F.lit(True))
    status = F.when(F.col("_bad"), F.lit("review_required")).otherwise(F.col("status"))
    return statements.join(bad, ["case_id", "stmt_id"], "left").select(*[status.alias(c) if c == "status" else F.col(c) for c in statements.columns])


#: The longest period that is looked up month by month.
LONG_DAYS = 3660


def overlapping_periods(statements: DataFrame) -> DataFrame:
    """V3: pairs of statements of one account whose periods overlap, but for a touch at a boundary with different starts.

    Statements meet in the months of their periods, and a pair counts in the first month that both have, so an account may have
    any number of them. A period of more than LONG_DAYS is no month's: it meets all statements of its account."""
    own = statements.where("period_start <= period_end").select("case_id", "account_id", "stmt_id", "stmt_ord", "period_start", "period_end")
    other = own.select(*[F.col(c).alias(f"_{c}") for c in own.columns])
    c = F.col
    same = (c("case_id") == c("_case_id")) & (c("account_id") == c("_account_id")) & (c("stmt_ord") < c("_stmt_ord"))
    touch = (c("period_start") != c("_period_start")) & ((c("period_end") == c("_period_start")) | (c("_period_end") == c("period_start")))
    met = same & (c("period_start") <= c("_period_end")) & (c("_period_start") <= c("period_end")) & ~touch
    month = lambda start, end: F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    short = F.datediff("period_end", "period_start") <= LONG_DAYS
    other_short = F.datediff("_period_end", "_period_start") <= LONG_DAYS
    first = F.trunc(F.greatest("period_start", "_period_start"), "month")
    binned = own.where(short).withColumn("_m", month("period_start", "period_end")).join(
        other.where(other_short).withColumn("_om", month("_period_start", "_period_end")), met & (c("_m") == c("_om")) & (c("_m") == first)
    )
    shown = ["case_id", "account_id", "stmt_id", F.col("_stmt_id").alias("other_id")]
    long = own.where(~short).join(other, met).select(*shown).unionByName(own.where(short).join(other.where(~other_short), met).select(*shown))
    return binned.select(*shown).unionByName(long)


def balance_continuity(statements: DataFrame) -> DataFrame:
    """V4: statements that begin the day after the one before ends, in the same currency, at another balance."""
    w = Window.partitionBy("case_id", "account_id").orderBy("period_start", "stmt_ord")
    prev = lambda c: F.lag(c).over(w)
    return statements.select(
        "case_id", "account_id", "stmt_id", "opening", prev("stmt_id").alias("previous_id"), prev("closing").alias("previous_closing"),
        (F.date_add(prev("period_end"), 1) == F.col("period_start")).alias("_next"), (prev("currency") == F.col("currency")).alias("_same"),
    ).where("_next and _same and previous_closing <> opening").drop("_next", "_same")


#: Fixed value: findings that show figures at odds with each other.
INCONSISTENT = r"(?i)mismatch|does not|inconsistent|duplicat|outside|conflict"


def consistency_flags(statements: DataFrame, findings: DataFrame) -> DataFrame:
    """V4: (case_id, stmt_id, code, evidence) of statements in the ledger: FINANCIAL_INCONSISTENCY for findings (case_id, stmt_id,
    text) that show figures at odds, BALANCE_CONTINUITY where a statement doesn't open as the one before closed."""
    own = included(statements)
    odd = findings.where(F.regexp_like("text", F.lit(INCONSISTENT))).join(own.select("case_id", "stmt_id"), ["case_id", "stmt_id"], "left_semi")
    broken = balance_continuity(own.where("account_id is not null and currency is not null")).select(
        "case_id", "stmt_id", F.lit("BALANCE_CONTINUITY").alias("code"), F.format_string("%s closed at %s, opened at %s", "previous_id", "previous_closing", "opening").alias("evidence")
    )
    return odd.select("case_id", "stmt_id", F.lit("FINANCIAL_INCONSISTENCY").alias("code"), F.col("text").alias("evidence")).unionByName(broken)


def match_fx_transfers(ledger: DataFrame) -> DataFrame:
    """Pairs of one credit and one debit of a date and FX reference, in two known accounts, of equal amount if of one
    currency. One row a pair: case_id, date, reference, credit_id, debit_id."""
    ref = F.regexp_extract(F.upper("description"), r"\bFX\s+TFR\s+C#\s*(\d+)\b", 1)
    rows = ledger.withColumn("reference", ref).where("reference <> '' and date is not null")
    side = lambda s, c: F.max(F.when(F.col("tx_type") == s, F.col(c)))
    pairs = rows.groupBy("case_id", "date", "reference").agg(
        F.count_if(F.col("tx_type") == "credit").alias("nc"), F.count_if(F.col("tx_type") == "debit").alias("nd"),
        *[side(s, c).alias(f"{s}_{c}") for s in ("credit", "debit") for c in ("id", "account_id", "currency", "amount")],
    )
    good = pairs.where("nc = 1 and nd = 1 and credit_account_id <> debit_account_id").where(
        ~(F.col("credit_currency").eqNullSafe(F.col("debit_currency")) & (F.col("credit_amount") != F.col("debit_amount")))
    )
    return good.select("case_id", "date", "reference", "credit_id", "debit_id")


#: How accounts of three families print the other account of a transfer: family, pattern, the group that says
#: 'to' or 'from' (0: none), and what names the account.
TRANSFER_TEXTS = [
    ("bmo_business:", r"(?i)^Transfer,\s*(\d{4})-(\d{4})-(\d{3})\b", 0, "bmo_business:$1$2-$3"),
    ("scotia:", r"(?i)^TRANSFER\s+(TO|FROM)\s+(\d{5})\s+(\d{5})\s+(\d{2})\b", 1, "scotia:$2$3$4"),
    ("vancity:", r"(?i)FUNDSTRANSFER-ONLINE(TO|FROM)#10(\d*)", 1, "vancity:$2"),
]


def transfer_target(account_id: Column, tx_type: Column, description: Column) -> Column:
    """The account that a row of one of three families names as its other side, else null: 'to' must stand in a debit and
    'from' in a credit. One family prints its texts with spaces anywhere."""
    out = F.lit(None).cast("string")
    for family, pattern, side, shown in TRANSFER_TEXTS:
        text = F.regexp_replace(description, r"\s", "") if family == "vancity:" else description
        named = F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, shown)
        told = F.upper(F.regexp_extract(text, pattern, side)) if side else F.lit("")
        right = F.lit(True) if not side else tx_type == F.when(told == "TO", "debit").otherwise("credit")
        out = F.when(F.startswith(account_id, F.lit(family)), F.when(right, F.nullif(named, F.lit("")))).otherwise(out)
    return out


def match_reciprocal_transfers(ledger: DataFrame) -> DataFrame:
    """Credits and debits that name each other's account, of the same date, amount and currency, unique from both
    sides. `ledger` has `target` (see `transfer_target`; null if none) and `holder` (may be null):
    accounts of the 'bmo_business:' and 'scotia:' families also need one holder and a known currency. A credit without a
    unique debit contests nothing. One row a pair: case_id, credit_id, debit_id."""
    named = ledger.where("target is not null")
    cols = ["case_id", "id", "account_id", "target", "date", "amount", "currency", "holder"]
    c = named.where("tx_type = 'credit'").select(*[F.col(x).alias(f"c_{x}") for x in cols])
    d = named.where("tx_type = 'debit'").select(*[F.col(x).alias(f"d_{x}") for x in cols])
    met = c.join(
        d,
        (F.col("c_case_id") == F.col("d_case_id")) & (F.col("c_target") == F.col("d_account_id")) & (F.col("d_target") == F.col("c_account_id"))
        & (F.col("c_account_id") != F.col("d_account_id")) & F.col("c_date").eqNullSafe(F.col("d_date"))
        & (F.col("c_amount") == F.col("d_amount")) & F.col("c_currency").eqNullSafe(F.col("d_currency")),
    )
    once = met.withColumn("n", F.count("*").over(Window.partitionBy("c_case_id", "c_id"))).where("n = 1")
    both = once.withColumn("m", F.count("*").over(Window.partitionBy("d_case_id", "d_id"))).where("m = 1")
    family = F.startswith("c_account_id", F.lit("bmo_business:")) | F.startswith("c_account_id", F.lit("scotia:"))
    holder = (F.trim("c_holder") != "") & (compact(F.col("c_holder")) == compact(F.col("d_holder")))
    known = F.col("c_currency").isNotNull() & ~F.col("c_currency").isin("", "Unknown")
    return both.where(~family | F.coalesce(holder & known, F.lit(False))).select(
        F.col("c_case_id").alias("case_id"), F.col("c_id").alias("credit_id"), F.col("d_id").alias("debit_id")
    )


def mark_transfers(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both legs of each pair (case_id, credit_id, debit_id) become transfers between own accounts."""
    legs = pairs.select("case_id", F.col("credit_id").alias("id"), "debit_id").select("case_id", "id").unionByName(
        pairs.select("case_id", F.col("debit_id").alias("id"))
    ).distinct().withColumn("_own", F.lit(True))
    out = ledger.join(legs, ["case_id", "id"], "left")
    own = F.coalesce("_own", F.lit(False))
    values = {
        "internal_transfer": F.lit(True), "category": F.lit(rules.INTERNAL), "classification_source": F.lit("matched_accounts"),
        "revenue_status": F.when(F.col("tx_type") == "credit", rules.NON).otherwise(F.col("revenue_status")),
        "reviewed": F.when(F.col("tx_type") == "credit", F.lit(True)).otherwise(F.col("reviewed")),
    }
    return out.select(*[F.when(own, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in ledger.columns])


def to_reporting_currency(ledger: DataFrame, rates: DataFrame, amounts: tuple[str, ...] = ("amount",)) -> DataFrame:
    """Adds reporting_* columns in CAD. rates: currency, rate. A case with any currency unknown or without a positive
    rate is left out whole. Legs aren't rounded."""
    known = rates.where("rate > 0").unionByName(ledger.sparkSession.createDataFrame([("CAD",)], "currency string").select(
        "currency", F.lit(1).cast("decimal(18,6)").alias("rate"))).dropDuplicates(["currency"])
    joined = ledger.join(known, "currency", "left")
    bad = joined.where("rate is null").select("case_id").distinct()
    good = joined.join(bad, "case_id", "left_anti")
    return good.select(*ledger.columns, "rate", *[(F.col(c).cast(CENTS) * F.col("rate")).alias(f"reporting_{c}") for c in amounts])


def currency_of(statements: DataFrame, suspect: bool = False, overrides: DataFrame | None = None) -> DataFrame:
    """An underwriter's choice, else a printed currency, else CAD, or unknown if other currencies are suspected.
    overrides: stmt_id, choice. Adds currency_source and currency_unknown."""
    out = statements if overrides is None else statements.join(overrides.select("stmt_id", "choice"), "stmt_id", "left")
    choice = F.lit(None).cast("string") if overrides is None else F.col("choice")
    printed = F.when(~F.coalesce(F.col("currency"), F.lit("Unknown")).isin("Unknown", ""), F.col("currency"))
    currency = F.coalesce(choice, printed, F.lit(None if suspect else "CAD").cast("string"))
    source = F.when(choice.isNotNull(), "underwriter_confirmation").when(printed.isNotNull(), "printed").otherwise(
        "not_printed" if suspect else "case_policy_default_cad"
    )
    kept = [c for c in statements.columns if c != "currency"]
    return out.select(*kept, currency.alias("currency"), source.alias("currency_source"),
                      (~F.coalesce(currency, F.lit("")).isin("CAD", "USD")).alias("currency_unknown"))


def replace_findings(findings: DataFrame, fresh: DataFrame, rule_set: str) -> DataFrame:
    """V2: findings of other rule sets stay, those of `rule_set` give way to `fresh`; each stands once."""
    return findings.where(F.col("rule_set") != rule_set).unionByName(fresh.withColumn("rule_set", F.lit(rule_set))).dropDuplicates()


def refresh_currency(ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """The currency that a row's statement (stmt_id, account_id) has now; rows without a statement keep theirs."""
    now = statements.select("stmt_id", "account_id", F.col("currency").alias("_now"), F.lit(True).alias("_known")).dropDuplicates(["stmt_id", "account_id"])
    out = ledger.join(now, ["stmt_id", "account_id"], "left")
    kept = F.when(F.col("_known"), F.col("_now")).otherwise(F.col("currency"))
    return out.select(*[kept.alias(c) if c == "currency" else F.col(c) for c in ledger.columns])
