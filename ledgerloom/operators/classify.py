"""Classification of ledger rows by ordered rules and recorded decisions. All column expressions; joins where two tables
meet: nothing is kept in memory but the rules themselves."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from ledgerloom import rules
from ledgerloom.functions.text import bound, description_key, is_generic, normalized
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.regexp_like(text, F.lit(p)) for p in patterns))


def exclusion_category(description: Column) -> Column:
    """Category of a deposit that is no revenue whatever else it looks like, else null."""
    return _exclusion(description, 1)


def exclusion_reason(description: Column) -> Column:
    return _exclusion(description, 2)


def _exclusion(description: Column, field: int) -> Column:
    return bound(normalized(description), lambda text: _exclusion_of(text, field))


def _exclusion_of(text: Column, field: int) -> Column:
    out = F.lit(None).cast("string")
    for i in reversed(range(len(rules.EXCLUSIONS))):
        hit = F.regexp_like(text, F.lit(rules.EXCLUSIONS[i][0]))
        if rules.EXCLUSIONS[i][1] == rules.INTERNAL:
            hit = hit & ~F.regexp_like(text, F.lit(rules.SETTLEMENT_TRANSFER))
        out = F.when(hit, F.lit(rules.EXCLUSIONS[i][field])).otherwise(out)
    return out


# ---- Lenders ----------------------------------------------------------------------------------------------------------


def _key(name: str) -> str:
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.upper()).split())


#: (alias key, tier, lender), the longest printed name first, ties in order of declaration.
LENDER_ALIASES = [
    (_key(alias), tier, lender)
    for alias, tier, lender in sorted(
        (
            (alias, tier, lender)
            for tier, group in (("Premium", rules.PREMIUM_LENDERS), ("Standard", rules.STANDARD_LENDERS))
            for lender, names in group.items()
            for alias in names
        ),
        key=lambda x: -len(x[0]),
    )
]


_ALIAS_ROWS = json.dumps([{"name": f" {key} ", "tier": tier, "lender": lender} for key, tier, lender in LENDER_ALIASES])


def _pair(tier: Column | str, lender: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(tier).alias("tier"), as_column(lender).alias("lender"))


def _chain(text: Column, rows: list[tuple[str, str, str]], otherwise: Column) -> Column:
    out = otherwise
    for pattern, tier, lender in reversed(rows):
        out = F.when(F.regexp_like(text, F.lit(pattern)), _pair(tier, lender)).otherwise(out)
    return out


def lender_match(description: Column) -> Column:
    """struct(tier, lender) of the lender that a description names, else null. Names are looked for as whole words of the
    description key, in one array of constants: as separate conditions they would outgrow generated code."""
    return bound(description_key(description), _lender_of)


def _lender_of(text: Column) -> Column:
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    names = F.from_json(F.lit(_ALIAS_ROWS), "array<struct<name: string, tier: string, lender: string>>")  # folded to a constant
    hit = F.get(F.filter(names, lambda a: F.contains(padded, a["name"])), F.lit(0))
    named = F.when(hit.isNotNull(), _pair(hit["tier"], hit["lender"]))
    loan = F.regexp_extract(text, r"TRANSFER TO LOAN (\d+)", 1)
    numbered = F.when(loan != "", _pair("Bank", F.concat(F.lit("Bank loan #"), loan))).otherwise(named)
    known = F.when(F.regexp_like(text, F.lit(r"\bBDC\b")), _pair("Bank", "BDC")).otherwise(numbered)
    return _chain(text, rules.EXTRA_LENDERS, known)


def debt_match(description: Column, tx_type: Column, account_id: Column, lender: Column | None = None) -> Column:
    """struct(tier, lender) of the creditor that a debit may pay, else null; `lender` may stand in for `lender_match`."""
    return F.when(tx_type == "debit", bound(description_key(description), lambda text: _creditor_of(text, account_id, lender)))


def _creditor_of(text: Column, account_id: Column, lender: Column | None) -> Column:
    fee_text = F.regexp_replace(text, rules.FEE_EXCEPTION, "$1")
    prefix, label, tier, name = rules.SERVUS_INTEREST
    out = _lender_of(text) if lender is None else lender
    out = _chain(text, rules.LATE_CREDITORS, out)
    out = F.when(F.startswith(F.coalesce(account_id, F.lit("")), F.lit(prefix)) & (text == label), _pair(tier, name)).otherwise(out)
    out = _chain(text, rules.CREDITORS, out)
    out = _chain(text, [rules.FIRST_CREDITOR, *rules.EXTRA_LENDERS], out)
    skip = F.regexp_like(text, F.lit(rules.NOT_A_PAYMENT)) | F.regexp_like(fee_text, F.lit(rules.FEE_LABEL))
    return F.when(~skip, out)


def contract_reference(description: Column, lender: Column) -> Column:
    """What tells contracts of one lender apart: a labelled contract id, or the text without long traces if the creditor
    is unidentified; else empty."""
    text = description_key(description)
    contract = F.regexp_extract(text, rules.CONTRACT, 0)
    return F.when(F.startswith(lender, F.lit("Unidentified")), F.trim(F.regexp_replace(text, r"\b\d{8,}\b", ""))).otherwise(contract)


# ---- Categories and states ----------------------------------------------------------------------------------------------


def suggested_category(
    description: Column, tx_type: Column, account_id: Column | None = None, matcher: Callable[[Column], Column] | None = None
) -> Column:
    """K2; matcher (X1): a caller's description -> struct(tier, lender) in place of `lender_match`."""
    named = (matcher or lender_match)(description)
    account_id = F.lit("") if account_id is None else account_id
    text = F.upper(description)
    credit = F.coalesce(
        exclusion_category(description),
        F.when(_any(text, rules.REVERSAL_PATTERNS), rules.REFUND)
        .when(_any(text, rules.INTERNAL_PATTERNS), rules.INTERNAL)
        .when(_any(text, rules.GOVERNMENT_PATTERNS), rules.GOVERNMENT)
        .when(named.isNotNull(), rules.LOAN)
        .when(_any(text, rules.POS_PATTERNS), rules.POS)
        .when(_any(text, rules.CUSTOMER_PATTERNS), rules.CUSTOMER)
        .otherwise(rules.UNKNOWN),
    )
    debit = (
        F.when(_any(text, rules.REVERSAL_PATTERNS), rules.REFUND)
        .when(debt_match(description, tx_type, account_id, None if matcher is None else named).isNotNull(), rules.FINANCING)
        .otherwise(rules.OPERATING)
    )
    return F.when(tx_type == "credit", credit).otherwise(debit)


def status_of(category: Column, tx_type: Column) -> Column:
    return (
        F.when(tx_type != "credit", rules.NOT_APPLICABLE)
        .when(F.startswith(category, F.lit("True Revenue")), rules.TRUE)
        .when(F.startswith(category, F.lit("Non-Revenue")), rules.NON)
        .otherwise(rules.REVIEW)
    )


def is_revenue() -> Column:
    """Reviewed true revenue that is no transfer between own accounts."""
    return (
        ~F.coalesce(F.col("internal_transfer"), F.lit(False))
        & (F.col("tx_type") == "credit") & (F.col("revenue_status") == rules.TRUE) & F.coalesce(F.col("reviewed"), F.lit(False))
    )


def classify(ledger: DataFrame, matcher: Callable[[Column], Column] | None = None) -> DataFrame:
    """K2 and K5: adds category, revenue_status, classification_source, classification_reason, reviewed,
    internal_transfer and transfer_match to rows with description, tx_type and account_id. matcher: see `suggested_category`."""
    servus = F.startswith(F.coalesce("account_id", F.lit("")), F.lit(rules.SERVUS_INTEREST[0]))
    if ledger.isStreaming:  # row by row: a stream has no distinct descriptions at hand
        out = ledger.withColumn("category", suggested_category(F.col("description"), F.col("tx_type"), F.col("account_id"), matcher))
    else:
        account = F.when(F.col("_servus"), F.lit(rules.SERVUS_INTEREST[0])).otherwise(F.lit(""))
        texts = ledger.select("description", "tx_type", servus.alias("_servus")).distinct()
        named = texts.select(
            F.col("description").alias("_d"), F.col("tx_type").alias("_t"), F.col("_servus").alias("_s"),
            suggested_category(F.col("description"), F.col("tx_type"), account, matcher).alias("category"),
        )
        same = F.col("description").eqNullSafe(F.col("_d")) & F.col("tx_type").eqNullSafe(F.col("_t")) & (servus == F.col("_s"))
        out = ledger.join(named, same, "left").drop("_d", "_t", "_s")
    out = out.withColumn("revenue_status", status_of(F.col("category"), F.col("tx_type")))
    settled = (F.col("revenue_status") != rules.REVIEW) | (F.col("tx_type") == "debit")
    return out.select(
        "*", F.when(settled, "rules").otherwise("unclassified").alias("classification_source"),
        F.lit("").alias("classification_reason"), (F.col("revenue_status") != rules.REVIEW).alias("reviewed"),
        F.lit(False).alias("internal_transfer"), F.lit("").alias("transfer_match"),
    )


def set_decision(df: DataFrame, when: Column, status: Column, source: Column, reason: Column, category: Column | None = None) -> DataFrame:
    """Give the rows of a condition a new state; transfers between own accounts stay non-revenue whatever is decided."""
    own = F.coalesce(F.col("internal_transfer"), F.lit(False))
    status = F.when(own, rules.NON).otherwise(status)
    base = F.col("category") if category is None else category
    kept = (
        F.when((status == rules.TRUE) & ~F.startswith(base, F.lit("True Revenue")), rules.TRUE_CATEGORY)
        .when((status == rules.NON) & ~F.startswith(base, F.lit("Non-Revenue")), rules.NON_CATEGORY)
        .when(status == rules.REVIEW, rules.UNKNOWN)
        .otherwise(base)
    )
    when = F.coalesce(when, F.lit(False))
    values = {
        "category": kept,
        "revenue_status": status,
        "reviewed": status.isin(rules.TRUE, rules.NON),
        "classification_source": F.when(own, "matched_accounts").otherwise(source),
        "classification_reason": F.when(own, "Matching FX reference and date in another uploaded account.").otherwise(reason),
    }
    changed = df.withColumn("_when", when)
    return changed.select(
        *[F.when(F.col("_when"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns]
    )


def classify_local(ledger: DataFrame, payer_rules: DataFrame | None = None) -> DataFrame:
    """K6: exclusions beat everything but an underwriter's decision; then merchant references, merchant services and
    explicit receipts; recognised rows get their reason; then remembered payer rules (K7)."""
    text = normalized(F.col("description"))
    debits = ledger.where("tx_type = 'debit'").select(
        "case_id", "account_id", F.regexp_extract(text, r"^MRCH(\d+)\s*\|", 1).alias("merchant")
    ).where("merchant <> ''").distinct().withColumn("has_fees", F.lit(True))
    deposit = F.when(
        (F.col("tx_type") == "credit") & F.startswith("account_id", F.lit("servus:")), F.regexp_extract(text, r"^DP(\d+)\s*\|", 1)
    )
    out = ledger.withColumn("merchant", F.nullif(deposit, F.lit(""))).join(debits, ["case_id", "account_id", "merchant"], "left")
    credit = (F.col("tx_type") == "credit") & ~F.startswith("classification_source", F.lit("underwriter"))
    own = F.col("description")
    facts = ledger.where("tx_type = 'credit'").select("description").distinct().select(
        own.alias("_d"), exclusion_category(own).alias("_category"), exclusion_reason(own).alias("_reason"),
        F.regexp_like(text, F.lit(rules.MERCHANT_SERVICE)).alias("_service"), F.regexp_like(text, F.lit(rules.EXPLICIT_RECEIPT)).alias("_explicit"),
    )
    out = out.join(facts, own.eqNullSafe(F.col("_d")), "left")
    gone = F.col("_category")
    out = out.withColumn("_gone", credit & gone.isNotNull()).withColumn("_was", F.col("revenue_status"))
    out = set_decision(out, F.col("_gone"), F.lit(rules.NON), F.lit("rules"), F.col("_reason"), gone)
    open_ = credit & ~F.col("_gone") & (F.col("_was") == rules.REVIEW)
    merchant = open_ & F.coalesce("has_fees", F.lit(False))
    service = open_ & ~merchant & F.coalesce("_service", F.lit(False))
    explicit = open_ & ~merchant & ~service & F.coalesce("_explicit", F.lit(False))
    out = out.withColumn("_m", merchant).withColumn("_s", service).withColumn("_e", explicit)
    out = set_decision(out, F.col("_m"), F.lit(rules.TRUE), F.lit("merchant_reference_rule"),
                       F.lit("Merchant deposit reference matches merchant fee debits in this account."), F.lit(rules.POS))
    out = set_decision(out, F.col("_s"), F.lit(rules.TRUE), F.lit("rules"), F.lit("Repeated merchant-service deposit reference."))
    out = set_decision(out, F.col("_e"), F.lit(rules.TRUE), F.lit("rules"), F.lit("Explicit customer receipt or merchant settlement."))
    known = credit & ~F.col("_gone") & (F.col("_was") != rules.REVIEW) & (F.trim(F.coalesce("classification_reason", F.lit(""))) == "")
    reason = F.when(known, F.concat(F.lit("Recognized transaction description: "), "category")).otherwise(F.col("classification_reason"))
    out = out.select(*[reason.alias(c) if c == "classification_reason" else F.col(c) for c in ledger.columns])
    return out if payer_rules is None else apply_rules(out, payer_rules)


def apply_rules(ledger: DataFrame, payer_rules: DataFrame) -> DataFrame:
    """K7: pending, named, non-excluded deposits take the state remembered for their account and description.

    payer_rules: case_id, account_id, description_key (normalised), status; one row a key.
    """
    own = payer_rules.select("case_id", "account_id", F.col("description_key").alias("_key"), F.col("status").alias("_rule"))
    out = ledger.withColumn("_key", normalized(F.col("description"))).join(own, ["case_id", "account_id", "_key"], "left")
    when = (
        (F.col("tx_type") == "credit") & (F.col("revenue_status") == rules.REVIEW) & F.col("_rule").isin(rules.TRUE, rules.NON)
        & ~is_generic(F.col("description")) & exclusion_category(F.col("description")).isNull()
    )
    out = out.withColumn("_use", when)
    out = set_decision(out, F.col("_use"), F.col("_rule"), F.lit("verified_payer_rule"),
                       F.lit("Previously verified exact description for this account and case."))
    return out.select(*ledger.columns)


def contains_filters(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose columns contain the given texts, whatever their case; blank queries and unknown columns don't count."""
    for name, query in filters.items():
        if query and query.strip() and name in df.columns:
            df = df.where(F.contains(F.lower(F.col(name).cast("string")), F.lit(query.strip().lower())))
    return df
