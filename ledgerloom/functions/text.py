"""Text keys of the ledger: normalised descriptions, account names and company names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters without, in step; a translation is exact for Latin-1 text.
MARKED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"

#: Descriptions that say nothing about who paid, over compact text (capitals and digits only) ...
GENERIC_COMPACT = [
    r"^(?:(?:INTERAC)?E?TRANSFER(?:RECEIVED|RECU|IN|OUT|SENT|AUTODEPOSIT)?(?:[0-9]+|CA[A-Z0-9]{5,})?)$",
    r"^(?:(?:MOBILECHEQUE|MOBILECHECK|ATM|CASH|CHEQUE|CHECK|BUSINESS)?DEPOSIT(?:DA)?[0-9]*)$",
    r"^(?:(?:VIREMENT|TRANSFERT)(?:INTERAC)?(?:RECU|ENTRANT)?[0-9]*)$",
]
#: ... and over normalised text. Whole texts are meant, hence ^(?: and )$ around each.
GENERIC_TEXT = (
    r"^(?:(BUSINESS |CASH |CHEQUE |CHECK |MOBILE |ATM )?DEPOSIT(?: \d+)?|"
    r"INTERAC E[- ]?TRANSFER (IN|OUT)|E[- ]?TRANSFER|"
    r"DEPOT(?: COMPTANT| CHEQUE)?|PAYMENT|TRANSFER)$"
)
#: Words that a statement's text layer runs together, and their repair, applied in this order.
GLUED = [
    ("LoanDisbursement", "Loan Disbursement"), ("InterestPayment", "Interest Payment"), ("TransferFrom", "Transfer From "),
    ("TransferTo", "Transfer To "), ("DirectDebit", "Direct Debit "), ("InvestmentMERCHPAD", "Investment MERCH PAD"),
    ("Fees/DuesINFINITYLEASIN", "Fees/Dues INFINITY LEASIN"), ("LoansRBCLOANPYMT", "Loans RBC LOAN PYMT"),
    ("BillPayment", "Bill Payment "), ("INTERACe-TransferReceived", "INTERAC e-Transfer Received"),
    ("Interace-TransferReceived", "INTERAC e-Transfer Received"), ("INTERACe-TransferSent", "INTERAC e-Transfer Sent"),
]
#: Words that don't make a numbered company a name.
NUMBERED_WORDS = r"\b(CANADA|ONTARIO|QUEBEC|INCORPORATED|INC|LIMITED|LTD|LTEE|CORPORATION|CORP)\b"


def bound(value: Column, f) -> Column:
    """f(value) with the value worked out once for each row, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unaccented(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def normalized(c: Column) -> Column:
    """Accents off, white space collapsed, capitals; null stays null."""
    return F.upper(F.trim(F.regexp_replace(unaccented(c), r"\s+", " ")))


def description_key(c: Column) -> Column:
    """Capitals and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.upper(unaccented(c)), r"[^A-Z0-9]+", " "))


def compact(c: Column) -> Column:
    """Capitals and digits alone."""
    return F.regexp_replace(F.upper(unaccented(c)), r"[^A-Z0-9]", "")


def is_generic(c: Column) -> Column:
    """The description names nobody, so no payer rule may rest on it."""
    out = F.regexp_like(normalized(c), F.lit(GENERIC_TEXT))
    for pattern in GENERIC_COMPACT:
        out = out | F.regexp_like(compact(normalized(c)), F.lit(pattern))
    return out


def account_key(c: Column) -> Column:
    """A stable account id: an extracted account ('ai:...') of several numbers keeps its last one if that has five digits
    or more; spaces go within it. Null if blank."""
    text = F.trim(c)
    raw = F.replace(F.substr(text, F.lit(4)), F.lit(" "), F.lit(""))
    parts = F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0))
    last = F.try_element_at(parts, F.lit(-1))
    body = F.when((F.size(parts) >= 2) & (F.length(last) >= 5), last).otherwise(raw)
    return F.when(F.lower(F.substr(text, F.lit(1), F.lit(3))) == "ai:", F.concat(F.lit("ai:"), body)).when(text != "", text)


def single_glyphs(c: Column) -> Column:
    """Text whose every character is printed twice ('JJaann'), read once; other text stays."""
    return F.when(F.regexp_like(c, F.lit(r"^(?:(.)\1)+$")), F.regexp_replace(c, r"(.)\1", "$1")).otherwise(c)


def searchable_company(c: Column) -> Column:
    """The name has three letters or digits or more, and letters beside a number: a numbered company alone doesn't count."""
    words = F.regexp_replace(F.upper(unaccented(c)), NUMBERED_WORDS, "")
    numbered = F.regexp_like(words, F.lit(r"\d")) & ~F.regexp_like(words, F.lit("[A-Z]"))
    return (F.trim(c) != "") & ~numbered & (F.length(compact(c)) >= 3)


def unglued(c: Column) -> Column:
    out = c
    for joined, apart in GLUED:
        out = F.replace(out, F.lit(joined), F.lit(apart))
    return out
