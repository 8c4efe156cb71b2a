"""Statement documents as tables: words, characters, lines and page texts that an extraction wrote. Layouts are small rule
tables; every rule is a condition over columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from ledgerloom.functions.text import bound, compact
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How an institution names itself on its first pages.
INSTITUTIONS = {
    "TD": r"\bTD\b|Toronto.Dominion", "RBC": r"Royal Bank|\bRBC\b|banqueroyale", "BMO": r"\bBMO\b|Bank of Montreal|Banque de Montr",
    "Scotiabank": r"Scotiabank|scotiabank.com", "CIBC": r"\bCIBC\b", "ATB": r"\bATB\b|atb.com", "Servus": r"Servus|servus.ca",
    "Vancity": r"Vancity", "National Bank": r"National Bank|Banque Nationale", "Wise": r"Wise Payments", "Neo": r"Neo Everyday",
    "Flinks": r"flinks dashboard|dashboard.flinks.com",
}
#: Software that edits documents.
EDITORS = r"(?i)photoshop|illustrator|\bgimp\b|canva|\bword\b|libreoffice|\bfoxit\b|\bacrobat\b"
SPARSE_PAGE = 40
LINE_HEIGHT = 3.0
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def text_quality(text: Column) -> Column:
    """no_text, garbled (glyph codes, replacement characters or more than 1 % control characters) or text_present."""
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    garbled = F.contains(text, F.lit("(cid:")) | F.contains(text, F.lit("�")) | (control > 0.01 * F.greatest(F.lit(1), F.length(text)))
    blank = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) == 0
    return F.when(blank, "no_text").when(garbled, "garbled").otherwise("text_present")


def page_kind(text: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= SPARSE_PAGE, "text").otherwise("image_or_sparse")


def lines_of_words(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, top, text). Words belong to a line whose first word's top is at most 3 above theirs; the
    anchors of a page are a fold over its distinct tops, so what one row holds is bounded by a page."""
    tops = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("top")).alias("tops"))
    start = F.array().cast("array<double>")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    anchors = F.aggregate(
        "tops", start, lambda acc, t: F.when(last(acc).isNull() | (t - last(acc) > LINE_HEIGHT), F.concat(acc, F.array(t))).otherwise(acc)
    )
    anchored = words.join(tops.select("doc_id", "page", anchors.alias("anchors")), ["doc_id", "page"])
    placed = anchored.withColumn("line", F.size(F.filter("anchors", lambda a: a <= F.col("top"))))
    return placed.groupBy("doc_id", "page", "line").agg(
        F.min("top").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text")
    )


def cells(words: DataFrame, layout: DataFrame) -> DataFrame:
    """Words put into the columns of a layout by their left or right edge: (doc_id, page, line, role, text). words: also
    layout, line; layout: layout, role, lo, hi, edge ('x0' or 'x1'): a small table."""
    edge = F.when(F.col("edge") == "x1", F.col("x1")).otherwise(F.col("x0"))
    met = words.join(layout, "layout").where((edge >= F.col("lo")) & (edge < F.col("hi")))
    return met.groupBy("doc_id", "page", "line", "role").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text")
    )


def carried_dates(rows: DataFrame, day: str, reset: Column, keys: list[str], order: str) -> DataFrame:
    """D3: adds `carried`: the last printed date down the rows; an unreadable date (`reset`) breaks the chain."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = rows.withColumn("_reset", F.sum(reset.cast("int")).over(w))
    inside = Window.partitionBy(*keys, "_reset").orderBy(order)
    return out.withColumn("carried", F.last(day, ignorenulls=True).over(inside)).drop("_reset")


def day_in_period(month: Column, day: Column, start: Column, end: Column) -> Column:
    """The one date of this month and day within a period, else null."""
    years = F.when(start <= end, F.sequence(F.year(start), F.year(end)))
    days = F.transform(years, lambda y: F.concat_ws("-", y, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date"))
    fitting = F.filter(days, lambda d: d.between(start, end))
    return F.when(F.size(fitting) == 1, F.element_at(fitting, 1))


def _leading(text: Column, start: Column, end: Column) -> Column:
    """struct(day, rest) of a line that begins with a date: 'Mon d', 'd Mon' or ISO; null if it doesn't, or if its year isn't
    plain from the period."""
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})(\s|$)", 1)
    parts = F.split(iso, r"[-/.]")
    plain = F.concat_ws("-", parts[0], F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0")).try_cast("date")
    first, second = r"^([A-Za-z]{3})\s*(\d{1,2})(?:\s|$)", r"^(\d{1,2})\s*([A-Za-z]{3})(?:\s|$)"
    found = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    mon, num = F.coalesce(found(first, 1), found(second, 2)), F.coalesce(found(first, 2), found(second, 1))
    whole = F.coalesce(F.nullif(iso, F.lit("")), found(first, 0), found(second, 0))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(mon)).cast("int")
    day = F.when(iso != "", plain).when(month > 0, day_in_period(month, num.try_cast("int"), start, end))
    return F.when(day.isNotNull(), F.struct(day.alias("day"), F.substr(t, F.length(whole) + 1).alias("rest")))


def leading_dates(text: Column, start: Column, end: Column) -> Column:
    """up to two dates that a line begins with, in order."""
    return bound(_leading(text, start, end), lambda one: F.array_compact(F.array(one["day"], _leading(one["rest"], start, end)["day"])))


def leading_date(text: Column, start: Column, end: Column) -> Column:
    """the first date that a line begins with, else null."""
    return _leading(text, start, end)["day"]


def stitched(lines: DataFrame, is_row: Column, keys: list[str], order: str, forward: bool = False) -> DataFrame:
    """Wrapped text joined to its amount row: to the row before it, or with `forward` to the row after it. Lines before
    the first (after the last) row go with none and are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("_row", F.coalesce(is_row, F.lit(False)))
    island = own.withColumn("_i", F.sum(F.col("_row").cast("int")).over(upto)).where("_i > 0")
    return island.groupBy(*keys, "_i").agg(
        F.max(F.when(F.col("_row"), F.col(order))).alias(order),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), " ").alias("text"),
    ).drop("_i")


def sections(lines: DataFrame, heading: Column, keys: list[str], order: str, closes: Column | None = None) -> DataFrame:
    """Adds `section`, the heading that a line stands under; a closing line ends it."""
    w = Window.partitionBy(*keys).orderBy(order)
    mark = heading if closes is None else F.coalesce(heading, F.when(closes, F.lit("")))
    return lines.withColumn("section", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")))


def missing_accounts(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Accounts that a document lists but has no section for, or the other way round: doc_id, account_id, side."""
    a, b = listed.distinct().withColumn("_l", F.lit(1)), found.distinct().withColumn("_f", F.lit(1))
    both = a.join(b, ["doc_id", "account_id"], "full").where("_l is null or _f is null")
    return both.select("doc_id", "account_id", F.when(F.col("_f").isNull(), "listed").otherwise("found").alias("side"))


def captured(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The first group of each pattern over a page's text, as a column of its name; empty is null."""
    return pages.select("*", *[F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias(n) for n, p in patterns.items()])


#: The layouts, in the order in which they are tried, and what the first page of each holds. A test is a text as
#: it stands, 'lower:' a text whatever its case, 'packed:' one without white space or case, 'like:' a pattern, 'any:' a pattern that
#: some page holds.
ROUTES = [
    ("neo", ["Neo Everyday Account Summary"]),
    ("wise", ["Wise Payments", "statement"]),
    ("vancity", ["packed:INDEPENDENTBUSINESSACCOUNT#", "lower:vancity"]),
    ("rbc_french", ["lower:rbcbanqueroyale.com", "Sommaire de votre compte"]),
    ("atb", ["lower:atb.com", "like:Consolidated Statement|Deposit Account Statement"]),
    ("activity_screen", ["Scotiabank", "Current Account", "Transactions", "like:^((?!Account Summary for this Period)[\\s\\S])*$"]),
    ("rbc", ["packed:ROYALBANKOFCANADA", "Account Summary for this Period"]),
    ("scotia", ["any:(?i)scotiabank|bank of nova scotia", "like:Business Account\\s+\\d{5}\\s+\\d{5}\\s+\\d{2}", "Account Summary for this Period"]),
    ("td", ["like:Statement of Account[\\s\\S]*CHEQUE/DEBIT|CHEQUE/DEBIT[\\s\\S]*Statement of Account"]),
    ("td", ["Account Activity", "Withdrawals", "Deposits"]),
    ("flinks", ["like:(?i)flinks dashboard|dashboard\\.flinks\\.com"]),
    ("servus", ["lower:servus.ca", "Business Plan 150 #"]),
    ("cibc", ["lower:cibc account statement", "lower:transaction details", "lower:account number"]),
    ("bmo_business", ["lower:bmo.com", "Business Banking statement"]),
    ("bmo_business_french", ["lower:bmo.com", "like:(?i)p[eé]riode termin[eé]e le"]),
    ("national_french", ["MM JJ", "Période du"]),
]


def routed(text: Column, routes: list[tuple[str, list[str]]] | None = None, pages: Column | None = None) -> Column:
    """The first layout all of whose tests a first page meets (see ROUTES); unsupported if none, image_only without text.
    pages: an array of the texts of all pages, for tests that any page may meet; without it the first page stands for all."""
    out = F.when(F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"\S")), "unsupported").otherwise("image_only")
    packed = F.upper(F.regexp_replace(text, r"\s", ""))
    every = F.array(text) if pages is None else pages
    for name, needed in reversed(ROUTES if routes is None else routes):
        hit = F.lit(True)
        for n in needed:
            kind, rest = next(((k, n[len(k) + 1 :]) for k in ("lower", "packed", "like", "any") if n.startswith(f"{k}:")), ("", n))
            hit = hit & {
                "lower": lambda x: F.contains(F.lower(text), F.lit(x.lower())), "packed": lambda x: F.contains(packed, F.lit(x)),
                "like": lambda x: F.regexp_like(text, F.lit(x)), "any": lambda x: F.exists(every, lambda t: F.coalesce(F.regexp_like(t, F.lit(x)), F.lit(False))), "": lambda x: F.contains(text, F.lit(x)),
            }[kind](rest)
        out = F.when(hit, name).otherwise(out)
    return out


def identified(pages: DataFrame) -> DataFrame:
    """One row a document: institution (if just one names itself on its first two pages), format, pages, printed total."""
    hits = [F.when(F.regexp_like("head", F.lit("(?i)" + p)), F.lit(n)) for n, p in INSTITUTIONS.items()]
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page") <= 2, F.struct("page", "text")))), lambda x: x["text"]), "\n")
    totals = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\bPage\s+\d+\s+(?:of|de|/)\s*(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    readable = F.count_if(F.length(F.trim("text")) > 0)
    own = pages.groupBy("doc_id").agg(head.alias("head"), F.count("*").alias("pages"), readable.alias("readable"), F.max(F.array_max(totals)).alias("printed_total"))
    names = F.array_compact(F.array(*hits))
    return own.select(
        "doc_id", F.when(F.size(names) == 1, F.get(names, F.lit(0))).alias("institution"),
        F.when(F.col("readable") == F.col("pages"), "text").when(F.col("readable") == 0, "image-only").otherwise("mixed").alias("format"), "pages",
        F.coalesce(F.col("printed_total") > F.col("pages"), F.lit(False)).alias("pages_missing"),
    )


#: Where a header ends, labels of names, what a name is followed by, and companies by suffix or by number.
TABLE_TITLE = r"(?i)Transaction\s*details|Account\s+(?:Activity\s+)?Details\b"
NAME_LABEL = r"(?i)(?:Business\s*name|Operating\s*as)\s*:\s*\n([^\n]+)"
NAME_TAIL = r"(?i)\s+For\s*questions[\s\S]*"
SUFFIXED = r"(?i)^[\w &.,\-/’']{2,100}\s+(INC\.?|LTD\.?|LIMITED|LT[ÉE]E\.?|CORP\.?|CORPORATION)$"
NUMBERED = r"(?i)^(\d[\d \-]{4,}\d)\s*(CANADA|ONTARIO|QU[ÉE]BEC)\s*(INC\.?|LTD\.?|LIMITED|LT[ÉE]E\.?)$"


def header_names(docs: DataFrame) -> DataFrame:
    """Business names of a document: labelled ones anywhere (as the header spells them, if it has them), then the lines
    above the transaction table with a corporate suffix or of a numbered company; distinct by key, the first spelling kept:
    (doc_id, key, name)."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    header = F.element_at(F.split("text", TABLE_TITLE), 1)
    every = docs.select("doc_id", "text", F.split(header, "\n").alias("lines"))
    hits = F.transform(F.regexp_extract_all("text", F.lit(NAME_LABEL), F.lit(1)), lambda x: F.trim(x))
    labelled = every.select("doc_id", "lines", F.posexplode(hits).alias("pos", "printed"))
    cut = lambda x: F.regexp_replace(x, NAME_TAIL, "")
    spelled = F.get(F.filter("lines", lambda x: compact(cut(x)) == compact(F.col("printed"))), F.lit(0))
    own = labelled.select("doc_id", (F.col("pos") - 1_000_000).alias("pos"), squeezed(cut(F.coalesce(spelled, "printed"))).alias("name"))
    lines = every.select("doc_id", F.posexplode("lines").alias("pos", "line")).withColumn("line", squeezed("line"))
    part = lambda k: F.regexp_extract("line", NUMBERED, k)
    number = F.concat(F.regexp_replace(part(1), r"\s", ""), F.lit(" "), F.upper(part(2)), F.lit(" "), F.rtrim(F.upper(part(3)), F.lit(".")), F.lit("."))
    name = F.when(F.regexp_like("line", F.lit(NUMBERED)), number).when(F.regexp_like("line", F.lit(SUFFIXED)), F.col("line"))
    found = own.unionByName(lines.select("doc_id", "pos", name.alias("name"))).where("trim(name) <> ''").withColumn("key", compact(F.col("name")))
    return found.groupBy("doc_id", "key").agg(F.min_by("name", "pos").alias("name"))


def integrity_flags(docs: DataFrame, chars: DataFrame | None = None) -> DataFrame:
    """(doc_id, code) of a file's bytes as Latin-1 text (`raw`), its metadata and digits printed over each other; where
    docs has them, of its annotations (kinds; links don't count) and of a file that couldn't be read, which is no clean one."""
    flags = {
        "PDF_REVISIONS": (F.regexp_count("raw", F.lit("%%EOF")) > 1) & F.regexp_like("raw", F.lit(r"/Prev\s+\d+")),
        "EDITING_SOFTWARE": F.regexp_like(F.coalesce("producer", F.lit("")), F.lit(EDITORS)),
        "NO_TEXT_LAYER": F.trim(F.coalesce("text", F.lit(""))) == "",
    }
    if "annotations" in docs.columns:
        flags["ANNOTATIONS"] = F.exists("annotations", lambda a: a != "Link")
    if "readable" in docs.columns:
        flags["UNREADABLE"] = ~F.coalesce("readable", F.lit(False))
    found = docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in flags.items()]))).alias("code"))
    if chars is None:
        return found
    place = [F.round(c, 1).alias(c) for c in ("x0", "top", "x1")]
    over = chars.where(F.regexp_like("text", F.lit(r"^\d$"))).groupBy("doc_id", "page", *place).agg(F.count_distinct("text").alias("n")).where("n > 1")
    return found.unionByName(over.select("doc_id").distinct().withColumn("code", F.lit("OVERLAPPING_DIGITS")))


def _tenth(c: Column) -> Column:
    """round(c, 1) of a double: plain arithmetic but near ties and for very large numbers, where a tenth isn't told so."""
    y = c * 10
    plain = (F.abs(y) < 1e12) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(plain, F.floor(y + 0.5) / 10.0).otherwise(F.round(c, 1))


#: A whole amount; as elsewhere a line break may follow it.
_AMOUNT = r"^\$?\d{1,3}(,\d{3})*\.\d{2}(\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"


def _single_amounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (three keys and their sorted glyphs) as the one amount that each has; other lines go."""
    for batch in batches:
        glyphs = batch.column(3)
        line = np.repeat(np.arange(len(glyphs)), pc.list_value_length(glyphs).to_numpy(zero_copy_only=False))
        flat = glyphs.flatten()
        new = np.diff(line, prepend=-1) != 0
        for c in ("t", "s"):
            known, x = flat.field(c).is_valid().to_numpy(zero_copy_only=False), flat.field(c).to_numpy(zero_copy_only=False)
            new[1:] |= (known[1:] != known[:-1]) | ((x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1])))
        starts = np.flatnonzero(new)
        groups = pa.ListArray.from_arrays(pa.array(np.append(starts, len(line)), pa.int32()), pc.fill_null(flat.field("text"), ""))
        cells = pc.binary_join(groups, "")
        amount = pc.match_substring_regex(cells, _AMOUNT)
        owner, cells = line[starts][amount.to_numpy(zero_copy_only=False)], cells.filter(amount)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(first):
            before = np.repeat(first, np.diff(np.append(first, len(owner))))
            one = first[np.logical_and.reduceat(pc.equal(cells, cells.take(pa.array(before))).to_numpy(zero_copy_only=False), first)]
            at = pa.array(owner[one])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), cells.take(pa.array(one))], [*batch.schema.names[:3], "cell"])


def glyph_cells(chars: DataFrame) -> DataFrame:
    """Money values of glyph groups (rounded top and size) near a line, taken only if a line has exactly one. The glyphs of
    a line are gathered once, in order, and cut into groups where they are."""
    glyph = F.struct(_tenth(F.col("top").cast("double")).alias("t"), _tenth(F.col("size").cast("double")).alias("s"), "x0", "text")
    own = chars.select("doc_id", "page", "line", glyph.alias("glyph"))  # worked out before: what is collected isn't compiled
    lines = own.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list("glyph")).alias("glyphs"))
    return lines.mapInArrow(_single_amounts, lines.select("doc_id", "page", "line", F.lit("").alias("cell")).schema)


def verified_dates(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """Adds `date_check`: verified, mismatch or unverified. A row is matched to the one dated printed line of its page with
    its amount and balance, at most 3 above or below. A line of two dates settles only rows that also have a posted_date,
    by its second date. printed: stmt_id, page, top, amount, balance and printed_date, or dates (an array, see
    `leading_dates`)."""
    dates = F.col("dates") if "dates" in printed.columns else F.array_compact(F.array("printed_date"))
    own = printed.select("stmt_id", "page", F.col("top").alias("_top"), "amount", "balance", dates.alias("_dates")).where("size(_dates) > 0")
    met = rows.join(own, ["stmt_id", "page", "amount", "balance"]).where(F.col("top").isNull() | (F.abs(F.col("top") - F.col("_top")) <= LINE_HEIGHT))
    unique = met.groupBy("stmt_id", "seq").agg(F.count("*").alias("_n"), F.max("_dates").alias("_d")).where("_n = 1")
    out = rows.join(unique, ["stmt_id", "seq"], "left")
    posted = F.col("posted_date").isNotNull() if "posted_date" in rows.columns else F.lit(False)
    expected = F.when(posted, F.try_element_at("_d", F.lit(-1))).when(F.size("_d") == 1, F.get("_d", F.lit(0)))
    return out.select(*rows.columns, F.when(expected.isNull(), "unverified").when(expected == F.col("date"), "verified").otherwise("mismatch").alias("date_check"))


def credit_score(text: Column) -> Column:
    """The one score that a report prints, 300 to 900, else null."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\bFICO\s+Score\s+8\s*[:\-]?\s*(\d{3})\b"), F.lit(1)))
    value = F.get(found, F.lit(0)).try_cast("int")
    return F.when((F.size(found) == 1) & value.between(300, 900), value)


def disclosed_loans(docs: DataFrame, pattern: str = r"(?i)Loan\s+#?(\d+)\s+balance\s+\$?([\d,]+\.\d{2})") -> DataFrame:
    """Loans that a statement's text lists: (doc_id, loan, balance)."""
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hit"))
    return each.select("doc_id", F.regexp_extract("hit", pattern, 1).alias("loan"), F.replace(F.regexp_extract("hit", pattern, 2), F.lit(","), F.lit("")).cast("decimal(18,2)").alias("balance"))
