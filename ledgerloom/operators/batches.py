"""Documents and exports of one account: repeated uploads, extracted pages, reversed listings, split and overlapping
exports."""

from __future__ import annotations

from ledgerloom.functions.money import CENTS, month_of
from ledgerloom.functions.text import compact
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_uploads(docs: DataFrame, content: Column, keys: list[str], order: str) -> DataFrame:
    """The first upload of each distinct content of a case."""
    hashed = docs.withColumn("sha256", F.sha2(content.cast("binary"), 256))
    return hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "sha256").orderBy(order))).where("_r = 1").drop("_r")


def expand_documents(docs: DataFrame) -> DataFrame:
    """S3: one row for each account statement of a document (array `account_statements` of structs with account_id); a document
    with issues or without accounts adds a blocker row."""
    own = docs.select("case_id", "doc_id", F.explode("account_statements").alias("s")).select("case_id", "doc_id", "s.*", F.lit(False).alias("blocker"))
    bad = docs.where((F.size(F.coalesce("issues", F.array())) > 0) | (F.size(F.coalesce("account_statements", F.array())) <= 0))
    return own.unionByName(bad.select("case_id", "doc_id", F.lit(True).alias("blocker")), allowMissingColumns=True)


def evidence_contract(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Source order, the posted date over the transaction's, what a date rests on, account and currency inherited."""
    st = statements.select("stmt_id", F.col("account_id").alias("_a"), F.col("currency").alias("_c"))
    out = rows.join(st, "stmt_id", "left")
    order = F.row_number().over(Window.partitionBy("stmt_id").orderBy("seq"))
    day = F.coalesce("posted_date", "date")
    inherit = lambda c, d: F.coalesce(c, d) if c in rows.columns else F.col(d)
    kept = [c for c in rows.columns if c not in ("date", "month", "account_id", "currency")]
    return out.select(
        *kept, order.alias("source_sequence"), F.col("date").alias("transaction_date"), day.alias("date"), month_of(day).alias("month"),
        F.when(F.col("posted_date").isNotNull(), "posted_date").otherwise("statement_date").alias("date_basis"),
        inherit("account_id", "_a").alias("account_id"), inherit("currency", "_c").alias("currency"),
    )


def readiness(statements: DataFrame, rows: DataFrame, findings: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(stmt_id, readiness) of every statement: incomplete with findings or without rows, usable with warnings where there
    are warnings or a model read it (ai_review_required), else validated."""
    mark = lambda df, name: df.select("stmt_id").distinct().withColumn(name, F.lit(True))
    out = statements.join(mark(rows, "_rows"), "stmt_id", "left").join(mark(findings, "_bad"), "stmt_id", "left")
    out = out.withColumn("_warn", F.lit(None).cast("boolean")) if warnings is None else out.join(mark(warnings, "_warn"), "stmt_id", "left")
    model = F.coalesce("ai_review_required", F.lit(False)) if "ai_review_required" in statements.columns else F.lit(False)
    label = F.when(F.col("_bad") | F.col("_rows").isNull(), "Incomplete or inconsistent").when(F.col("_warn") | model, "Usable with warnings").otherwise("Validated figures")
    return out.select("stmt_id", label.alias("readiness"))


def page_rows(rows: DataFrame) -> DataFrame:
    """Rows of extracted pages (doc_id, page, sequence) numbered through the document, in order of page and sequence; the
    page's own number stays as page_sequence."""
    order = Window.partitionBy("doc_id").orderBy("page", "sequence")
    return rows.withColumn("page_sequence", F.col("sequence")).withColumn("sequence", F.row_number().over(order))


def merge_pages(pages: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(metadata, conflicts). The first known value of each field by page; a field whose later values differ in their
    normal form is a conflict. fields: name -> 'account', 'currency', 'holder' or 'exact'."""
    forms = {
        "account": lambda c: F.upper(F.regexp_replace(c, r"[\s-]", "")), "currency": lambda c: F.upper(F.trim(c)),
        "holder": compact, "exact": lambda c: c,
    }
    meta = pages.groupBy("doc_id").agg(
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("page"))).alias(f) for f in fields],
        *[F.count_distinct(forms[k](F.col(f).cast("string"))).alias(f"_{f}") for f, k in fields.items()],
    )
    named = F.array_compact(F.array(*[F.when(F.col(f"_{f}") > 1, F.lit(f)) for f in fields]))
    return meta.select("doc_id", *fields), meta.select("doc_id", F.explode(named).alias("field"))


def proven_order(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Adds `source_sequence`. A listing is turned round only if its dates fall and every balance, rolled from the
    opening in the turned order, agrees."""
    down = Window.partitionBy("stmt_id").orderBy(F.desc("seq"))
    up = Window.partitionBy("stmt_id").orderBy("seq")
    move = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    own = rows.withColumn("_before", F.lag("date").over(up)).withColumn(
        "_turned", F.sum(move).over(down.rowsBetween(Window.unboundedPreceding, 0))
    ).join(statements.select("stmt_id", F.col("opening").alias("_open")), "stmt_id", "left")
    proof = own.groupBy("stmt_id").agg(
        (F.bool_and(F.coalesce(F.col("date") <= F.col("_before"), F.lit(True)) & F.col("date").isNotNull())
         & F.coalesce(F.bool_or(F.col("date") < F.col("_before")), F.lit(False))
         & F.bool_and(F.coalesce(F.col("_open") + F.col("_turned") == F.col("balance"), F.lit(False)))).alias("_flip"),
    )
    out = rows.join(proof, "stmt_id").withColumn("_n", F.count("*").over(Window.partitionBy("stmt_id")))
    place = F.row_number().over(up)
    return out.withColumn("_p", place).select(
        *rows.columns, F.when(F.col("_flip"), F.col("_n") + 1 - F.col("_p")).otherwise(F.col("_p")).alias("source_sequence"), F.col("_flip").alias("turned")
    )


def derived_openings(rows: DataFrame) -> DataFrame:
    """The opening that the first printed balance of a statement implies."""
    move = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    first = rows.groupBy("stmt_id").agg(F.min_by(F.struct("balance", move.alias("move")), "seq").alias("f"))
    return first.select("stmt_id", (F.col("f.balance") - F.col("f.move")).cast(CENTS).alias("derived_opening"))


def valid_pages(rows: DataFrame) -> DataFrame:
    """(doc_id, page) all of whose rows have a description and exactly one positive, finite side. debit and credit are text."""
    value = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(0)).otherwise(F.col(c).try_cast("decimal(38,10)"))
    d, c = value("debit"), value("credit")
    ok = F.coalesce((d >= 0) & (c >= 0) & ((d > 0) != (c > 0)) & F.col("description").isNotNull(), F.lit(False))
    return rows.groupBy("doc_id", "page").agg(F.bool_and(ok).alias("_ok")).where("_ok").select("doc_id", "page")


def checkpoint_differences(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Printed balances that the signed rows since the balance before them don't explain, with the difference."""
    w = Window.partitionBy("stmt_id").orderBy("seq")
    move = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    island = F.count("balance").over(w.rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.withColumn("_i", island).withColumn("_m", move).groupBy("stmt_id", "_i").agg(
        F.sum("_m").alias("_sum"), F.max("seq").alias("seq"), F.max_by("balance", "seq").alias("balance")
    ).where("balance is not null")
    opened = sums.join(statements.select("stmt_id", F.col("opening").alias("_o")), "stmt_id", "left")
    prev = F.coalesce(F.lag("balance").over(Window.partitionBy("stmt_id").orderBy("seq")), F.col("_o"))
    return opened.withColumn("difference", (F.col("balance") - prev - F.col("_sum")).cast(CENTS)).where("difference <> 0").select("stmt_id", "seq", "difference")


def extracted_findings(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """(stmt_id, seq, code) of all that keeps an extracted ledger from reconciling; seq is null for the statement's own.

    rows: stmt_id, seq (as read), place (order of reading), date, description, tx_type, amount, balance; statements: stmt_id,
    account_id, currency, period_start, period_end, opening, closing, debits, credits, debits_count, credits_count (null: not
    printed)."""
    order = Window.partitionBy("stmt_id").orderBy("place")
    st = statements.select("stmt_id", F.col("period_start").alias("_s"), F.col("period_end").alias("_e"))
    own = rows.join(st, "stmt_id", "left").withColumns({
        "_nth": F.row_number().over(Window.partitionBy("stmt_id", "seq").orderBy("place")), "_before": F.lag("date").over(order),
        "_good": F.coalesce((F.col("amount") > 0) & F.col("tx_type").isin("credit", "debit"), F.lit(False)),
    })
    codes = {
        "sequence_invalid": F.col("seq").isNull() | (F.col("seq") < 1) | (F.col("_nth") > 1), "date_missing": F.col("date").isNull(),
        "date_outside_period": (F.col("_s") <= F.col("_e")) & ~F.col("date").between(F.col("_s"), F.col("_e")), "dates_out_of_order": F.col("date") < F.col("_before"),
        "description_missing": F.coalesce(F.trim("description") == "", F.lit(True)), "not_one_positive_side": ~F.col("_good"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in codes.items()]))
    of_rows = own.select("stmt_id", "seq", F.explode(found).alias("code"))
    good = own.where("_good").select("stmt_id", F.col("place").alias("seq"), F.col("seq").alias("_shown"), "tx_type", "amount", "balance")
    steps = checkpoint_differences(good, statements).join(good.select("stmt_id", "seq", "_shown"), ["stmt_id", "seq"])
    sums = good.groupBy("stmt_id").agg(*[f.alias(f"_{n}") for side in ("debit", "credit") for n, f in (
        (f"{side}s", F.coalesce(F.sum(F.when(F.col("tx_type") == side, F.col("amount"))), F.lit(0))), (f"{side}s_count", F.count_if(F.col("tx_type") == side)))],
        F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("seq"))).alias("_last"),
        F.max(F.when(F.col("balance").isNotNull(), F.col("seq"))).alias("_at"),
    )
    move = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    after = good.join(sums.select("stmt_id", "_at"), "stmt_id").where("_at is null or seq > _at").groupBy("stmt_id").agg(F.sum(move).alias("_after"))
    one = statements.join(sums, "stmt_id", "left").join(after, "stmt_id", "left")
    c = F.col
    rolled = F.coalesce("_last", "opening") + F.coalesce("_after", F.lit(0))
    of_statement = {
        "account_missing": F.coalesce(F.trim("account_id"), F.lit("")) == "", "currency_missing": c("currency").isNull(),
        "currency_unsupported": ~c("currency").isin("CAD", "USD"), "period_missing": c("period_start").isNull() | c("period_end").isNull(),
        "period_reversed": c("period_start") > c("period_end"), "opening_missing": c("opening").isNull(), "closing_missing": c("closing").isNull(),
        "no_rows": c("_debits").isNull(), "debits_differ": c("debits") != c("_debits"), "credits_differ": c("credits") != c("_credits"),
        "debits_count_differs": c("debits_count") != c("_debits_count"), "credits_count_differs": c("credits_count") != c("_credits_count"),
        "closing_not_reached": c("opening").isNotNull() & (rolled != c("closing")),
        "equation_fails": c("opening") + c("_credits") - c("_debits") != c("closing"),
    }
    failed = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in of_statement.items()]))
    whole = one.select("stmt_id", F.lit(None).cast("int").alias("seq"), F.explode(failed).alias("code"))
    checked = steps.select("stmt_id", F.col("_shown").alias("seq"), F.lit("checkpoint_difference").alias("code"))
    return of_rows.unionByName(checked).unionByName(whole)


def compare_uploads(first: DataFrame, second: DataFrame, keys: list[str], day: str = "date", values: tuple[str, ...] = ("date", "amount")) -> DataFrame:
    """U1 to U3, for every key: days that both hold and that any holds, rows that only one holds (copies counted), and whether
    they are equal as multisets. A key of one side alone is compared with nothing."""
    sides = first.select(*keys, *values, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        second.select(*keys, *values, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    days = sides.groupBy(*keys, day).agg(F.max("_a").alias("a"), F.max("_b").alias("b")).groupBy(*keys).agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared_days"), F.count("*").alias("all_days")
    )
    more = F.greatest(F.lit(0), F.col("a") - F.col("b"))
    less = F.greatest(F.lit(0), F.col("b") - F.col("a"))
    tally = sides.groupBy(*keys, *values).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b")).groupBy(*keys).agg(
        F.sum(more).alias("only_first"), F.sum(less).alias("only_second")
    )
    return days.join(tally, keys).withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def retry_pages(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages of a statement to read again: those of rows with a finding, and for a balance finding the page of the row
    before; if no finding names a row, all pages. findings: stmt_id, seq (null: the statement), code; rows: stmt_id, seq, page."""
    paged = rows.select("stmt_id", "seq", "page", F.lag("page").over(Window.partitionBy("stmt_id").orderBy("seq")).alias("_prev"))
    local = findings.where("seq is not null").join(paged, ["stmt_id", "seq"])
    own = local.select("stmt_id", "page").unionByName(
        local.where("code like '%balance%'").select("stmt_id", F.col("_prev").alias("page"))
    ).where("page is not null").distinct()
    rest = findings.where("seq is null").select("stmt_id").distinct().join(own.select("stmt_id").distinct(), "stmt_id", "left_anti")
    return own.unionByName(rows.select("stmt_id", "page").distinct().join(rest, "stmt_id", "left_semi"))


def combine_exports(parts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows, rows). Parts of one export (account, search window, printed totals) become one window: rows in order of the
    parts' periods, then of the source; opening of the first part, closing of the last. Totals that the parts print are the
    window's, so they are checked once it is whole: `reconciled` if both totals, the equation and the last balance hold.

    parts: account_id, part_id, search_start, search_end, debits, credits (printed), period_start, period_end, opening, closing;
    rows: part_id, seq, tx_type, amount, balance. Windows are named by what their parts share.
    """
    name = F.sha2(F.to_json(F.struct("account_id", "search_start", "search_end", *[F.col(c).cast("string").alias(c) for c in ("debits", "credits")])), 256)
    named = parts.withColumn("window_id", name)
    met = rows.join(named.select("part_id", "window_id", "account_id", "period_start"), "part_id")
    order = Window.partitionBy("window_id").orderBy("period_start", "part_id", "_seq")
    ordered = met.withColumnRenamed("seq", "_seq").withColumn("seq", F.row_number().over(order)).drop("_seq", "period_start")
    total = lambda side: F.coalesce(F.sum(F.when(F.col("tx_type") == side, F.col("amount"))), F.lit(0)).cast(CENTS)
    sums = ordered.groupBy("window_id").agg(total("debit").alias("_d"), total("credit").alias("_c"), F.max_by("balance", "seq").alias("_last"))
    whole = named.groupBy("window_id", "account_id").agg(
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.min_by("opening", "period_start").alias("opening"),
        F.max_by("closing", "period_end").alias("closing"), F.max("debits").alias("debits"), F.max("credits").alias("credits"), F.count("*").alias("parts"),
    ).join(sums, "window_id")
    wrong = [F.col("debits") != F.col("_d"), F.col("credits") != F.col("_c"), F.col("opening") + F.col("_c") - F.col("_d") != F.col("closing"), F.col("_last") != F.col("closing")]
    bad = F.array_contains(F.array(*[F.coalesce(w, F.lit(False)) for w in wrong]), F.lit(True))
    return whole.withColumn("reconciled", ~bad).drop("_d", "_c", "_last"), ordered


def merge_windows(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of overlapping export windows of an account, each once, if every window meets the one before and both
    hold the same rows on the days that they share; else all rows of all windows. Adds `merged` and `kept`.

    windows: account_id, window_id, period_start, period_end, and reconciled where they were checked (one that isn't keeps its
    account's windows apart); rows: account_id, window_id, seq, date, description, tx_type,
    amount, balance.
    """
    w = Window.partitionBy("account_id").orderBy("period_start", "window_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = windows.withColumn("_until", F.max("period_end").over(w))
    gaps = placed.where("period_start > _until").select("account_id")
    if "reconciled" in windows.columns:
        gaps = gaps.unionByName(windows.where("not reconciled").select("account_id"))
    mine = rows.join(placed.select("account_id", "window_id", "period_start", "period_end", "_until"), ["account_id", "window_id"]).withColumn("_own", F.col("_until").isNull() | (F.col("date") > F.col("_until")))
    key = ["date", "description", "tx_type", "amount", "balance"]
    shared = placed.where("_until is not null").select(
        "account_id", F.col("window_id").alias("_w"), F.col("period_start").alias("_s"), F.least("_until", "period_end").alias("_e"), F.col("period_start").alias("_ps")
    )
    # the shared days one by one, so that rows meet them by account and day
    by_day = shared.where("_s <= _e").withColumn("date", F.explode(F.sequence("_s", "_e")))
    old = mine.where("_own").join(by_day, ["account_id", "date"]).where("period_start < _ps or (period_start = _ps and window_id < _w)")
    new = mine.where("not _own").join(by_day.select("account_id", "date", F.col("_w").alias("window_id")), ["account_id", "window_id", "date"])
    tally = lambda df, side: df.groupBy("account_id", F.col(side).alias("_w"), *key).agg(F.count("*").alias("n"))
    a, b = tally(old, "_w"), tally(new, "window_id")
    odd = a.exceptAll(b).unionByName(b.exceptAll(a)).select("account_id")
    bad = gaps.unionByName(odd).distinct().withColumn("_bad", F.lit(True))
    out = mine.join(bad, "account_id", "left").withColumn("merged", F.col("_bad").isNull())
    return out.select(*rows.columns, "merged", (~F.col("merged") | F.col("_own")).alias("kept"))
