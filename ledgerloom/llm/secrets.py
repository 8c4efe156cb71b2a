"""Secret scans with corpus-wide ownership frequency.

Candidates are found in each text by kind; hashes of their values are then counted over the corpus by distinct
repository (document) and distinct owner (source). A value that many owners show is a widely copied example; one that
stays with one owner looks live. Besides the base kinds, long mixed tokens are candidates too, and join the spans only if
their ownership says that they belong to someone. All of it is column expressions, joins and groupings; places of matches
are prefix sums over rows, so a text of any number of matches costs their number times its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, join_counted, table

#: The base patterns, in the order in which kinds at one start are listed.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are as long as they can be, so asking for the least length finds what dropping shorter runs leaves.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}+"
#: The method's own candidates: runs of key characters that hold a digit, a capital and a small letter.
OWNED = r"[A-Za-z0-9+/_-]{20,}+"
_MIXED = ("[0-9]", "[A-Z]", "[a-z]")
#: Shortest value of an assignment.
ASSIGN_CHARS = 6
#: A value that this many owners or more show is a copied example.
COPIED_OWNERS = 3

KINDS = ("assign", "access", "hex", "owned")


def _matches(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """All leftmost matches in order, as structs of kind, pos, gap (characters between the match before and this one),
    chars and value. Gaps come from a split by the same pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("val"))
    spans = F.transform(
        F.filter(rows, lambda r: r["hit"].isNotNull()),
        lambda r, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), F.length(r["gap"]).alias("gap"), F.length(r["hit"]).alias("chars"), r["val"].alias("value")
        ),
    )
    none = F.array().cast("array<struct<kind: string, pos: int, gap: int, chars: int, value: string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row (row, doc_id, owner, matches) for each row of `docs`: the matches of all kinds, one kind after another."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    t = F.col("t")
    every = F.concat(_matches(t, "assign", ASSIGN, 2), _matches(t, "access", ACCESS), _matches(t, "hex", HEX), _matches(t, "owned", OWNED))
    return rows.select("row", "doc_id", "owner", every.alias("matches"))


def placed_spans(found: DataFrame) -> DataFrame:
    """`candidates` as one row (row, doc_id, owner, kind, first, last, value, h1, h2) for each span: code points, end
    exclusive. Base spans too short go, and owned ones without a digit, a capital and a small letter or that touch a base
    span.

    An owned span touches a base span if the furthest end of the base spans that begin before its end lies behind its
    start: one pass over a text's spans in order, base spans at their start and owned ones at their end.
    """
    each = found.where(F.size("matches") > 0).select("row", "doc_id", "owner", F.explode("matches").alias("m")).select("row", "doc_id", "owner", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.col("gap") + F.col("chars")).over(so_far)
    ended = each.withColumn("last", last.cast("int")).withColumn("first", (F.col("last") - F.col("chars")).cast("int"))
    base = F.col("kind") != "owned"
    mixed = F.regexp_like("value", F.lit(_MIXED[0])) & F.regexp_like("value", F.lit(_MIXED[1])) & F.regexp_like("value", F.lit(_MIXED[2]))
    good = ended.where(F.when(F.col("kind") == "assign", F.length("value") >= ASSIGN_CHARS).when(base, F.lit(True)).otherwise(mixed))
    sweep = Window.partitionBy("row").orderBy("at", "base").rowsBetween(Window.unboundedPreceding, 0)
    swept = good.withColumns({"at": F.when(base, F.col("first")).otherwise(F.col("last")), "base": base}).withColumn(
        "reach", F.max(F.when(F.col("base"), F.col("last"))).over(sweep)
    )
    apart = swept.where("base or reach is null or reach <= first")
    return apart.select(
        "row", "doc_id", "owner", "kind", "first", "last", "value", F.xxhash64("value").alias("h1"),
        F.xxhash64(F.lit("value"), "value").alias("h2"),
    )


def ownership(spans: DataFrame) -> DataFrame:
    """`placed_spans`: one row (h1, h2, spans, repositories, owners) for each distinct value.

    Values are counted once for each document before owners are counted, and each owner's count is partial sums first,
    so a value that a third of all documents hold costs no task more than its own share of them.
    """
    by_row = spans.groupBy("h1", "h2", "row", "owner").agg(F.count("*").alias("spans"))
    by_owner = by_row.groupBy("h1", "h2", "owner").agg(F.count("*").alias("n"), F.sum("spans").alias("spans"))
    return by_owner.groupBy("h1", "h2").agg(F.sum("spans").alias("spans"), F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.transform(
        spans,
        lambda s: F.struct(
            s["first"].alias("first"),
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"),
            F.concat_ws(":", s["kind"], s["first"], s["last"]).alias("shown"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(order), lambda s: s["shown"]), ",")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", copied: int = COPIED_OWNERS
) -> DataFrame:
    """One row for each row of `docs`: doc_id, base and owned (arrays of kind, first, last, value, repositories, owners).

    `base` holds the base spans of every kind; `owned` holds the long mixed tokens, apart from base spans, that fewer
    than `copied` owners show. Null text is empty; a null owner is an owner of its own; rows that repeat an id or have
    none are rows of their own. Very long texts are searched whole. An empty table gives no rows. Other columns are ignored.
    """
    found = cut_lineage(candidates(docs, id_col, text_col, owner_col))
    spans = cut_lineage(placed_spans(found))
    judged = join_counted(spans, ownership(spans), ["h1", "h2"], "spans").where((F.col("kind") != "owned") | (F.col("owners") < copied))
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.struct("kind", "first", "last", "value", "repositories", "owners")).alias("spans")
    )
    spans_or_none = F.coalesce(F.col("spans"), F.array().cast(by_row.schema["spans"].dataType))
    return found.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id", F.filter(spans_or_none, lambda s: s["kind"] != "owned").alias("base"),
        F.filter(spans_or_none, lambda s: s["kind"] == "owned").alias("owned"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "owned")).alias("spans"),
        F.size(F.filter("base", lambda s: s["owners"] >= COPIED_OWNERS)).cast("long").alias("n_copied"),
    )


OP5_SQL = r"""
WITH t AS (
    SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), patterns AS (
    SELECT * FROM (VALUES ('assign', 1, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
        ('access', 2, 'AKIA[A-Z0-9]+', 0), ('hex', 3, '[0-9a-f]+', 0), ('owned', 4, '[A-Za-z0-9+/_-]+', 0)) p(kind, place, re, g)
), parts AS (
    SELECT doc_id, source, kind, place, CASE kind WHEN 'assign' THEN regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
               WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 'hex' THEN regexp_extract_all(text, '[0-9a-f]+')
               ELSE regexp_extract_all(text, '[A-Za-z0-9+/_-]+') END AS hits,
           CASE kind WHEN 'assign' THEN string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
               WHEN 'access' THEN string_split_regex(text, 'AKIA[A-Z0-9]+') WHEN 'hex' THEN string_split_regex(text, '[0-9a-f]+')
               ELSE string_split_regex(text, '[A-Za-z0-9+/_-]+') END AS gaps
    FROM t, patterns
), rows AS (
    SELECT doc_id, source, kind, place, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM parts
), placed AS (
    SELECT *, CAST(sum(length(gap)) OVER w + sum(length(hit)) OVER w AS BIGINT) AS last FROM rows
    WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)
), valued AS (
    SELECT doc_id, source, kind, place, last - length(hit) AS first, last,
           CASE kind WHEN 'assign' THEN regexp_extract(hit, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE hit END AS value
    FROM placed
), good AS (
    SELECT * FROM valued WHERE CASE kind WHEN 'assign' THEN length(value) >= 6 WHEN 'access' THEN length(value) >= 20
        WHEN 'hex' THEN length(value) >= 24 ELSE length(value) >= 20 AND regexp_matches(value, '[0-9]')
        AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') END
), apart AS (
    SELECT * FROM good g WHERE kind <> 'owned' OR NOT EXISTS (
        SELECT 1 FROM good b WHERE b.doc_id = g.doc_id AND b.kind <> 'owned' AND b.first < g.last AND g.first < b.last)
), owners AS (
    SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners FROM apart GROUP BY value
), kept AS (
    SELECT a.*, o.owners, a.kind || ':' || a.first || ':' || a.last AS shown FROM apart a JOIN owners o ON a.value = o.value
    WHERE a.kind <> 'owned' OR o.owners < 3
)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(shown, ',' ORDER BY first, place) FILTER (WHERE kind <> 'owned'), '')) AS base_sha256,
       coalesce(string_agg(shown, ',' ORDER BY first, place), '') AS spans,
       count(*) FILTER (WHERE kind <> 'owned' AND owners >= 3) AS n_copied
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id GROUP BY t.doc_id
"""
