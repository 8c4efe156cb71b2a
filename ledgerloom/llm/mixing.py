"""Mixing sources to target weights along a low-discrepancy schedule.

The mix is a row of slots of equal token counts. Point t of the golden-ratio sequence, frac(t * phi), falls to a source by
the cumulative shares of the sources' slots; the r-th point of a source is its slot of rank r, as long as the source has
slots left. A source's documents, shuffled by MD5, stand one behind another and begin anew after the last: its slot of
rank r holds the r-th block of that endless row, so blocks run over the end of the source and all hold as many tokens,
but for the last one of a source, which ends where the source's target does. A document's share of the mix is what its
pieces of blocks add up to.

Positions within a source and ranks of its slots are prefix sums in two steps, over ranges of the order and within each;
a source that holds most rows is spread over thousands of window partitions. The sources themselves are ranked by range
partitions, so there may be as many as there are hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD_CLASS, cut_lineage, shuffle_parts, table

#: Tokens of a slot, at most; a small corpus is cut into MIN_SLOTS slots or more.
BLOCK_TOKENS, MIN_SLOTS = 4096, 65_536
#: Sources whose targets are broadcast, at most; more are joined by a shuffle, whose large partitions Spark splits.
BROADCAST_SOURCES = 20_000
#: Times a source's own size that it may give.
MOST_REPEATS = 3
_CHUNK = 1 << 16
#: Points of the sequence for each slot. Gaps between n points are below 2.62 / n (three-distance theorem), so three for
#: each slot put a point into every n-th part of the interval: every source gets all of its slots.
POINTS = 3
#: Slots that meet the shares of sources in one cell.
_CELL = 16
#: The golden ratio's fraction, and the fraction of its 65,536-fold.
PHI, PHI_CHUNK = 0.6180339887498949, 0.47548671310877194


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` written in range partitions of `order`, numbered in a column `_part`."""
    return cut_lineage(df.repartitionByRange(shuffle_parts(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))


def _prefixes(ranged: DataFrame, order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """`ranged` with the sums of `amounts` over all earlier rows: those of earlier partitions and of the own one. What one
    task sees is a row for each partition, or a partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*(F.sum(a).alias(f"_of_{n}") for n, a in amounts.items()))
    before = totals.select("_part", *(F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_to_{n}") for n in amounts))
    own = ranged.withColumns({f"_in_{n}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for n, a in amounts.items()})
    joined = own.join(F.broadcast(before), "_part")
    return joined.withColumns({n: F.col(f"_to_{n}") + F.col(f"_in_{n}") for n in amounts}).drop(*(f"_{k}_{n}" for k in ("to", "in") for n in amounts))


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: one row (source, source_size) for each source. Adds place, weight and target (tokens of the mix).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets are proportional to weight but for sources that
    would exceed three times their size: those stop there and the rest is shared anew. In order of size a unit of
    weight, the sources that stop come first, so the level that the others share is found in one pass over the sources.
    No sources give no rows; sources without words have the target 0.
    """
    by_name = [F.col("source").asc_nulls_last()]
    placed = _prefixes(_ranged(sizes, by_name), by_name, {"place": F.lit(1)}).drop("_part").withColumn("place", F.col("place") + 1)
    weighed = placed.withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long"))
    by_room = [F.col("source_size") / F.col("weight"), F.col("place")]
    level = _prefixes(_ranged(weighed, by_room), by_room, {"stopped": F.col("source_size"), "gone": F.col("weight")}).drop("_part")
    sizes_sum, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # stopping a source raises the level as long as the source's room is below it: the right level is the highest
    left, open_ = F.lit(sizes_sum) - MOST_REPEATS * F.col("stopped"), F.lit(weights) - F.col("gone")
    highest = level.agg(F.max(left / open_)).first()[0]
    return level.select(
        "source", "source_size", "weight", "place",
        F.least(F.lit(highest) * F.col("weight"), (MOST_REPEATS * F.col("source_size")).cast("double")).alias("target"),
    )


def _running(df: DataFrame, group: list[str], chunk: str, order: list[Column], amount: Column, name: str) -> DataFrame:
    """`df` with the sum of `amount` over earlier rows of the group, by chunk and then `order`, in a column `name`."""
    totals = df.groupBy(*group, chunk).agg(F.sum(amount).alias("_sum"))
    before = totals.select(
        *group, chunk,
        F.coalesce(
            F.sum("_sum").over(Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return own.join(before, [*group, chunk]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _schedule(quotas: DataFrame, block: int) -> DataFrame:
    """quotas: (place, quota) of the sources that give anything. One row (slot, place, rank) for each block of the mix, in
    the order of `slot`; ranks count the slots of a source from 0."""
    by_place = [F.col("place")]
    shares = _prefixes(_ranged(quotas.withColumn("slots", F.ceil(F.col("quota") / block)), by_place), by_place, {"low": F.col("slots")})
    shares = shares.select("place", "slots", "low")
    n = shares.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    points = quotas.sparkSession.range(POINTS * n).select(F.col("id").alias("slot"), F.floor(F.col("id") / _CHUNK).alias("chunk"))
    at = F.col("chunk") * F.lit(PHI_CHUNK) + (F.col("slot") - F.col("chunk") * _CHUNK) * F.lit(PHI)
    asked = points.withColumn("x", F.least(F.floor((at - F.floor(at)) * F.lit(float(n))), F.lit(n - 1))).withColumn("cell", F.floor(F.col("x") / _CELL))
    high = F.col("low") + F.col("slots")
    offered = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / _CELL), F.floor((high - 1) / _CELL))))
    picked = asked.join(offered, "cell").where((F.col("low") <= F.col("x")) & (F.col("x") < high)).select("slot", "chunk", "place", "slots")
    ranked = _running(picked, ["place"], "chunk", [F.col("slot")], F.lit(1), "rank")
    return ranked.where("rank < slots").select("slot", "place", F.col("rank").cast("long").alias("rank"))


def mix_pieces(begun: DataFrame, block: int) -> DataFrame:
    """begun: one row (row, place, source_size, quota, start, size) for each document, `start` within its source. The mix
    as rows (slot, place, rank, row, first, last): words first to last (exclusive) of a row go into a slot."""
    some = begun.where("size > 0 and quota > 0")
    quotas = some.select("place", "quota").distinct()
    # a source's row of documents, as often as its quota reaches
    again = some.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("source_size")))))
    begin = F.col("turn") * F.col("source_size") + F.col("start")
    laid = again.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), "quota")).where("begin < end")
    cut = laid.select(
        "row", "place", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("rank")
    )
    left, right = F.greatest("begin", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    return cut.join(_schedule(quotas, block), ["place", "rank"]).select(
        "slot", "place", "rank", "row", (left - F.col("begin")).alias("first"), (right - F.col("begin")).alias("last")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None
) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken) for each row of `docs`: words of the text, of its source,
    its source's share of the mix, and the words of it that the mix takes, repeats counted (three times size at most).
    Each source gives its target, rounded to a word. `row_col`: a column that names the rows of `docs`; it comes back as
    `row`.

    A row's taken words are whole copies of it and, in the row that its source's target ends in, its first words.

    Null text has size 0; a null source is a source of its own, last in order; rows that repeat an id or have none are
    documents of their own, placed by `row_col` where there is one, else by size: equal ones among them may change
    places. An empty table gives no rows.
    """
    key = F.col(id_col).cast("long").cast("string")
    name = F.lit(None).cast("long").alias("name")
    if row_col is not None:
        name = F.col(row_col).alias("name")
        key = F.coalesce(key, F.concat(F.lit("row "), F.col(row_col).cast("string")))
    sized = cut_lineage(
        docs.select(
            name, F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(key, F.lit("")).cast("binary")).alias("key"),
        )
    )
    targets = cut_lineage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    sources, total = targets.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    block = max(1, min(BLOCK_TOKENS, total // MIN_SLOTS))
    of_source = targets.select(F.col("source").alias("s"), "place", "source_size", "target")
    named = sized.join(F.broadcast(of_source) if sources <= BROADCAST_SOURCES else of_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = [F.col(c) for c in ("key", "doc_id", "size", "name")]
    begun = cut_lineage(
        _running(named.withColumn("chunk", F.substring("key", 1, 3)), ["place"], "chunk", order, F.col("size"), "start").select(
            F.monotonically_increasing_id().alias("row"), "name", "doc_id", "size", "place", "source_size", "target", "start",
            F.floor(F.col("target") + 0.5).alias("quota"),
        )
    )
    taken = mix_pieces(begun, block).groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = begun.join(taken, "row", "left").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long"))
    plain = ["doc_id", "size", "source_size", "target", "taken"]
    return out.select(*plain) if row_col is None else out.select(F.col("name").alias("row"), *plain)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
    SELECT *, (place - 1) % 3 + 1 AS weight, (SELECT sum(size) FROM sized)::BIGINT AS total FROM sources
), rounds AS (
    SELECT 0 AS n, [0]::BIGINT[] AS stopped
    UNION ALL
    SELECT n + 1, s FROM (
        SELECT n, stopped, (SELECT list(place ORDER BY place) FROM weighed w WHERE list_contains(stopped, w.place)
               OR w.weight * (w.total - coalesce((SELECT sum(3 * x.source_size) FROM weighed x WHERE list_contains(stopped, x.place)), 0))
                  / (SELECT sum(x.weight) FROM weighed x WHERE NOT list_contains(stopped, x.place)) > 3 * w.source_size) AS s FROM rounds)
    WHERE s IS NOT NULL AND len(s) > len(list_filter(stopped, lambda z: z > 0))
), final AS (
    SELECT stopped FROM rounds ORDER BY n DESC LIMIT 1
), targets AS (
    SELECT w.*, CASE WHEN list_contains((SELECT stopped FROM final), place) THEN 3.0::DOUBLE * source_size
           ELSE ((total - coalesce((SELECT sum(3 * x.source_size) FROM weighed x WHERE list_contains((SELECT stopped FROM final), x.place)), 0))::DOUBLE
                 / (SELECT sum(x.weight) FROM weighed x WHERE NOT list_contains((SELECT stopped FROM final), x.place))::DOUBLE) * weight END AS target
    FROM weighed w
), begun AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
           coalesce(sum(s.size) OVER (PARTITION BY t.place ORDER BY md5(s.doc_id::VARCHAR), s.doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), laid AS (
    SELECT doc_id, least(size, greatest(0, quota - (turn * source_size + start))) AS words FROM begun, (VALUES (0), (1), (2)) r(turn)
), taken AS (
    SELECT doc_id, sum(words)::BIGINT AS taken FROM laid GROUP BY doc_id
)
SELECT b.doc_id, b.size, b.source_size, b.target, t.taken FROM begun b JOIN taken t ON t.doc_id = b.doc_id
"""
