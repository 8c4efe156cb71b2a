"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every signature: sigma places a shingle in a universe of 2**32 slots, pi ranks the slots, and
coordinate k ranks slots shifted round by k. Documents of equal shingle sets become one class. Classes that share a band
meet in that band's bucket: packed signatures say which pairs can reach the threshold, full shingle sets say which do.

A bucket never gives out its pairs: what leaves it is a spanning forest of its exact links, less than a row for each
member. Buckets are cut into blocks of bounded size, in members and in shingles, and two blocks meet in a cell. First, in
the first bands, every block meets itself and one block that all of its bucket share, and what is linked is joined to
components. Then, in all bands, buckets that still hold different components are opened whole, but never two blocks of
one component. A pair is looked at in the first band that it shares, so no group is too large and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import chunks, cut_lineage, mix64, shingle_sets, shuffle_parts, slices, table, text_bytes
from ledgerloom.llm.components import components, joined

#: 32 bands of 4 coordinates: sets of similarity 0.75 share a band but for 5 in a million.
BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
#: A pair is likely if this share of coordinates agrees: five standard deviations below 0.75.
LIKELY = 0.55
#: Members of a bucket that one task compares with as many others at most. A text counts as one member, and as one more
#: for every HEAVY shingles: a cell holds about two million shingles, unless a single text has more.
BLOCK, HEAVY = 1024, 1024
#: Bands that are looked at before the others: 19 of 20 pairs at the threshold share one of them.
FIRST_BANDS = 8
NUMERATOR = 75

_SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary, packed binary"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 coordinates, a row for each of the sets, none of which is empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    slots = (mix64(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), COORDS), dtype=np.uint32)
    x, y = np.empty_like(slots), np.empty_like(slots)
    for k in range(COORDS):
        np.add(slots, np.uint32(k), out=x)  # sigma's slots, shifted round; then pi, a bijection
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x85EBCA6B), out=x)
        np.right_shift(x, np.uint32(13), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0xC2B2AE35), out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "k1", "k2", "bands", "sig", "packed"]
    closed = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for batch in slices(whole, 1):
            texts, n = text_bytes(batch.column(1)), batch.num_rows
            sets = shingle_sets(texts)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            k1, k2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
            bands: list = [None] * n
            sigs: list = [None] * n
            if len(full):
                some = [sets[i] for i in full]
                flat, starts = np.concatenate(some), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                k1[full] = np.add.reduceat(mix64(flat), starts)
                k2[full] = np.add.reduceat(mix64(flat ^ np.uint64(0xE7037ED1A0B428DB)), starts)
                sig = signatures(some)
                wide = sig.astype(np.uint64).reshape(len(full), BANDS, ROWS)
                hashed = np.zeros((len(full), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    hashed = mix64(hashed ^ (wide[:, :, r] + np.uint64(0x9E3779B97F4A7C15)))
                low = mix64(sig.astype(np.uint64)).astype(np.uint8)
                for i, h, s in zip(full, hashed.view(np.int64), low, strict=True):
                    bands[i], sigs[i] = h, s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
                    pa.array([closed.compress(t) if k else None for t, k in zip(texts, sizes, strict=True)], pa.binary()),
                ],
                names,
            )


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a with each row of b: the share of equal coordinates, chance agreement of a byte taken out."""
    share = np.empty((len(a), len(b)), dtype=np.float32)
    for i in range(0, len(a), 32):
        equal = a[i : i + 32, None, :] == b[None, :, :]
        share[i : i + 32] = equal.sum(axis=2, dtype=np.uint8 if COORDS < 256 else np.uint16)
    return (share / COORDS - 1 / 256) / (1 - 1 / 256)


def _first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a with each row of b, hashes of the earlier bands: whether none is the same, so that the pair
    meets in no earlier bucket. Bytes of coordinates can't tell: those of other coordinates agree once in 256."""
    first = np.ones((len(a), len(b)), dtype=bool)
    for k in range(a.shape[1]):
        first &= a[:, k, None] != b[None, :, k]
    return first


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by products of dense 0/1 blocks."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    flat = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(flat[0], flat[1])
    at = [np.searchsorted(common, f) for f in flat]
    for k in (0, 1):
        at[k] = np.minimum(at[k], max(0, len(common) - 1))
        hit = common[at[k]] == flat[k] if len(common) else np.zeros(len(flat[k]), dtype=bool)
        order = np.argsort(at[k][hit], kind="stable")
        owner[k], at[k] = owner[k][hit][order], at[k][hit][order]
    for begin in range(0, len(common), width):
        blocks = []
        for k, n in ((0, len(left)), (1, len(right))):
            x, y = np.searchsorted(at[k], [begin, begin + width])
            block = np.zeros((n, min(width, len(common) - begin)), dtype=np.float32)
            block[owner[k][x:y], at[k][x:y] - begin] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric 0/1 matrix of links."""
    todo, out = np.ones(len(linked), dtype=bool), []
    while todo.any():
        root = int(np.argmax(todo))
        todo[root] = False
        front = [root]
        while front:
            i = front.pop()
            fresh = np.flatnonzero(linked[i] & todo)
            todo[fresh] = False
            out += [(i, int(j)) for j in fresh]
            front += fresh.tolist()
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream cells (band, hash, i, j), members in order, and emit a spanning forest of the exact links of each."""
    opened = zstandard.ZstdDecompressor()
    held: list[pa.RecordBatch] = []

    def cell(ids: np.ndarray, second: np.ndarray, sigs: list, packed: list, label: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        nothing = np.zeros((0, 2), dtype=np.int64)
        if label.min() == label.max():
            return nothing
        signs = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(sigs), COORDS)
        left = np.flatnonzero(~second)
        right = np.flatnonzero(second) if second.any() else left
        if not len(left):
            return nothing
        likely = _agreement(signs[left], signs[right]) >= LIKELY
        likely &= _first(earlier[left], earlier[right]) & (label[left][:, None] != label[right][None, :])
        rows, cols = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
        if not len(rows):
            return nothing
        need = np.union1d(left[rows], right[cols])
        texts = [opened.decompress(packed[i]) for i in need]
        sets = dict(zip(need.tolist(), (s for a, b in chunks([len(t) for t in texts]) for s in shingle_sets(texts[a:b])), strict=True))
        ours, theirs = [sets[i] for i in left[rows].tolist()], [sets[i] for i in right[cols].tolist()]
        both = _overlaps(ours, theirs)
        sizes = np.array([len(s) for s in ours])[:, None] + np.array([len(s) for s in theirs])[None, :]
        good = likely[np.ix_(rows, cols)] & (100 * both >= NUMERATOR * (sizes - both)) & (both > 0)
        linked = np.zeros((len(ids), len(ids)), dtype=bool)
        linked[np.ix_(left[rows], right[cols])] = good
        pairs = np.array(_forest(linked | linked.T), dtype=np.int64).reshape(-1, 2)
        return ids[pairs]

    def settle(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, labels, bands = rows["rep"].to_numpy(), rows["label"].to_numpy(), rows["band"].to_numpy()
        second, sigs, packed = rows["second"].to_numpy(), rows["sig"].to_pylist(), rows["packed"].to_pylist()
        earlier = np.concatenate([c.flatten().to_numpy() for c in rows["earlier"].chunks])  # as many in each row as its band
        at = np.concatenate([[0], np.cumsum(bands, dtype=np.int64)])
        begin, out = 0, [np.zeros((0, 2), dtype=np.int64)]
        for end in ends:
            if end - begin > 1:
                own = slice(begin, end)
                before = earlier[at[begin] : at[end]].reshape(end - begin, int(bands[begin]))
                out.append(cell(ids[own], second[own], sigs[own], packed[own], labels[own], before))
            begin = end
        pairs = np.concatenate(out)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        new = np.zeros(len(rows) - 1, dtype=bool)
        for c in ("band", "hash", "i", "j"):
            key = rows[c].to_numpy()
            new |= key[1:] != key[:-1]
        ends = np.flatnonzero(new) + 1
        if len(ends):
            yield from settle(rows.slice(0, ends[-1]), ends)
            rows = rows.slice(ends[-1])
        held = rows.combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield from settle(rows, np.array([len(rows)]))


def _opened(cells: DataFrame, contents: DataFrame, parts: int) -> DataFrame:
    """cells: band, hash, i, j, second, rep, label; contents: rep, bands, sig, packed. The exact links of all cells as stars
    (a, b): a spanning forest of each cell, and what a task finds joined in the same worker."""
    full = cells.join(contents, "rep").select(
        "band", "hash", "i", "j", "rep", "label", "second", "sig", "packed", F.slice("bands", F.lit(1), F.col("band")).alias("earlier")
    )
    placed = full.repartition(parts, "band", "hash", "i", "j").sortWithinPartitions("band", "hash", "i", "j", "rep")
    return placed.mapInArrow(lambda batches: joined(_links(batches)), "a long, b long")


def _paired(rows: DataFrame, others: Column) -> DataFrame:
    """A row for each cell of a member: its block `own` with each of `others`."""
    return rows.withColumn("other", F.explode(others)).select(
        "band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "label",
        (F.col("own") > F.col("other")).alias("second"),
    )


def _near_cells(members: DataFrame) -> DataFrame:
    """Each block of a bucket with itself and with the bucket's first: a few rows for each member, however large the
    bucket. All that is alike within a bucket becomes one component by that, but for rare texts."""
    n = F.ceil(F.col("size") / BLOCK)
    rows = members.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("rep", "band"), "n"))
    zero = F.lit(0).cast("long")
    return _paired(rows, F.when(F.col("own") == 0, F.sequence(zero, F.col("n") - 1)).otherwise(F.array(zero, "own")))


def _far_cells(labelled: DataFrame) -> DataFrame:
    """All pairs of blocks of the buckets that hold several components, but for two blocks of one and the same.

    A component that fills a block of a bucket has blocks of its own there, the others share blocks. So a bucket of one
    huge component and some strangers costs the strangers times the blocks, not the square of the blocks.
    """
    kinds = labelled.groupBy("band", "hash", "label").agg(F.sum("weight").alias("held"), F.max("size").alias("size"))
    large, blocks = F.col("held") >= BLOCK, F.ceil(F.col("held") / BLOCK)
    buckets = kinds.groupBy("band", "hash").agg(
        F.max("size").alias("size"), F.count("*").alias("labels"),
        F.ceil(F.coalesce(F.sum(F.when(~large, F.col("held"))), F.lit(0)) / BLOCK).alias("shared"),
        F.coalesce(F.sum(F.when(large, blocks)), F.lit(0)).alias("pure"),
    ).where("labels > 1")
    before = Window.partitionBy("band", "hash").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    own_blocks = kinds.where(large).select(
        "band", "hash", "label", "size", blocks.alias("mine"), F.coalesce(F.sum(blocks).over(before), F.lit(0)).alias("begin")
    )

    def salted(df: DataFrame) -> DataFrame:  # a row for each part of a bucket's members, so that none is joined as a whole
        return df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1))).drop("size")

    rows = labelled.withColumn("part", F.pmod(F.xxhash64("rep", "band"), F.ceil(F.col("size") / BLOCK)))
    rows = rows.join(salted(buckets), ["band", "hash", "part"]).join(salted(own_blocks), ["band", "hash", "part", "label"], "left")
    some, last = F.xxhash64("band", "rep"), F.col("shared") + F.col("pure") - 1
    first = F.col("shared") + F.col("begin")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    placed = rows.withColumns({
        "own": F.when(F.col("mine").isNull(), F.pmod(some, F.greatest("shared", F.lit(1)))).otherwise(first + F.pmod(some, "mine")),
        "all": F.sequence(zero, last),
        "low": F.when(first > 0, F.sequence(zero, first - 1)).otherwise(none),
        "high": F.when(first + F.col("mine") <= last, F.sequence(first + F.col("mine"), last)).otherwise(none),
    })
    return _paired(placed, F.when(F.col("mine").isNull(), F.col("all")).otherwise(F.concat("low", "high")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of `docs`.

    Texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.75 or more; component_id is the
    smallest id that can be reached over links, kept is true where that is the row's own. Words are what stands between
    white space, A-Z as a-z; a text of fewer than five words is one shingle.

    Null, empty and blank texts have no shingles and are their own components. Rows without an id have no component
    (null) and are kept. Rows that repeat an id each count with their own text. An empty table gives no rows.
    """
    parts = shuffle_parts(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    sketches = cut_lineage(texts.mapInArrow(_sketch, _SKETCH))
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    banded = classes.select("rep", (F.floor(F.col("n_shingles") / HEAVY) + 1).alias("weight"), F.posexplode("bands").alias("band", "hash"))
    h = F.xxhash64("rep")
    buckets = banded.groupBy("band", "hash").agg(
        F.count("*").alias("n"), F.sum("weight").alias("size"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y")
    ).where("n > 1")
    # of buckets of the same members only the first has pairs that no earlier band holds
    chosen = buckets.groupBy("n", "size", "x", "y").agg(F.min(F.struct("band", "hash")).alias("at")).select("at.band", "at.hash", "size")
    members = cut_lineage(banded.join(chosen, ["band", "hash"]).select("band", "hash", "rep", "weight", "size"))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    contents = cut_lineage(full.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "bands", "sig", "packed"))
    first = _near_cells(members.where(F.col("band") < FIRST_BANDS).withColumn("label", F.col("rep")))
    found = cut_lineage(components(_opened(first, contents, parts), as_stars=True))
    # small buckets of the first bands are settled; large ones only as far as their components
    rest = members.where((F.col("band") >= FIRST_BANDS) | (F.col("size") > BLOCK))
    labelled = rest.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "hash", "rep", "weight", "size", F.coalesce("component", "rep").alias("label")
    )
    more = _opened(_far_cells(labelled), contents, parts)
    found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), as_stars=True)
    named = classes.select("k1", "k2", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component")
    )
    own = sketches.select("doc_id", "n_shingles", "k1", "k2")
    blank = own.where("n_shingles = 0").withColumn("component", F.lit(None).cast("long"))
    out = own.where("n_shingles > 0").join(named, ["k1", "k2", "n_shingles"], "left").unionByName(blank)
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(True)).alias("kept")
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, n
"""
