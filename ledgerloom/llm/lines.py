"""Line deduplication by range-partitioned, sorted line hashes.

Keys are 128-bit hashes of normalised lines. Rows (hash, document, position) are range-partitioned and sorted by hash,
then document, largest first, then position; each task streams its rows, keeps the first document of each run and drops
the line elsewhere. A run that a partition boundary cuts is settled from a small table with one row for each such run,
so a line that a third of all documents hold is spread over many tasks. Text never moves for this: the result is one
compressed bitmap of kept lines for each document that loses any.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, cut_lineage, shuffle_parts, slices, table

_TRIM = "\x20\x09\x0a\x0b\x0c\x0d"
_RUNS = "cut boolean, h1 long, h2 long, doc_id long, body long, pos int"
_RUN_COLS = ["h1", "h2", "doc_id", "body", "pos"]


def _line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    ).where("doc_id is not null")
    lines = lines.select("doc_id", F.xxhash64("t").alias("body"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(_TRIM)))
    # a line of fewer bytes has fewer code points still: most short lines need no trimming
    lines = lines.where(F.octet_length("line") >= min_chars).select("doc_id", "body", "pos", key.alias("key"))
    return lines.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "body", "pos"
    )


def _stream(min_docs: int):
    """Emit the lines that go (cut false), and every row of the first and last run of the partition (cut true)."""

    def out(cut: bool, cols: list[np.ndarray]) -> pa.RecordBatch:
        n = len(cols[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, cut)), *(pa.array(c) for c in cols)], ["cut", *_RUN_COLS]
        )

    def whole(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch | None:
        """Drops of complete runs."""
        doc = cols[2]
        lengths = np.diff(np.append(starts, len(doc)))
        fresh = np.append(True, doc[1:] != doc[:-1])
        fresh[starts] = True
        docs = np.repeat(np.add.reduceat(fresh, starts, dtype=np.int64), lengths)
        gone = (docs >= min_docs) & (doc != np.repeat(doc[starts], lengths))
        return out(False, [c[gone] for c in cols]) if gone.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None  # the key of the first run, while it lasts
        leading, held = True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            first = first or (cols[0][0], cols[1][0])
            if leading:  # rows of the first run pass at once, whatever their number
                n = int(((cols[0] == first[0]) & (cols[1] == first[1])).sum())
                yield out(True, [c[:n] for c in cols])
                leading, cols = n == batch.num_rows, [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            starts = np.flatnonzero(new)
            last = starts[-1]
            if last and (done := whole([c[:last] for c in cols], starts[:-1])):
                yield done
            held = [c[last:] for c in cols]
        if held:
            yield out(True, held)

    return run


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    parts: int | None = None,
) -> DataFrame:
    """One row (doc_id, body, n_dropped, keep) for each document that loses lines.

    A line's key is the line without white space at its ends, A-Z as a-z. Keys of `min_chars` code points or more that
    are in `min_docs` or more documents stay in the largest id alone. `keep` is a zlib-compressed bit string, bit i for
    line i, as far as the byte of the last dropped line; `body` is the xxhash64 of the text, which tells rows of one id apart.

    Null text is one empty line. Rows without an id hold no lines for others and lose none. Rows that repeat an id are
    one document: its lines stay or go together. An empty table gives no rows. Other columns are ignored.
    """
    parts = parts or shuffle_parts(docs.sparkSession)
    # range partitioning reads its rows twice, for bounds and for rows: they are written once instead of hashed again
    rows = cut_lineage(_line_rows(docs, id_col, text_col, min_chars))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("body"), F.col("pos")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    runs = cut_lineage(ranged.mapInArrow(_stream(min_docs), _RUNS))
    pending = runs.where("cut")
    # one row for each run that a boundary cuts: two for each partition at most, hence the broadcast
    settled = (
        pending.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )
    late = pending.join(F.broadcast(settled), ["h1", "h2"]).where("doc_id <> keeper")
    drops = runs.where("not cut").select("doc_id", "body", "pos").unionByName(late.select("doc_id", "body", "pos"))
    grouped = drops.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("dropped"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps, counts = [], []
            for dropped in batch.column(2).to_pylist():
                bits = np.ones(max(dropped) // 8 * 8 + 8, dtype=np.uint8)
                bits[dropped] = 0
                keeps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
                counts.append(len(dropped))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())],
                ["doc_id", "body", "n_dropped", "keep"],
            )

    return grouped.mapInArrow(pack, "doc_id long, body long, n_dropped long, keep binary")


def _kept(text: str, keep: bytes | None) -> tuple[int, str]:
    """Number of lines, and the text of those that stay."""
    if keep is None:
        return text.count("\n") + 1, text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))
    return len(lines), "\n".join([x for i, x in enumerate(lines) if i >= len(bits) or bits[i]])


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[DataFrame, list[str]]:
    """`docs` next to its bitmaps (columns _keep, _n_dropped); its own columns renamed by position, so none clashes."""
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own_id, own_text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    maps = maps.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("n_dropped").alias("_n"), "keep")
    same = (F.col(own_id).cast("long") == F.col("_id")) & (
        F.xxhash64(F.coalesce(F.col(own_text), F.lit(""))) == F.col("_body")
    )
    return named.join(maps.hint("shuffle_hash"), same, "left").drop("_id", "_body"), [own_id, own_text]


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """`docs` with the bitmaps of `keep_bitmaps` applied to its text; all its rows and columns stay."""
    joined, (_, own_text) = _with_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    kept = joined.select(*(f"c{i}" for i in range(len(docs.columns))), "keep")
    at = int(own_text[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            cols, keep = list(batch.columns[:-1]), batch.column(batch.num_columns - 1).to_pylist()
            if any(k is not None for k in keep):
                texts = cols[at].to_pylist()
                texts = [t if k is None else _kept(t or "", k)[1] for t, k in zip(texts, keep, strict=True)]
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    out = kept.mapInArrow(run, kept.drop("keep").schema)
    return out.toDF(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined, (own_id, own_text) = _with_bitmaps(docs, "doc_id", "text", 40, 5)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            kept = [_kept(t or "", k) for t, k in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in kept], pa.int64()),
                    batch.column(2).fill_null(0),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in kept]),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return joined.select(own_id, own_text, "_n", "keep").mapInArrow(
        digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


OP7_SQL = """
WITH lines AS (
    SELECT doc_id, t.pos, t.line,
           translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
         LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) t
), keys AS (
    SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT l.*, coalesce(l.doc_id <> keys.keeper, false) AS gone FROM lines l LEFT JOIN keys ON l.k = keys.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
