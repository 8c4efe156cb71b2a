"""Document fingerprints by one-permutation MinHash.

Every shingle hash is thrown once: its high bits choose a bin, the rest compete for the bin's minimum. Empty bins borrow
from bins that a universal hash chooses (optimal densification), so that any two fingerprints can be compared bin by bin.
Only `BITS` low-order bits of each bin are stored; chance agreement of those is taken out of the likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, mix64, shingle_sets, shuffle_parts, slices, table, text_bytes

#: Bins of a fingerprint (a power of two), and low-order bits kept of each (4: two bins a byte).
BINS, BITS = 256, 4
#: Text that one task streams, about.
RANGE_BYTES = 32 << 20
_BIN_BITS = BINS.bit_length() - 1
_EMPTY = np.iinfo(np.uint64).max


def _minima(shingles: list[np.ndarray]) -> np.ndarray:
    """For each set the minimum of each bin, empty bins filled; rows of empty sets stay empty."""
    sizes = np.array([len(s) for s in shingles])
    out = np.full((len(shingles), BINS), _EMPTY, dtype=np.uint64)
    if sizes.sum():
        thrown = mix64(np.concatenate(shingles) ^ np.uint64(0x5851F42D4C957F2D))
        bins = (thrown >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        flat = out.reshape(-1)
        np.minimum.at(flat, np.repeat(np.arange(len(shingles)), sizes) * BINS + bins, thrown << np.uint64(_BIN_BITS))
    full = out != _EMPTY
    row, empty = np.nonzero(~full & (sizes > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (mix64(empty.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) & np.uint64(BINS - 1)).astype(np.int64)
        found = full[row, donor]
        out[row[found], empty[found]] = out[row[found], donor[found]]
        row, empty = row[~found], empty[~found]
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of packed bytes for each text; a text without words is all zero."""
    minima = _minima(shingle_sets(texts))
    low = (mix64(minima) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    packed = low[:, 0::2] << 4 | low[:, 1::2]
    packed[(minima == _EMPTY).all(axis=1)] = 0
    return packed


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets behind two arrays of fingerprints, 0 to 1.

    Bins of different minima agree by chance once in 2**BITS; that share is taken out. Equal fingerprints give 1; a
    text without words is like nothing but another such text.
    """
    differ = a ^ b
    agree = ((differ & 15 == 0).sum(axis=1) + (differ >> 4 == 0).sum(axis=1)) / BINS
    chance = 2.0**-BITS
    out = np.clip((agree - chance) / (1 - chance), 0, 1)
    out[a.any(axis=1) != b.any(axis=1)] = 0
    return out


def fingerprint_column(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of `text_col` as base64 in a column `name` (which must not be there yet).

    Null text counts as empty; every row is kept, repeated or not.
    """
    at = df.columns.index(text_col)
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            prints = _shown(fingerprints(text_bytes(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, name])

    return df.mapInArrow(run, df.select("*", F.lit("").alias(name)).schema)


# ---------------------------------------------------------------------------------------------------------------------
# Each document against an edited copy of itself and against its successor.

EDITED_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _shown(prints: np.ndarray) -> pa.Array:
    return pa.array([base64.b64encode(x.tobytes()).decode() for x in prints], pa.string())


def _compare(rows: list[tuple[int | None, str]], own: np.ndarray) -> pa.RecordBatch:
    """rows: (doc_id, text) in order, own: their fingerprints. Each but the last against its edited text and the next."""
    edited = [_edited(text, after) for (_, text), (_, after) in zip(rows, rows[1:])]  # noqa: B905
    other = fingerprints([t.encode() for t in edited])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows[:-1]], pa.int64()),
            pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            _shown(own[:-1]), _shown(other), pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
        ],
        _NAMES,
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, id, text) of one range in order: every row meets the next. The first and the last row of the range also
    come out with their texts (edge 'first', 'last'), for what stands at the border of two ranges."""
    held: list[tuple] = []
    own = np.zeros((0, BINS * BITS // 8), dtype=np.uint8)
    part, size = None, 0

    def edge(kind: str, row: tuple) -> pa.RecordBatch:
        values = {"doc_id": row[0], "part": part, "edge": kind, "body": row[1]}
        return pa.RecordBatch.from_pylist([values], schema=_STREAMED)

    def settled() -> pa.RecordBatch:
        nonlocal held, own, size
        fresh = fingerprints([t.encode() for _, t in held[len(own) :]])
        own = np.concatenate([own, fresh])
        out = _compare(held, own)
        held, own, size = held[-1:], own[-1:], 0
        n = out.num_rows
        return pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(n, _STREAMED.field(c).type) for c in ("part", "edge", "body"))], schema=_STREAMED)

    for batch in batches:
        rows = (row for piece in slices(batch, 2) for row in zip(*(c.to_pylist() for c in piece.columns), strict=True))
        for k, doc_id, text in rows:
            if part is None:
                part = k
                yield edge("first", (doc_id, text))
            held.append((doc_id, text))
            size += len(text)
            if size > 1 << 19 and len(held) > 1:
                yield settled()
    if len(held) > 1:
        yield settled()
    if held:
        yield edge("last", held[-1])


_STREAMED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
     ("part", pa.int32()), ("edge", pa.string()), ("body", pa.string())]
)


def _at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield _compare([(doc_id, text), (None, after)], fingerprints([text.encode(), after.encode()]))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint every document and a copy whose last quarter is taken from its successor in ascending id.

    Documents are dealt by ranges of id, hash of the text and place in the input, each of about RANGE_BYTES; every task
    streams its range in order, and the text moves once. Two rows of each range are kept with their texts to be compared
    over the borders; what the driver sees is the numbers of the ranges.

    Null text is empty; a null id counts as the smallest; equal ids stand by hash of the text, and rows equal in both by
    place in the input (equal texts are alike), so any number of them is spread over ranges. The last document's
    successor is the first; a single document is its own. An empty table gives no rows. Other columns are ignored.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    ).select("id", "body", F.xxhash64("body").alias("h"), F.monotonically_increasing_id().alias("place"))
    if parts is None:
        held = own.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        parts = max(shuffle_parts(docs.sparkSession), -(-held // RANGE_BYTES))
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("place")]
    ranged = own.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = EDITED_SCHEMA + ", part int, edge string, body string"
    streamed = cut_lineage(ranged.select(F.spark_partition_id().alias("part"), "id", "body").mapInArrow(_stream, schema))
    firsts, lasts = streamed.where("edge = 'first'"), streamed.where("edge = 'last'")
    order = [r.part for r in firsts.select("part").orderBy("part").collect()]  # a number for each range
    if not order:
        return streamed.select(*_NAMES)
    follow = docs.sparkSession.createDataFrame([(k, order[(i + 1) % len(order)]) for i, k in enumerate(order)], "part int, next int")
    met = lasts.join(follow, "part").join(firsts.select(F.col("part").alias("next"), F.col("body").alias("after")), "next")
    borders = met.select("doc_id", "body", "after").mapInArrow(_at_borders, EDITED_SCHEMA)
    return streamed.where("edge is null").select(*_NAMES).unionByName(borders)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
