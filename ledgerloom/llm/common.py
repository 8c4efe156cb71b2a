"""What the corpus operators share: table access, lineage cuts and exact 64-bit text hashing."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every corpus contract: space, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Text bytes that are turned into arrays at once inside a task; only one longer text goes beyond it.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to the checkpoint folder that all executors share, and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir. Where that is unset, one is
    made on a local master alone; on a cluster a local folder would not be shared, so it is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


#: A key of at least this part of all rows is hot: there are as many such keys at most.
HOT_PART = 1024


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int | None = None) -> DataFrame:
    """`rows` joined to `keyed`, which has one row for each key of `rows`, with the number of its rows in a column `count`
    (dropped). Hot keys are broadcast, HOT_PART of them at most, so no task joins all rows of one. `total`: the number of
    all rows, where it is known; `keyed` isn't written then."""
    if total is None:
        keyed = cut_lineage(keyed)
        total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) >= max(1, total // HOT_PART)
    often = F.broadcast(keyed.where(hot).drop(count))
    rest = rows.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti")
    return rows.join(often, on).unionByName(rest.join(keyed.where(~hot).drop(count), on))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, as the contracts say; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text, in order, as an array; none for null or white space only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


# ---------------------------------------------------------------------------------------------------------------------
# Shingle sets inside tasks: vectorised over a chunk of texts.

_MASK = (1 << 64) - 1
_WORD_PRIME = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_values() -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    return values


_BYTES = _byte_values()
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of an odd constant and of its inverse modulo 2**64, grown as far as asked."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + (1 << 16))
            factors = np.full(n, _WORD_PRIME, dtype=np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = pow(_WORD_PRIME, -1, 1 << 64)
            self.down = np.multiply.accumulate(factors)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts one after another, A-Z read as a-z, and len(texts) + 1 offsets."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    up, down = _POWERS.upto(len(data) + 1)
    inside = ~_IS_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts])
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its distinct `width`-word shingles as sorted 64-bit hashes; a shorter text is one shingle, an
    empty one has none."""
    words, at = word_hashes(texts)
    spread = words * np.uint64(_STEP)
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    factor = 1
    for k in range(width):
        rolled += words[k : k + len(rolled)] * np.uint64(factor)
        factor = factor * _STEP & _MASK
    rolled = mix64(rolled)
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            factor, value = 1, np.zeros(1, dtype=np.uint64)
            for k in range(a, b):
                value += words[k : k + 1] * np.uint64(factor)
                factor = factor * _STEP & _MASK
            out.append(mix64(value + np.uint64(b - a)))
        else:
            out.append(spread[:0])
    return out


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about `most` bytes each."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def slices(batch: pa.RecordBatch, at: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `most` text bytes in column `at`, so that only a slice of a batch is ever held as
    Python objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at).cast(pa.binary())), 0).to_pylist()
    for a, b in chunks(sizes, most):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
