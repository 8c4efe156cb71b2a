"""Periodic runs in the words of a text, and texts without their repetitions.

A run is a stretch of words that repeats with a smallest period q, is at least max(12, 2 q) words long, and cannot be made
longer. Every word of a run stands at least twice in it. So a segment is split at words that occur only once within it,
and its pieces again, until no piece has such a word; pieces of fewer than 12 words go. That leaves little of ordinary
prose. What survives is scanned lag by lag: short lags word by word; longer ones octave by octave, where a run's matching
stretch must hold an aligned block of words that stands again one lag further on. Blocks are told apart by exact names
(pairs of names of half the length), so nothing here rests on a hash.

A text is worked on whole, and alone if it is long. A scan takes time and memory in proportion to n log n for n surviving
words, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, table, words_of

#: Fewest words of a run; it also holds its period twice.
LEAST = 12
#: Lags below this are scanned word by word (a power of two).
SHORT_LAGS = 8
#: Pairs of blocks that are followed at once.
PAIRS = 1 << 18
#: Rounds of splitting. Each takes a cut's pieces together; only crafted texts are not stable long before, and what is left
#: of those is scanned as it is, which finds the same runs.
ROUNDS = 64


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners 0 0 1 1 1 and places 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def surviving_segments(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments that runs can lie in. ids: numbers of the words of texts one after another, which begin
    at at[:-1]."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before, after = np.full(len(ids), -1), np.full(len(ids), len(ids))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    starts, ends = at[:-1], at[1:]
    done = [(starts[:0], ends[:0])]
    for _ in range(ROUNDS):
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        owner, place = _spread(ends - starts)
        word = starts[owner] + place
        alone = (before[word] < starts[owner]) & (after[word] >= ends[owner])
        split = np.bincount(owner[alone], minlength=len(starts)) > 0
        done.append((starts[~split], ends[~split]))
        if not split.any():
            starts, ends = starts[:0], ends[:0]
            break
        cuts = word[alone]
        starts, ends = np.sort(np.concatenate([starts[split], cuts + 1])), np.sort(np.concatenate([cuts, ends[split]]))
    done.append((starts, ends))
    starts, ends = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return starts[ends - starts >= LEAST], ends[ends - starts >= LEAST]


def _names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[k][i] is the same for equal blocks of 2**k items that begin at i, up to blocks of `longest` items."""
    names = [np.unique(x, return_inverse=True)[1].astype(np.int32)]
    while 2 << (len(names) - 1) <= longest:
        last, half = names[-1].astype(np.int64), 1 << (len(names) - 1)
        pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    return names


def _agree(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """For how many items from a and b (a < b) on the sequence agrees with itself: forwards, or backwards from the items
    before them (step -1)."""
    n = np.zeros(len(a), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        left, right = (a + n, b + n) if step > 0 else (a - n - (1 << k), b - n - (1 << k))
        inside = (left >= 0) & (right < len(names[k]))
        n += np.where(inside & (names[k][np.where(inside, left, 0)] == names[k][np.where(inside, right, 0)]), 1 << k, 0)
    return n


def _scan(x: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of x; equal items at most `longest` - 1 apart lie in one segment."""
    found: list[tuple[np.ndarray, ...]] = []

    def keep(start: np.ndarray, stretch: np.ndarray, lag: np.ndarray) -> None:
        ok = stretch >= np.maximum(lag, LEAST - lag)
        found.append((start[ok], (stretch + lag)[ok], lag[ok]))

    for lag in range(1, min(SHORT_LAGS, longest // 2 + 1)):
        edge = np.diff((x[:-lag] == x[lag:]).astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep(start, end - start, np.full(len(start), lag))
    if longest // 2 >= SHORT_LAGS:
        names = _names(x, longest)
        octave = SHORT_LAGS
        while octave <= longest // 2:
            block = octave // 2
            name = names[block.bit_length() - 1].astype(np.int64)
            order = np.argsort(name, kind="stable")
            width = len(x) + 1
            place = name[order] * width + order
            check = np.arange(0, len(name), block)
            low = np.searchsorted(place, name[check] * width + check + octave)
            high = np.searchsorted(place, name[check] * width + np.minimum(check + 2 * octave, len(x)))
            counts = np.maximum(high - low, 0)
            bound = np.concatenate([[0], np.cumsum(counts)])
            begin = 0
            while begin < len(check):
                end = max(begin + 1, int(np.searchsorted(bound, bound[begin] + PAIRS, side="right")) - 1)
                owner, k = _spread(counts[begin:end])
                if len(owner):
                    a = check[begin:end][owner]
                    b = order[low[begin:end][owner] + k]
                    left = _agree(names, a, b, -1)
                    keep(a - left, left + _agree(names, a, b, 1), b - a)
                begin = end
            octave *= 2
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    # what repeats with a period repeats with its multiples: of equal stretches the smallest period is meant
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find_runs(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of several texts, by start, then period. ids: numbers of their words one after
    another; at: where each text begins, and the end."""
    starts, ends = surviving_segments(ids, at)
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 3
    owner, place = _spread(ends - starts + 1)  # one more for an item of its own behind each segment
    word = starts[owner] + place
    border = place == (ends - starts)[owner]
    x = np.where(border, int(ids.max()) + 1 + owner, ids[np.where(border, 0, word)])
    start, length, period = _scan(x, int((ends - starts).max()))
    return word[start], length, period


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), kept[bounds]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def mark_runs(df: DataFrame, text_col: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """`df` with the runs of each whole text, by start and period (word numbers from 0), and the text that is left when of each
    run only the first period stays: words that no run holds beyond its first period, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`, told apart byte by byte. Null, empty and blank texts have no runs and leave an empty text;
    every row is judged by its own text, repeated or not, and stays. No rows give none. Other columns are kept; the two new
    names must not be there yet.
    """
    for name in (runs, collapsed):
        if name in df.columns:
            raise ValueError(f"there is a column {name} already")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            words, bounds = _split(batch.column(at))
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            start, length, period = find_runs(ids, bounds)
            text = np.searchsorted(bounds, start, side="right") - 1
            offsets = np.searchsorted(start, bounds)
            found = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(start - bounds[text]), pa.array(length), pa.array(period)], ["start", "length", "period"]),
            )
            step = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, start + length, -1)
            stay = np.cumsum(step[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stay)])[bounds]
            left = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stay)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, found, pc.binary_join(left, " ")], [*batch.schema.names, runs, collapsed]
            )

    schema = df.select("*", F.expr(f"cast(array() as {RUNS})").alias(runs), F.lit("").alias(collapsed)).schema
    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------------------------------


def with_periodic_tail(text: Column, doc_id: Column) -> Column:
    """The text with the tail that the query plants: where h = crc32 of the decimal id is divisible by 10, g = h div 10, each
    word from a = g mod n on becomes one of the p = 1 + (n - a) div (3 + g mod 8) words from a. Others, and rows without an
    id, stay."""

    def planted(v: Column) -> Column:
        g = F.floor(v["h"] / 10)
        n = F.size(v["words"])
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda j: F.get(v["words"], a + j % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(v["words"], F.lit(1), a), tail), " ")).otherwise("")

    h = F.crc32(doc_id.cast("long").cast("string").cast("binary"))
    # an array of one, so that words are split once and not for each of them
    once = F.transform(F.array(F.struct(words_of(text).alias("words"), h.alias("h"))), planted)
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.get(once, F.lit(0))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = mark_runs(docs.select("doc_id", with_periodic_tail(F.col("text"), F.col("doc_id")).alias("text"))).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(*[x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))]))
    return marked.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 byte by byte and bit by bit, then all pairs of equal words of a text by their distance; stretches of those.
OP12_SQL = r"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), hashed AS (
    SELECT *, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295::BIGINT, list_reduce(
               list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END)) END AS h
    FROM split
), cut AS (
    SELECT *, (h // 10) % nullif(n, 0) AS a FROM hashed
), tail AS (
    SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut
), word AS (
    SELECT r, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x
    FROM (SELECT *, unnest(range(n)) AS i FROM tail)
), pair AS (
    SELECT f.r, b.i - f.i AS q, f.i FROM word f JOIN word b ON f.r = b.r AND f.x = b.x AND f.i < b.i AND 2 * (b.i - f.i) <= f.n
), stretch AS (
    SELECT r, q, min(i) AS s, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pair)
    GROUP BY r, q, island HAVING count(*) >= greatest(q, 12 - q)
), run AS (
    SELECT r, s, m + q AS length, min(q) AS period FROM stretch GROUP BY r, s, m + q
), listed AS (
    SELECT r, count(*) AS n_runs, max({'l': length, 's': -s, 'p': -period}) AS best,
           string_agg(s || ',' || length || ',' || period || chr(10), '' ORDER BY s, period) AS shown
    FROM run GROUP BY r
), gone AS (
    SELECT DISTINCT r, unnest(range(s + period, s + length)) AS i FROM run
), kept AS (
    SELECT r, string_agg(x, ' ' ORDER BY i) AS body FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS start, best.l::BIGINT AS length, (-best.p)::BIGINT AS period,
       (1000 * best.l // -best.p)::BIGINT AS exponent_milli, sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM split LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
