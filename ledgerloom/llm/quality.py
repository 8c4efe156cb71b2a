"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of each whole text are worked out in Arrow batches. On a bounded sample of labelled rows, shallow trees are
grown; every path from a root is a conjunctive rule; lasso logistic regression keeps the few that matter. The rules that
stay become one Spark column expression over the statistics, which scores the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, table, text_bytes, word_hashes

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS = 24, 3, 32
#: A text of at least this score passes.
THRESHOLD = 0.3

STATISTICS = [
    "words", "word_length", "upper_share", "symbol_share", "pipe_share", "bang_share", "stop_share", "digit_share",
    "line_share", "other_share", "distinct_share", "repeat_share", "top_share",
]


def _classes() -> np.ndarray:
    """The class of each byte, as a column of a 256 x 8 table of zeros and ones."""
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*+<=>@\\^_`{}~/[]", b"|", b"!?", b".,;:", b"0123456789", b"\n"]
    out = np.zeros((256, 8))
    for i, g in enumerate(groups):
        out[list(g), i] = 1
    out[:128, 7] = 1
    for c in range(128):
        if chr(c).isalnum() or chr(c) in " \t\n\r\v\f" or out[c, :7].any():
            out[c, 7] = 0
    return out


_CLASSES = _classes()


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text; zeros for one without words."""
    hashes, at = word_hashes(texts)
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, t in enumerate(texts):
        w = hashes[at[i] : at[i + 1]]
        if not len(w):
            continue
        counts = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
        chars = len(t) - counts[128:192].sum()
        kinds = np.sort(w)
        edges = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1], [True]]))
        out[i] = [
            math.log1p(len(w)), chars / len(w), *(counts @ _CLASSES / chars),
            (len(edges) - 1) / len(w), (w[1:] == w[:-1]).sum() / len(w), np.diff(edges).max() / len(w),
        ]
    return out


def with_statistics(df: DataFrame, text_col: str = "text", name: str = "statistics") -> DataFrame:
    """`df` with an array of STATISTICS in a column `name` (which must not be there yet); null text is empty."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                rows = statistics(text_bytes(batch.column(at)))
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    return df.mapInArrow(run, df.select("*", F.array().cast("array<double>").alias(name)).schema)


@dataclass(frozen=True)
class Rule:
    """All of its bounds hold: (statistic, low, high) stands for low < value <= high."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, low, high in self.bounds:
            out &= (x[:, k] > low) & (x[:, k] <= high)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def column(self, values: Column) -> Column:
        """Score of an array of STATISTICS, 0 to 1. Weights and bounds are literal arrays that one expression runs over: with a
        branch for each rule, planning and compiling it took more of the driver's memory than anything else."""
        total = F.lit(self.intercept)
        if self.rules:
            wide = max(len(r.bounds) for _, r in self.rules)
            padded = [[*r.bounds, *[(0, -math.inf, math.inf)] * (wide - len(r.bounds))] for _, r in self.rules]
            table = [np.array([w for w, _ in self.rules], dtype=float)]
            for j in range(wide):
                table += [np.array(c, dtype=t) for c, t in zip(zip(*(b[j] for b in padded), strict=True), (np.int32, float, float), strict=True)]

            def add(so_far: Column, rule: Column) -> Column:
                holds = F.lit(True)
                for j in range(1, len(table), 3):
                    value = values[rule[str(j)]]
                    holds = holds & (value > rule[str(j + 1)]) & (value <= rule[str(j + 2)])
                return so_far + F.when(holds, rule["0"]).otherwise(F.lit(0.0))

            total = F.aggregate(F.arrays_zip(*(F.lit(c) for c in table)), total, add)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    """The paths of one tree, grown on the rows given by Gini gain over quantile cuts of half of the statistics."""
    features = rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False)
    found: list[Rule] = []

    def grow(rows: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int) -> None:
        if bounds:
            found.append(Rule(tuple((k, *v) for k, v in sorted(bounds.items()))))
        own = y[rows]
        if depth == DEPTH or len(rows) < 20 or own.min() == own.max():
            return
        best = (1e-9, -1, 0.0)
        base = own.mean() * (1 - own.mean()) * len(rows)
        for k in features:
            values = x[rows, k]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))
            place = np.searchsorted(cuts, values, side="left")
            n = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
            p = np.cumsum(np.bincount(place, weights=own, minlength=len(cuts) + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                m, q = len(rows) - n, own.sum() - p
                gain = base - (p - p * p / n) - (q - q * q / m)
            gain = np.where((n >= 5) & (m >= 5), gain, -1)
            if len(gain) and gain.max() > best[0]:
                # the middle of the gap between the cut and the next larger value
                cut = cuts[int(gain.argmax())]
                above = values[values > cut]
                best = (gain.max(), int(k), float((cut + above.min()) / 2))
        _, k, cut = best
        if k < 0:
            return
        low, high = bounds.get(k, (-math.inf, math.inf))
        below = x[rows, k] <= cut
        grow(rows[below], {**bounds, k: (low, min(high, cut))}, depth + 1)
        grow(rows[~below], {**bounds, k: (max(low, cut), high)}, depth + 1)

    grow(rng.integers(0, len(x), len(x)), {}, 0)
    return found


def _lasso(full: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all weights but that of the last column (ones, the intercept), by
    accelerated proximal gradient. `full` holds zeros and ones in single precision: 20,000 rows by 250 rules are 20 MB,
    and nothing of that size is made beside it; the step comes from the small matrix of its products."""
    step = 4 * len(y) / max(1e-9, float(np.linalg.eigvalsh((full.T @ full).astype(float))[-1]))
    w = z = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(full @ z.astype(np.float32)).astype(float))) - y
        grad = (miss.astype(np.float32) @ full).astype(float) / len(y)
        new = z - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleEnsemble:
    """x: rows of STATISTICS; y: 0 or 1. Labels of one kind give their constant, none gives 0.5; the same rows give
    the same ensemble."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    rng = np.random.default_rng(7)
    rules: dict[bytes, Rule] = {}
    for _ in range(TREES):
        for rule in _paths(x, y, rng):
            covered = rule.holds(x)
            if 0.002 * len(x) <= covered.sum() <= 0.998 * len(x):
                rules.setdefault(np.packbits(covered).tobytes(), rule)
    kept = list(rules.values())
    full = np.ones((len(x), len(kept) + 1), dtype=np.float32)
    for k, rule in enumerate(kept):
        full[:, k] = rule.holds(x)
    weights, intercept = _lasso(full, y, penalty)
    return RuleEnsemble(intercept, tuple((float(w), r) for w, r in zip(weights, kept, strict=True) if abs(w) > 1e-6))


def fit_on_labels(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", rows: int = SAMPLE_ROWS,
) -> RuleEnsemble:
    """Fit on the labelled documents for which `held_out` (over doc_id) is false, `rows` of them at most.

    Labels without id or value don't count; several labels of one document count as their mean, 0.5 as 1; documents
    that repeat an id count once. Only the sampled ids are broadcast and only their statistics reach the driver: both
    are bounded by `rows`.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
    if held_out is not None:
        known = known.where(~held_out)
    sample = known.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    joined = with_statistics(texts.join(F.broadcast(sample), "doc_id"), "body").select("doc_id", "y", "statistics")
    got = joined.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("statistics").alias("x")).orderBy("doc_id").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    return fit(x, (got["y"].to_numpy() >= 0.5).astype(float))


def held_out(id_column: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows' labels are kept for evaluation. A null id is not."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 in a column `name`; null text is empty, every row stays."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    own = f"{name}_statistics_"
    return with_statistics(docs, text_col, own).withColumn(name, model.column(F.col(own))).drop(own)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_on_labels(docs, labels, held_out())
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
