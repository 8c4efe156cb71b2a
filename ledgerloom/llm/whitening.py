"""Embedding whitening: leading principal components at unit variance.

Means and covariance are worked out by Spark over the distinct vectors: partial sums of every task are added up by place, so a
vector that most rows share counts once and moves once a task. The covariance (d by d numbers for vectors of d, whatever the
number of rows) is taken apart by contour integration: an interval of eigenvalues is enclosed by a circle; solving the complex
shifted systems at a few points of it and adding the solutions projects random vectors onto the eigenvectors inside;
Rayleigh-Ritz takes those out. How many there must be is known beforehand from inertia, the signs of the pivots of a shifted
matrix, so that none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, table

#: Entries are counted in 256ths. Those beyond LARGEST would not fit; such rows take no part, like those with infinite entries.
SCALE, LARGEST = 256, float(1 << 53)
#: Points on the upper half of a circle; eigenvalues that one circle encloses, about; a part of the trace that counts as nothing.
POINTS, INSIDE, NOTHING = 16, 8, 1e-11


# ---------------------------------------------------------------------------------------------------------------------
# Eigenvectors of a small symmetric matrix, on the driver.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squares beside it of a tridiagonal matrix that is congruent and similar to `a`, by Householder reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = 0
        a[k + 1, k] = -np.copysign(norm, v[0])
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def inertia(diagonal: np.ndarray, beside: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than `shift`: the positive pivots of the shifted matrix (Sylvester's law)."""
    tiny = np.finfo(float).tiny ** 0.5
    above, pivot = 0, 1.0
    for i, x in enumerate(diagonal.tolist()):
        pivot = x - shift - (float(beside[i - 1]) / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def _separated(diagonal: np.ndarray, beside: np.ndarray, least: int, top: float) -> list[tuple[float, int]]:
    """Shifts from `top` downwards, each with the number of eigenvalues above it: consecutive intervals, the last of which holds
    the eigenvalue number `least`. Shifts lie in gaps, so equal eigenvalues are never parted."""

    def place(number: int) -> float:
        """The eigenvalue with this number, from 1, the largest first."""
        low, high = -1e-3, top
        while high - low > 4e-16 * top and high - low > 1e-14:
            middle = (low + high) / 2
            if inertia(diagonal, beside, middle) >= number:
                low = middle
            else:
                high = middle
        return (low + high) / 2

    shifts, n, begun, widest = [(top, 0)], 1, 0, (0.0, 0, 0.0)
    here = place(1)
    while True:
        below = place(n + 1) if n < len(diagonal) else -2e-3
        gap = here - below
        if n >= least and gap > 1e-10 or n == len(diagonal):
            return [*shifts, ((here + below) / 2, n)]
        widest = max(widest, (gap, n, (here + below) / 2))
        if n - begun >= INSIDE and widest[0] > 1e-10:
            shifts.append((widest[2], widest[1]))
            begun, widest = widest[1], (0.0, 0, 0.0)
        n, here = n + 1, below


def _inside(a: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues of `a` between low and high, the largest first, and their unit vectors as columns."""
    d = len(a)
    x, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 + x)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = radius * np.exp(1j * angles)
    # the solutions for any right sides; what all rounds need of the shifted systems
    solved = sum(w / 2 * (t * np.linalg.inv((centre + t) * np.eye(d) - a)).real for w, t in zip(weights, turns, strict=True))
    size = min(d, 2 * count + 4)
    for size in (size, min(d, 3 * size), d):
        y = rng.standard_normal((d, size))
        best = np.inf
        for _ in range(40):
            q = np.linalg.qr(solved @ y)[0]
            values, small = np.linalg.eigh(q.T @ a @ q)
            y = q @ small
            mine = np.flatnonzero((values > low) & (values <= high))[::-1]
            miss = np.abs(a @ y[:, mine] - y[:, mine] * values[mine]).max() if len(mine) else np.inf
            if len(mine) == count and miss <= 1e-13 and miss >= best / 2:  # no longer getting better
                return values[mine], y[:, mine]
            best = min(best, miss) if len(mine) == count else np.inf
    raise ArithmeticError(f"{count} eigenvalues between {low} and {high}, {len(mine)} found, residual {miss}")


def leading_components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a covariance matrix, falling, and their unit eigenvectors as columns, each with its
    largest entry positive. Eigenvalues that are nothing beside the trace, and their vectors, are left out."""
    trace = float(np.trace(a))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(a), 0))
    scaled = a / trace
    diagonal, beside = tridiagonal(scaled)
    most = min(most, inertia(diagonal, beside, NOTHING))
    rng = np.random.default_rng(11)
    values, vectors = [], []
    shifts = _separated(diagonal, beside, most, 1 + 1e-3)
    for (high, above), (low, upto) in zip(shifts, shifts[1:]):  # noqa: B905
        e, u = _inside(scaled, low, high, upto - above, rng)
        values.append(e)
        vectors.append(u)
    e, u = np.concatenate(values)[:most], np.concatenate(vectors, axis=1)[:, :most]
    return e * trace, u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(most)])


# ---------------------------------------------------------------------------------------------------------------------
# Sums over the rows, in tasks.


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _totals(fit_list: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors x and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            # halves of 32 bits, so that sums of any batch fit
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            n += len(x)
            sums = [s + (h << 32) + v for s, h, v in zip(sums, high, low, strict=True)]
        if n:
            values = [Decimal(v) for v in (n, *sums)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["place", "s"])

    rows = fit_list.mapInArrow(run, "place int, s decimal(38,0)").groupBy("place").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    got = {r.place: int(r.s) for r in rows.collect()}  # dims + 1 numbers
    return got.get(-1, 0), [got.get(i, 0) for i in range(dims)]


def _second_moments(fit_list: DataFrame, dims: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Sums of products of the centred vectors, or of their projections, with a last row of plain sums."""
    width = dims if project is None else project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            y = _matrix(batch.column(0), dims) - mean
            y = y if project is None else y @ project
            total[:-1] += y.T @ y
            total[-1] += y.sum(axis=0)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((width + 1, width))
    got = fit_list.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()  # (dims + 1) x dims numbers
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["s"].to_numpy()
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S)^2 of each row; null where that is beyond 63 bits."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if 4 * largest * largest * len(sums) < 1 << 63:
        return pa.array(((x * n - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1), pa.int64())
    exact = [sum((v * n - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


ADDED = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}


def in_256ths(vector: Column) -> Column:
    """Entries as whole numbers of 256ths, rounded down; null for a vector that is null or empty, or holds a null, infinite,
    undefined or immense entry."""
    entry = lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(c.cast("double"))
    sound = F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def whiten(df: DataFrame, vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """Rows of `df` with a sound vector, once for each leading component, with the columns ADDED.

    Vectors are read in 256ths, rounded down (x). Means, covariance (centred, divisor n) and `n` are over the distinct x.
    `whitened` is the projection of x less its mean on the component, over the square root of its eigenvalue; `explained` is
    that eigenvalue's part of the trace; `identity_error` is the largest entry, but for sign, of the covariance of `whitened`
    over the distinct x, measured on them, less the identity; `deviation` is the sum of (n x - S)^2, exact, null where it is
    beyond 63 bits.

    Vectors that are null or empty, or hold null, infinite or undefined entries, or ones beyond 2^53, take no part. Repeated
    rows are all given, and counted once. Of equal eigenvalues any rotation may come out, the same for all rows. Components
    without variance are left out, so one distinct vector alone gives no rows, and neither does an empty table. Vectors of
    different lengths are whitened apart. Other columns are kept, those of ADDED must not be there yet. What the driver sees is
    the sums and products, d x d numbers for vectors of d.
    """
    if clash := set(ADDED) & set(df.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    own = next(c for c in (f"x{'_' * k}" for k in range(len(df.columns) + 1)) if c not in df.columns)
    sound = df.withColumn(own, in_256ths(F.col(vec_col))).where(F.col(own).isNotNull())
    distinct = cut_lineage(sound.select(own).distinct())
    lengths = sorted(r[0] for r in distinct.select(F.size(own)).distinct().collect())  # lengths of vectors, one as a rule
    schema = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in ADDED.items()]).schema
    parts = [_whitened(sound.where(F.size(own) == d), distinct.where(F.size(own) == d), own, d, components, schema) for d in lengths]
    out = df.sparkSession.createDataFrame([], schema)
    for k, part in enumerate(parts):
        out = part if k == 0 else out.unionByName(part)
    return out


def _whitened(rows: DataFrame, fit_list: DataFrame, own: str, dims: int, components: int, schema: object) -> DataFrame:
    n, sums = _totals(fit_list, dims)
    mean = np.array([float(Decimal(s) / n) for s in sums])
    moments = _second_moments(fit_list, dims, mean)[:-1] / n
    values, vectors = leading_components((moments + moments.T) / 2, components)
    project = vectors / np.sqrt(values)
    count = len(values)
    error = 0.0
    if count:
        again = _second_moments(fit_list, dims, mean, project) / n
        error = float(np.abs(again[:-1] - np.outer(again[-1], again[-1]) - np.eye(count)).max())
    explained = (values / np.trace(moments)).tolist() if count else []
    at = rows.columns.index(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at), dims)
            kept = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], [c for i, c in enumerate(batch.schema.names) if i != at])
            deviation, whitened = _deviations(x, n, sums), (x - mean) @ project
            for k in range(count):
                own_values = [pa.array(np.full(len(x), v), t) for v, t in ((k + 1, pa.int32()), (n, pa.int64()))]
                measured = [pa.array(np.full(len(x), v)) for v in (explained[k], error)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *own_values, deviation, pa.array(whitened[:, k]), *measured], [*kept.schema.names, *ADDED])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")
