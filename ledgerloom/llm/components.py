"""Connected components of a table of links: tasks join what they hold, star rounds join tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, join_counted, shuffle_parts

#: Links that a task joins at once.
AT_ONCE = 1 << 20
#: Links that make a task of its own worth while: fewer in each of many tasks are gathered before they go through rounds.
GATHER = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a[i], b[i]) as (smallest node, node) for every other node that they connect to it."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if (low == high).all():
            break
        np.minimum.at(up, high, low)  # a root goes below the smallest root that it is linked to
        while (further := up[up]).tobytes() != up.tobytes():
            up = further
    leaf = up != np.arange(len(nodes))
    return nodes[up[leaf]], nodes[leaf]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as stars, AT_ONCE of them at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done() -> pa.RecordBatch:
        low, leaf = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(leaf)], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= AT_ONCE:
            yield done()
            held = []
    if held:
        yield done()


def _each(edges: DataFrame, *rows: list[Column]) -> DataFrame:
    """Several rows (a, b) of each row, in the partition that holds it: a union would double the tasks of every stage."""
    pairs = [F.struct(x.cast("long").alias("a"), y.cast("long").alias("b")) for x, y in rows]
    return edges.select(F.explode(F.array(*pairs)).alias("_e")).select("_e.a", "_e.b")


def _hubs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links both ways, and for each node `a` its smallest and largest neighbour and the number of its links."""
    both = _each(edges, [F.col("a"), F.col("b")], [F.col("b"), F.col("a")])
    return both, both.groupBy("a").agg(F.min("b").alias("first"), F.max("b").alias("last"), F.count("*").alias("n"))


def _round(edges: DataFrame, links: int | None = None) -> DataFrame:
    """Large star, then small star: larger neighbours go to the smallest neighbour, then smaller ones do. The hub of a star
    is a hot key: its links are dealt by a broadcast. links: their number, where it is known."""
    a, b = F.col("a"), F.col("b")
    both, hubs = _hubs(edges)
    low = hubs.select("a", F.least("first", "a").alias("low"), "n")
    large = join_counted(both, low, ["a"], "n", None if links is None else 2 * links)
    large = large.where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
    near = large.withColumn("low", F.min("a").over(Window.partitionBy("b")))
    return _each(near, [F.col("low"), a], [F.col("low"), b]).where("a <> b").distinct()


def _open(edges: DataFrame) -> tuple[int, bool]:
    """The number of links (a < b), and whether any node is neither the smallest of its star nor linked to just that one."""
    loose = (F.col("first") < F.col("a")) & (F.col("first") < F.col("last"))
    n, left = _hubs(edges)[1].agg(F.sum("n"), F.max(loose)).first()
    return (n or 0) // 2, bool(left)


def components(links: DataFrame, as_stars: bool = False) -> DataFrame:
    """links: (a long, b long), null-free. Returns (node, component) for every node but the smallest of its component;
    component is the smallest node that can be reached. Links of a node to itself, in both directions or repeated change
    nothing; without links there are no rows.

    Tasks join the links that they hold, up to AT_ONCE at a time. Many partitions of few links are gathered, a task for
    every GATHER links, and joined again, so only what is spread over such tasks is left to rounds of a few shuffles; their
    number grows with the logarithm of the longest chain at most. Each pass is written to the checkpoint folder, so a
    lost executor costs one pass at most. as_stars: tasks have joined these links already.
    """
    edges = cut_lineage(links.select("a", "b") if as_stars else links.select("a", "b").mapInArrow(joined, "a long, b long"))
    gathered = False
    while (state := _open(edges))[1]:
        tasks = -(-state[0] // GATHER)
        gathered = not gathered and tasks < shuffle_parts(edges.sparkSession)
        edges = cut_lineage((edges.coalesce(tasks) if gathered else _round(edges, state[0])).mapInArrow(joined, "a long, b long"))
        if gathered and tasks == 1:
            break
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
