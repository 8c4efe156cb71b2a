"""Concurrent payment streams, walked day by day with bounded state.

The payments of the groups in question are sorted by group and falling date over ranges of rows, whatever the size of a group.
A task streams its range and keeps the last amount of each stream and the rows of one day. A range that begins inside a group
waits for the amounts with which the range before it ended; such ranges are walked in further rounds, those of different groups
side by side. Every round is written, so a lost executor costs no earlier one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from ledgerloom.functions.money import CENTS
from ledgerloom.lineage import written
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Payments of a range, about.
RANGE_ROWS = 500_000
#: Up to so many pairs of a stream and a payment of one day are simply compared.
FEW = 36


def _nearest(anchors: list[int], todo: list[tuple[int, int]], moving: bool) -> Iterator[tuple[int, int]]:
    """(stream, payment) by falling nearness of a stream's last amount to a payment's, ties to the lower stream, then to the
    earlier payment; todo: (payment, amount) in order. A stream gets one payment, or follows it and takes more (moving).

    Streams and payments stand at their amounts on a line. The nearest of both are always neighbours, so only neighbours are
    offered, again whenever what stands first at an amount changes."""
    line = sorted({*anchors, *(a for _, a in todo)})
    at = {a: i for i, a in enumerate(line)}
    streams: list[list[int]] = [[] for _ in line]
    payments: list[list[int]] = [[] for _ in line]
    for s, a in enumerate(anchors):
        streams[at[a]].append(s)
    for p, a in reversed(todo):
        payments[at[a]].append(p)
    left, right = list(range(-1, len(line) - 1)), list(range(1, len(line) + 1))
    offers: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if 0 <= i < len(line) and 0 <= j < len(line) and streams[i] and payments[j]:
            heappush(offers, (abs(line[i] - line[j]), streams[i][0], payments[j][-1], i, j))

    def anew(i: int) -> None:
        if streams[i] or payments[i]:
            offer(i, i)
            for k in (left[i], right[i]):
                offer(i, k)
                offer(k, i)
            return
        a, b = left[i], right[i]  # nothing stands here any more
        if a >= 0:
            right[a] = b
        if b < len(line):
            left[b] = a
        offer(a, b)
        offer(b, a)

    for i in range(len(line)):
        offer(i, i)
        offer(i, right[i])
        offer(right[i], i)
    while offers:
        _, s, p, i, j = heappop(offers)
        if not (streams[i] and streams[i][0] == s and payments[j] and payments[j][-1] == p):
            continue
        heappop(streams[i])
        payments[j].pop()
        if moving:
            heappush(streams[j], s)
        yield s, p
        anew(j)
        if i != j:
            anew(i)


def assign_day(anchors: list[int], amounts: list[int]) -> list[int]:
    """The stream, from 0, of each payment of a day, in the day's order: the nearest of a stream's last amount and a payment come
    together first, among streams that have none on that day; when each has one, the rest go to the nearest of all. `anchors`
    follow their payments. n log n for a day of n payments."""
    out = [-1] * len(amounts)
    if len(anchors) * len(amounts) <= FEW:
        free, left = list(range(len(anchors))), list(range(len(amounts)))
        while left:
            gap = None
            for s in free or range(len(anchors)):
                last = anchors[s]
                for p in left:
                    if gap is None or abs(amounts[p] - last) < gap:
                        gap, stream, payment = abs(amounts[p] - last), s, p
            out[payment], anchors[stream] = stream, amounts[payment]
            left.remove(payment)
            if free:
                free.remove(stream)
        return out
    for moving in (False, True):
        todo = [(p, a) for p, a in enumerate(amounts) if out[p] < 0]
        if not todo:
            break
        for s, p in _nearest(list(anchors), todo, moving):
            out[p] = s
            anchors[s] = amounts[p]
    return out


#: Columns that a walk needs before the payment's own: place of the range, group, 0 for the row that brings the first amounts and 1
#: for a payment, those amounts (as text) and the payment's, in cents.
_PART, _GROUP, _KIND, _START, _CENTS = (f"_walk_{c}" for c in ("part", "group", "kind", "start", "cents"))
_BORDER = "_walk_border"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order come in, payments with their stream and one border row for each range come out."""
    part = group = anchors = None
    border: dict = {}
    held: pa.RecordBatch | None = None

    def numbers(batch: pa.RecordBatch, at: int) -> np.ndarray:
        return batch.column(at).to_numpy(zero_copy_only=False)

    def shown(batch: pa.RecordBatch, mask: np.ndarray, streams: np.ndarray) -> pa.RecordBatch:
        own = batch.filter(pa.array(mask))
        extra = [pa.array(streams[mask], pa.int32()), pa.nulls(own.num_rows, pa.string())]
        return pa.RecordBatch.from_arrays([*own.columns[5:], *extra], [*own.schema.names[5:], "stream", _BORDER])

    def ended(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = json.dumps({**border, "last": group, "anchors": anchors})
        empty = [pa.nulls(1, c.type) for c in batch.columns[5:]]
        return pa.RecordBatch.from_arrays([*empty, pa.nulls(1, pa.int32()), pa.array([text])], [*batch.schema.names[5:], "stream", _BORDER])

    def walked(batch: pa.RecordBatch, last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
        nonlocal part, group, anchors, border
        parts, kinds = numbers(batch, 0), numbers(batch, 2)
        names = batch.column(1).dictionary_encode()
        codes, days = names.indices.to_numpy(), batch.column(batch.schema.get_field_index("date")).cast(pa.int32()).fill_null(-(1 << 31)).to_numpy()
        cents = batch.column(4).fill_null(0).to_numpy()
        changes = [True] + [bool(x) for x in (np.diff(parts) != 0) | (np.diff(codes) != 0) | (np.diff(kinds) != 0) | (np.diff(days) != 0)]
        begins = np.flatnonzero(changes).tolist()
        ends = [*begins[1:], batch.num_rows]
        done = 0 if last else begins.pop()  # the last day may go on
        out, borders, found = [], [], [-1] * batch.num_rows
        parts, kinds, codes, cents, known = parts.tolist(), kinds.tolist(), codes.tolist(), cents.tolist(), names.dictionary.to_pylist()
        for a, b in zip(begins, ends):  # noqa: B905
            name = known[codes[a]]
            if name != group or parts[a] != part:
                if parts[a] != part:
                    if part is not None:
                        borders.append(ended(batch))
                    part = parts[a]
                    border = {"part": part, "first": name, "begun": kinds[a] == 0}
                group, anchors = name, None
            if kinds[a] == 0:
                anchors = [int(x) for x in batch.column(3)[a].as_py().split(",")]
            elif anchors is not None:
                found[a:b] = assign_day(anchors, cents[a:b])
        streams = np.array(found, dtype=np.int32) + 1
        whole = batch if last else batch.slice(0, done)
        if whole.num_rows:
            out.append(shown(whole, streams[: whole.num_rows] > 0, streams[: whole.num_rows]))
        if last and part is not None:
            borders.append(ended(batch))
        return [*out, *borders], None if last else batch.slice(done)

    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if batch.num_rows:
            out, held = walked(batch, False)
            yield from out
    if held is not None:
        yield from walked(held, True)[0]


def _round(rows: DataFrame, schema: StructType) -> tuple[DataFrame, list[dict]]:
    """Walk all ranges of `rows`: payments whose stream is known, and where each range ended."""
    order = [_PART, _GROUP, _KIND, F.col("date").desc_nulls_last(), "seq", "id", _CENTS]
    out = written(rows.repartition(_PART).sortWithinPartitions(*order).mapInArrow(_walk, schema))
    borders = [json.loads(r[0]) for r in out.where(F.col(_BORDER).isNotNull()).select(_BORDER).collect()]  # one for each range
    return out.where(F.col(_BORDER).isNull()).drop(_BORDER), borders


def walk_streams(payments: DataFrame, starts: DataFrame, group: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """`payments` with their `stream`. starts: the columns of `group` and `anchors`, in rising order, the amounts that the streams
    of a group begin with: each group of payments has one row there. Amounts count in cents, null as nothing; payments of a day
    are taken by seq, id and amount. Days are taken from the last to the first."""
    name = F.to_json(F.struct(*group))
    cents: Callable[[Column], Column] = lambda c: (c.cast(CENTS) * 100).cast("long")
    own = payments.select(F.lit(0).alias(_PART), name.alias(_GROUP), F.lit(1).alias(_KIND), F.lit(None).cast("string").alias(_START),
                          F.coalesce(cents(F.col("amount")), F.lit(0)).alias(_CENTS), *payments.columns)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in payments.schema.fields]
    heads = starts.select(F.lit(0).alias(_PART), name.alias(_GROUP), F.lit(0).alias(_KIND), F.array_join(F.transform("anchors", cents), ",").alias(_START), F.lit(None).cast("long").alias(_CENTS), *empty)
    rows = written(own.unionByName(heads))
    parts = max(1, -(-rows.count() // range_rows))
    if parts > 1:
        ranged = rows.repartitionByRange(parts, _GROUP, _KIND, F.col("date").desc_nulls_last())
        rows = written(ranged.withColumn(_PART, F.spark_partition_id()))
    fields = [StructField(f.name, f.dataType, True) for f in payments.schema.fields]
    schema = StructType([*fields, StructField("stream", IntegerType()), StructField(_BORDER, StringType())])
    out, borders = _round(rows, schema)
    ends = {b["part"]: b for b in borders}
    order = sorted(ends)
    before = {k: order[i - 1] for i, k in enumerate(order) if i}
    waiting = {k for k in order if not ends[k]["begun"]}
    # a range that lies within one group ends as it began until it is walked
    known = {k: ends[k]["anchors"] for k in order if k not in waiting or ends[k]["first"] != ends[k]["last"]}
    while waiting:
        ready = sorted(k for k in waiting if before[k] in known)
        heads = payments.sparkSession.createDataFrame([(k, ends[k]["first"], ",".join(map(str, known[before[k]]))) for k in ready], f"{_PART} int, {_GROUP} string, {_START} string")
        heads = heads.select(_PART, _GROUP, F.lit(0).alias(_KIND), _START, F.lit(None).cast("long").alias(_CENTS), *empty)
        mine = rows.where(F.col(_PART).isin(ready)).join(F.broadcast(heads.select(_PART, _GROUP)), [_PART, _GROUP], "left_semi").select(*rows.columns)
        more, borders = _round(mine.unionByName(heads), schema)
        out = out.unionByName(more)
        for b in borders:
            if ends[b["part"]]["first"] == ends[b["part"]]["last"]:
                known[b["part"]] = b["anchors"]
        waiting -= set(ready)
    return out
