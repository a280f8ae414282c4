"""The N best items of every group, by a mergeable aggregation that keeps a size-N bounded heap per group.

Map side: every task keeps one heap of at most N items per group and hands them on, so a group of any size leaves
a task as N rows at most. Reduce side: rows come sorted by group and one heap at a time is merged. The better item
is the one with the higher score, then the smaller tie columns in their order, the last of which is the item's id;
as this order is total, the result is the same in every run.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items that a map task holds before it hands its heaps on and begins anew; bounds its memory.
HELD_ITEMS = 200_000
#: What a null tie value stands for in a heap: less than the complement of any 64-bit integer.
NULL = -(2**63) - 1


class BoundedHeap:
    """At most `size` distinct items, the worst at the root. An item is a tuple that compares larger if better."""

    __slots__ = ("size", "items")

    def __init__(self, size: int) -> None:
        self.size, self.items = size, []

    def push(self, item: tuple) -> None:
        items = self.items
        if len(items) == self.size and item <= items[0]:
            return
        if item in items:  # a copy of a record that is held already
            return
        if len(items) < self.size:
            heapq.heappush(items, item)
        else:
            heapq.heapreplace(items, item)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Group, score, and for each tie column whether it is null and its value."""
    group, score, *ties = batch.columns
    keys = []
    for tie in ties:
        keys += [tie.is_null().to_numpy(zero_copy_only=False), tie.fill_null(0).to_numpy(zero_copy_only=False)]
    return group.to_numpy(zero_copy_only=False), score.to_numpy(zero_copy_only=False), keys


def _items(score: np.ndarray, keys: list[np.ndarray]) -> Iterator[tuple]:
    """Rows as items for a heap. The complement turns the order of all 64-bit integers around without overflow."""
    ties = []
    for null, value in zip(keys[::2], keys[1::2]):
        turned = (~value).tolist()
        for at in np.flatnonzero(null):
            turned[at] = NULL
        ties.append(turned)
    return zip(score.tolist(), *ties, strict=True)


def _best_of_batch(group: np.ndarray, score: np.ndarray, ties: list[np.ndarray], n: int) -> np.ndarray:
    """Row numbers of the first n distinct items of each group of the batch, so that few rows reach the heaps."""
    order = np.lexsort([*reversed(ties), -score, group])
    g, s, t = group[order], score[order], [x[order] for x in ties]
    new_group = np.r_[True, g[1:] != g[:-1]]
    changed = new_group | np.r_[True, s[1:] != s[:-1]]
    for x in t:
        changed |= np.r_[True, x[1:] != x[:-1]]
    seen = np.cumsum(changed)
    rank = seen - np.maximum.accumulate(np.where(new_group, seen, 0))
    return order[changed & (rank < n)]


def _emit(heaps: list[tuple[int, BoundedHeap]], names: list[str], score_type: pa.DataType) -> pa.RecordBatch:
    rows = [(g, i) for g, h in heaps for i in sorted(h.items, reverse=True)]
    columns = [pa.array([g for g, _ in rows], pa.int64()), pa.array([i[0] for _, i in rows], score_type)]
    for k in range(1, len(names) - 1):
        columns.append(pa.array([None if i[k] == NULL else ~i[k] for _, i in rows], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _partial(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    heaps: dict[int, BoundedHeap] = {}
    held, names = 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        group, score, ties = _columns(batch)
        best = _best_of_batch(group, score, ties, n)
        for g, item in zip(group[best].tolist(), _items(score[best], [t[best] for t in ties]), strict=True):
            heap = heaps.get(g)
            if heap is None:
                heap = heaps[g] = BoundedHeap(n)
            held -= len(heap.items)
            heap.push(item)
            held += len(heap.items)
        if held > HELD_ITEMS:
            yield _emit(list(heaps.items()), names, batch.schema.field(1).type)
            heaps, held = {}, 0
    if heaps:
        yield _emit(list(heaps.items()), names, pa.float64())


def _merge(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """`batches` hold whole groups in order; a group may reach over batches."""
    current, heap, names = None, BoundedHeap(n), []
    for batch in batches:
        if not batch.num_rows:
            continue
        names, done = batch.schema.names, []
        group, score, ties = _columns(batch)
        for g, item in zip(group.tolist(), _items(score, ties), strict=True):
            if g != current:
                if heap.items:
                    done.append((current, heap))
                current, heap = g, BoundedHeap(n)
            heap.push(item)
        if done:
            yield _emit(done, names, pa.float64())
    if heap.items:
        yield _emit([(current, heap)], names, pa.float64())


def top_n(df: DataFrame, group: str, score: str, ties: list[str], n: int) -> DataFrame:
    """(group, score, *ties): the n best distinct items of every group, all of them if there are fewer.

    The order is: higher score, then smaller ties from the first to the last; give the item's unique id as the last.
    Rows that agree in group, score and all ties are copies of one item and count once. Rows whose group is null,
    or whose score is null or NaN, do not take part. A null tie value comes behind all others. An empty table gives
    no rows. Groups and ties are integers, scores doubles; all other columns are ignored. n below 1 is refused.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = ["group", "score", *[f"tie_{k}" for k in range(len(ties))]]
    rows = df.select(
        F.col(group).cast("long").alias("group"),
        (F.col(score).cast("double") + F.lit(0.0)).alias("score"),  # -0.0 and 0.0 are one score
        *[F.col(t).cast("long").alias(k) for t, k in zip(ties, names[2:], strict=True)],
    ).filter("group IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    schema = T.StructType([T.StructField(k, T.DoubleType() if k == "score" else T.LongType()) for k in names])
    heaps = rows.mapInArrow(lambda batches: _partial(batches, n), schema)
    merged = heaps.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: _merge(batches, n), schema)
    return merged.select(
        *[F.col(k).cast(df.schema[c].dataType).alias(c) for k, c in zip(names, [group, score, *ties], strict=True)]
    )
