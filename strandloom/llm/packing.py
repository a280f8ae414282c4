"""Filling fixed-capacity containers with items: least squares over length combinations.

Only the histogram of item lengths reaches the driver, which has at most `capacity` entries. The lengths are put on
a grid of GRID steps (rounded up), all combinations of up to DEPTH grid lengths that fill a container exactly are
enumerated, and non-negative least squares finds how often to repeat each so that the histogram is used up. The
counts are rounded to what there is and combinations are turned back to true lengths, the last one of each so that
the grid's rounding is made up for. Whatever is left is packed greedily, longest item first into the fullest
container that takes it, be it a new one or a gap in one of those.

The plan says how often which lengths share a container. Items of one length are interchangeable, so an item's
container follows from its length and its exact position among the items of that length, which are numbered
without gathering them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokenizer import TOKENIZER_DIR, count_tokens
from strandloom.operators.skew import number_rows
from strandloom.session import materialize, slices_of

GRID = 256
DEPTH = 3
#: Histograms are held by the driver: so many lengths at most.
LARGEST_CAPACITY = 1_000_000
_ORDINAL_BITS = 40
#: Targets whose number fits in a 63-bit key before a length and an ordinal.
TARGETS_AT_A_TIME = 8


@dataclass
class Pattern:
    """`repeat` containers that hold the same lengths: (length, how many of it)."""

    lengths: list[tuple[int, int]]
    repeat: int


def combinations(steps: int, depth: int, present: np.ndarray) -> np.ndarray:
    """All ascending rows of `depth` grid lengths that sum to `steps`, 0 standing for no item; only present lengths."""
    rows = [[(steps,)]] if present[steps] else [[]]
    lengths = [int(x) for x in np.flatnonzero(present) if x > 0]
    if depth >= 2:
        rows.append([(a, steps - a) for a in lengths if a <= steps - a and present[steps - a]])
    if depth >= 3:
        rows.append(
            [
                (a, b, steps - a - b)
                for a in lengths
                if 3 * a <= steps
                for b in lengths
                if a <= b <= steps - a - b and present[steps - a - b]
            ]
        )
    flat = [(0,) * (depth - len(r)) + r for part in rows for r in part]
    return np.array(flat, np.int64).reshape(len(flat), depth)


def nonnegative_least_squares(columns: np.ndarray, target: np.ndarray, steps: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, by active sets; A's column j counts the lengths in columns[j] (0: none)."""
    n = len(columns)
    x = np.zeros(n)
    if not n:
        return x
    dense = np.zeros((len(target), n))
    for k in range(columns.shape[1]):
        np.add.at(dense, (columns[:, k], np.arange(n)), 1.0)
    dense[0] = 0
    passive = np.zeros(n, bool)
    residual = target.astype(float)
    tolerance = 1e-9 * max(1.0, float(np.abs(dense.T @ residual).max()))
    for _ in range(steps or 3 * len(target)):
        gradient = dense.T @ residual
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        passive[best] = True
        while True:
            own = np.flatnonzero(passive)
            a = dense[:, own]
            gram = a.T @ a
            solved = np.linalg.solve(gram + 1e-9 * np.eye(len(own)), a.T @ target)
            if (solved > 0).all():
                break
            low = solved <= 0
            share = x[own][low] / np.maximum(x[own][low] - solved[low], 1e-300)
            x[own] += share.min() * (solved - x[own])
            drop = own[low & (x[own] <= 1e-9)]
            if not len(drop):
                drop = own[low][:1]
            x[drop] = 0
            passive[drop] = False
            if not passive.any():
                solved = np.zeros(0)
                own = np.flatnonzero(passive)
                break
        x[:] = 0
        x[own] = solved
        residual = target - dense[:, own] @ solved
    return x


def fill_greedily(left: dict[int, int], containers: list[Pattern], capacity: int) -> list[Pattern]:
    """Put the items that are left, longest first, into the fullest containers that take them, opening new ones."""
    by_free: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    frees: list[int] = []

    def put(free: int, lengths: list[tuple[int, int]], count: int) -> None:
        if count:
            if not by_free[free]:
                insort(frees, free)
            by_free[free].append((lengths, count))

    for p in containers:
        put(capacity - sum(a * k for a, k in p.lengths), p.lengths, p.repeat)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect_left(frees, length)
            if at < len(frees):
                free = frees[at]
                lengths, there = by_free[free].pop()
                if not by_free[free]:
                    frees.pop(at)
            else:
                free, lengths, there = capacity, [], count
            each = free // length
            used = min(there, count // each)
            if used:
                put(free - each * length, [*lengths, (length, each)], used)
                count -= used * each
            else:
                used = 1
                put(free - count * length, [*lengths, (length, count)], 1)
                count = 0
            if lengths:  # containers that were open before and got nothing stay open
                put(free, lengths, there - used)
    return [Pattern(lengths, count) for free in frees for lengths, count in by_free[free]]


class _Stock:
    """What is left of a histogram, with the lengths in order."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.count = {length: n for length, n in histogram.items() if n}
        self.lengths = sorted(self.count)

    def largest(self, low: int, high: int) -> int | None:
        """The largest length in stock from `low` up to `high`."""
        at = bisect_right(self.lengths, high) - 1
        return self.lengths[at] if at >= 0 and self.lengths[at] >= low else None

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.lengths.pop(bisect_left(self.lengths, length))


def _realise(grid_lengths: list[int], times: int, stock: _Stock, width: int, capacity: int) -> list[Pattern]:
    """Up to `times` containers of a combination in true lengths: the largest that each step of the grid has, the
    last one the largest that still fits. One pattern for each run of containers in which no length changes."""
    made = []
    while times > 0:
        chosen: list[int] = []
        free = capacity
        for nth, step in enumerate(grid_lengths):
            last = nth == len(grid_lengths) - 1
            length = stock.largest((step - 1) * width + 1, free if last else min(free, step * width))
            if length is None or (stock.count[length] <= chosen.count(length)):
                return made
            chosen.append(length)
            free -= length
        counted = Counter(chosen)
        run = min(times, *[stock.count[length] // k for length, k in counted.items()])
        for length, k in counted.items():
            stock.take(length, run * k)
        made.append(Pattern(sorted(counted.items()), run))
        times -= run
    return made


def plan(histogram: dict[int, int], capacity: int, grid: int = GRID, depth: int = DEPTH) -> list[Pattern]:
    """Patterns that together hold exactly the items of the histogram (length -> count, 1 <= length <= capacity)."""
    width = -(-capacity // min(grid, capacity))
    steps = capacity // width
    target = np.zeros(steps + 1)
    for length, n in histogram.items():
        target[min(-(-length // width), steps)] += n
    rows = combinations(steps, depth, target > 0)
    repeats = nonnegative_least_squares(rows, target)
    stock = _Stock(histogram)
    made: list[Pattern] = []
    for j in np.argsort(-repeats, kind="stable"):
        times = int(repeats[j] + 0.5)
        if not times:
            break
        made += _realise([int(b) for b in reversed(rows[j]) if b], times, stock, width, capacity)
    return fill_greedily(stock.count, made, capacity)


def _lookup(patterns: list[Pattern], key_base: int) -> np.ndarray:
    """Rows (length and first position, container, items of that length in a container, place in the container)."""
    used: dict[int, int] = defaultdict(int)
    rows, container = [], 0
    for p in patterns:
        place = 0
        for length, each in p.lengths:
            rows.append(((key_base + length) << _ORDINAL_BITS | used[length], container, each, place))
            used[length] += p.repeat * each
            place += length * each
        container += p.repeat
    return np.array(rows, np.int64).reshape(len(rows), 4)


def _place(batches: Iterator[pa.RecordBatch], lookup: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, ordinal, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ordinal", "length"))
        wanted = key << _ORDINAL_BITS | ordinal
        row = lookup[np.searchsorted(lookup[:, 0], wanted, side="right") - 1]
        nth = wanted - row[:, 0]
        container, place = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * length
        yield pa.RecordBatch.from_arrays(
            [batch.column("target_id"), pa.array(container), pa.array(place), batch.column("item"), batch.column("start"), batch.column("length")],
            names=["target_id", "container_id", "place", "item", "start", "length"],
        )


def pack(sizes: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(target_id, container_id, place, item, start, length): where the parts of every item lie, for every capacity.

    `sizes` has item (a unique long) and size; `capacities` are pairs (target_id, capacity), planned in groups of eight. `place` is the
    position within the container, `start` the position within the item. Only an item larger than the capacity is
    split, into parts of the capacity and a rest. An item whose id or size is null, or whose size is below 1, takes
    no place and has no row. Items that repeat must be made unique before. An empty table gives no rows.
    """
    if any(not 1 <= c <= LARGEST_CAPACITY for _, c in capacities):
        raise ValueError(f"capacities must be from 1 to {LARGEST_CAPACITY}")
    spark = sizes.sparkSession
    schema = "target_id int, container_id long, place long, item long, start long, length long"
    if not capacities:
        return spark.createDataFrame([], schema)
    if len(capacities) > TARGETS_AT_A_TIME:
        head, rest = capacities[:TARGETS_AT_A_TIME], capacities[TARGETS_AT_A_TIME:]
        return pack(sizes, head).unionByName(pack(sizes, rest))
    targets = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(t).cast("int").alias("target_id"), F.lit(c).cast("long").alias("capacity")) for i, (t, c) in enumerate(capacities)])
    sized = sizes.filter("item IS NOT NULL AND size > 0").select("item", F.col("size").cast("long").alias("size"))
    each = sized.select("item", "size", F.explode(targets).alias("t")).select("item", "size", "t.*")
    parts = each.select(
        "item", "size", "nth", "target_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("capacity")))).alias("part")
    )
    width = LARGEST_CAPACITY + 1
    pieces = parts.select(
        "target_id",
        "item",
        (F.col("part") * F.col("capacity")).alias("start"),
        F.least("capacity", F.col("size") - F.col("part") * F.col("capacity")).alias("length"),
        "nth",
    ).withColumn("key", F.col("nth").cast("long") * width + F.col("length"))
    counts = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).toArrow()
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for key, n in zip(counts["key"].to_pylist(), counts["n"].to_pylist(), strict=True):
        histograms[key // width][key % width] = n
    plans = [_lookup(plan(histograms[i], c), i * width) for i, (_, c) in enumerate(capacities)]
    lookup = np.concatenate(plans)
    shared = spark.sparkContext.broadcast(lookup[np.argsort(lookup[:, 0], kind="stable")])
    numbered = number_rows(pieces.drop("nth"), "key", ["item", "start"], slices_of(spark))
    return numbered.mapInArrow(lambda batches: _place(batches, shared.value), schema)


def pack_documents(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(target_id, container_id, container_start, doc_id, token_start, token_end): containers for every target.

    Sizes are token counts of the whole texts by the target's tokenizer. A null or empty text has no tokens and no
    row. A document that is delivered again is placed once; one with a null id is left out, as it could not be
    named. Targets with a null in any field are ignored.
    """
    rows = targets.select("target_id", "tokenizer", "capacity_tokens").dropna().distinct().collect()
    packed = None
    for tokenizer in sorted({r.tokenizer for r in rows}):
        counted = count_tokens(documents.filter("doc_id IS NOT NULL"), "doc_id", "text", tokenizer, folder)
        sizes = materialize(counted.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size")).dropDuplicates(["item"]))
        own = pack(sizes, sorted((r.target_id, r.capacity_tokens) for r in rows if r.tokenizer == tokenizer))
        packed = own if packed is None else packed.unionByName(own)
    if packed is None:
        packed = pack(documents.sparkSession.createDataFrame([], "item long, size long"), [])
    return packed.select(
        "target_id",
        "container_id",
        F.col("place").alias("container_start"),
        F.col("item").alias("doc_id"),
        F.col("start").alias("token_start"),
        (F.col("start") + F.col("length")).alias("token_end"),
    )


def fill_of(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, containers, tokens, fill): how full the containers of `pack_documents` are on the whole."""
    held = packed.groupBy("target_id").agg(
        (F.max("container_id") + 1).alias("containers"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens")
    )
    return held.join(targets.select("target_id", "capacity_tokens").distinct(), "target_id").select(
        "target_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )


def faults_of(packed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, containers_over, places_off, documents_off, needless_splits): how often the containers of
    `pack_documents` break a rule. `sizes` has doc_id and n_tokens of every document, each once.

    A container is over if it holds more than its capacity; a place is off if it does not begin where the one before it in the
    container ends, a document if its parts do not follow each other from 0 to its size. A split is needless if the document fits.
    """
    capacities = targets.select("target_id", "capacity_tokens").dropna().distinct()
    length = F.col("token_end") - F.col("token_start")
    one = packed.withColumn("length", length).join(capacities, "target_id")
    held = one.groupBy("target_id", "container_id").agg(
        F.sum("length").alias("held"), F.max(F.col("container_start") + F.col("length")).alias("end"), F.min("container_start").alias("begin"),
        F.count(F.lit(1)).alias("n"), F.countDistinct("container_start").alias("places"), F.first("capacity_tokens").alias("capacity_tokens"),
    )
    # disjoint and without space between: from 0 to an end that is the sum, at different places
    bad = held.groupBy("target_id").agg(
        F.sum((F.col("held") > F.col("capacity_tokens")).cast("long")).alias("containers_over"),
        F.sum(((F.col("begin") != 0) | (F.col("end") != F.col("held")) | (F.col("places") != F.col("n"))).cast("long")).alias("places_off"),
    )
    parts = one.groupBy("target_id", "doc_id").agg(
        F.sum("length").alias("length"), F.min("token_start").alias("first"), F.max("token_end").alias("last"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("token_start").alias("starts"), F.first("capacity_tokens").alias("capacity_tokens"),
    )
    wanted = sizes.filter("n_tokens > 0").withColumn("target_id", F.explode(capacities.agg(F.collect_set("target_id")).scalar()))
    both = wanted.join(parts, ["target_id", "doc_id"], "full")
    whole = (F.col("first") == 0) & (F.col("last") == F.col("n_tokens")) & (F.col("length") == F.col("n_tokens")) & (F.col("starts") == F.col("n"))
    documents = both.groupBy("target_id").agg(
        F.sum((~F.coalesce(whole, F.lit(False))).cast("long")).alias("documents_off"),
        F.sum(F.coalesce(((F.col("n") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).cast("long"), F.lit(0))).alias("needless_splits"),
    )
    return bad.join(documents, "target_id").select("target_id", "containers_over", "places_off", "documents_off", "needless_splits")
