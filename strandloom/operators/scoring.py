"""Scoring of candidate regions: the best window by bottom-s MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.dna import minimizers_of_all
from strandloom.functions.mash import mash_distance, upper_identity_column
from strandloom.operators.sketch import chunks_of
from strandloom.session import materialize

#: Cells of the window-by-key table that is held at a time for a large region; windows that are scored side by side else.
CELLS, SIDE_BY_SIDE = 1_000_000, 30_000
HALF = 2**31
#: Regions that are scored together; bounds what a worker holds.
REGIONS_AT_A_TIME = 2000
#: Regions with more minimizers than this are scored one by one, the others many at a time.
LARGE = 4096


def best_window(
    query: np.ndarray, positions: np.ndarray, keys: np.ndarray, start: int, end: int, width: int
) -> tuple[int, int, int, int] | None:
    """(shared, first, last, reference keys) of the best window of one region; None if nothing is shared.

    `positions` ascend. A window begins at each position in [start, end] and holds the minimizers less than `width`
    beyond it. Of the distinct union of query and window keys only the len(query) smallest count: shared is how many
    of them are in both. `first` and `last` are the first and the last window with the most; the last one's
    distinct keys are counted.
    """
    size = len(query)
    begins = int(np.searchsorted(positions, start)), int(np.searchsorted(positions, end, side="right"))
    if not size or begins[0] >= begins[1]:
        return None
    union, code = np.unique(np.concatenate([query, keys]), return_inverse=True)
    code = code[size:]
    wanted = np.zeros(len(union), bool)
    wanted[np.searchsorted(union, query)] = True
    stops = np.searchsorted(positions, positions + width)
    best = None
    step = max(1, CELLS // len(union))
    for low in range(begins[0], begins[1], step):
        high = min(low + step, begins[1])
        first, last = low, int(stops[high - 1])
        members = np.arange(first, max(last, first))
        # the windows low..high-1 that member j belongs to: from the first that reaches it to the one it begins
        enter = np.maximum(np.searchsorted(stops[low:high], members, side="right"), 0)
        leave = np.minimum(members - low + 1, high - low)
        inside = enter < leave
        change = np.zeros((high - low + 1, len(union)), np.int32)
        np.add.at(change, (enter[inside], code[members[inside]]), 1)
        np.add.at(change, (leave[inside], code[members[inside]]), -1)
        there = np.cumsum(change[:-1], axis=0) > 0
        rank = np.cumsum(there | wanted, axis=1)
        shared = (there & wanted & (rank <= size)).sum(axis=1)
        top = int(shared.max())
        if top and (best is None or top >= best[0]):
            at = np.flatnonzero(shared == top)
            begin = int(positions[low + at[0]]) if best is None or top > best[0] else best[1]
            best = top, begin, int(positions[low + at[-1]]), int(there[at[-1]].sum())
    return best


def best_windows(
    owner: np.ndarray, query: np.ndarray, member: np.ndarray, positions: np.ndarray, keys: np.ndarray,
    start: np.ndarray, end: np.ndarray, width: np.ndarray,
) -> np.ndarray:
    """`best_window` of many regions: a row (region, shared, first, last, reference keys) for each that shares a key.

    owner[i] is the region of query[i], ascending in both; member[j] that of the minimizer (positions[j], keys[j]),
    ascending in member and position. Regions are put side by side in tables of equal shape.
    """
    n = len(start)
    size = np.bincount(owner, minlength=n)
    counts = np.bincount(member, minlength=n)
    first_query, first_member = np.cumsum(size) - size, np.cumsum(counts) - counts
    begins = (positions >= start[member]) & (positions <= end[member])
    windows = np.bincount(member[begins], minlength=n)
    rows = []
    usable = (size > 0) & (windows > 0)
    for region in np.flatnonzero(usable & (counts > LARGE)):
        own = slice(first_member[region], first_member[region] + counts[region])
        wanted = query[first_query[region] : first_query[region] + size[region]]
        best = best_window(wanted, positions[own], keys[own], start[region], end[region], width[region])
        if best is not None:
            rows.append(np.array([[region, *best]], np.int64))
    # by key within a region, and what is known of a key there: whether the query has it, how many of its keys come up to it
    order = np.lexsort((keys, member))
    sorted_query = owner << 33 | query
    wanted = member[order] << 33 | keys[order]
    at = np.searchsorted(sorted_query, wanted, side="right")
    shared_key = (at > 0) & (sorted_query[np.maximum(at - 1, 0)] == wanted) if len(sorted_query) else np.zeros(len(at), bool)
    rank = at - first_query[member[order]]
    repeated = np.r_[False, wanted[1:] == wanted[:-1]] if len(wanted) else np.zeros(0, bool)
    # windows by the places, among a region's members, of their first one and of the one behind their last
    begin_first = np.cumsum(windows) - windows
    begin_at = np.flatnonzero(begins)
    owner_of = member[begin_at]
    far = np.searchsorted(member << 40 | positions, owner_of << 40 | (positions[begin_at] + width[owner_of]))
    opening, closing = (begin_at - first_member[owner_of]).astype(np.int16, copy=False), (far - first_member[owner_of]).astype(np.int16, copy=False)
    place_of = (order - first_member[member]).astype(np.int16)
    shape = np.where(counts <= 64, np.maximum(8, -(-counts // 8) * 8), -(-counts // 32) * 32)
    for columns in np.unique(shape[usable & (counts <= LARGE)]):
        group = np.flatnonzero(usable & (counts <= LARGE) & (shape == columns))
        group = group[np.argsort(windows[group], kind="stable")]
        at = 0
        while at < len(group):
            step = max(1, SIDE_BY_SIDE // int(windows[group[at]]))
            part = group[at : at + step]
            at += step
            cell = np.arange(columns)
            there = (cell < counts[part, None]).T
            row = np.where(there, first_member[part] + cell[:, None], 0)
            place = np.where(there, place_of[row], -1).astype(np.int16)
            is_shared, again = there & shared_key[row], there & repeated[row]
            room = (size[part] - rank[row]).astype(np.int16)  # keys of the window alone that may come before
            used = int(windows[part].max())
            valid = np.arange(used) < windows[part, None]
            nth = np.where(valid, begin_first[part, None] + np.arange(used), 0)
            opens, closes = opening[nth], np.where(valid, closing[nth], 0).astype(np.int16)
            own = np.zeros((len(part), used), np.int16)  # keys of the window alone, up to this one
            shared, present = own.copy(), own.copy()
            seen = np.zeros(own.shape, bool)
            for c in cell:  # key by key, smallest first, in all windows of all regions
                here = place[c, :, None]
                inside = (here >= opens) & (here < closes)
                fresh = inside
                if again[c].any():  # a key that is there twice counts once
                    seen &= again[c, :, None]
                    fresh = inside & ~seen
                    seen |= inside
                else:
                    seen = inside
                present += fresh
                both = is_shared[c, :, None]
                shared += fresh & both & (own <= room[c, :, None])
                own += fresh & ~both
            shared = np.where(valid, shared, -1)
            top = shared.max(axis=1)
            best = shared == top[:, None]
            one, last = best.argmax(axis=1), used - 1 - best[:, ::-1].argmax(axis=1)
            each = np.arange(len(part))
            first_start, last_start = (positions[begin_at[nth[each, x]]] for x in (one, last))
            found = np.stack([part, top, first_start, last_start, present[each, last]], axis=1).astype(np.int64)
            rows.append(found[top > 0])
    return np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], k: int, w: int, bits: int, gathered: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, REGIONS_AT_A_TIME):
            yield _score_batch(batch.slice(at, REGIONS_AT_A_TIME), k, w, bits, gathered)


def _score_batch(batch: pa.RecordBatch, k: int, w: int, bits: int, gathered: bool) -> pa.RecordBatch:
    """`gathered` blocks count without the letters that they share with the next one."""
    start, end, length = (_numbers(batch.column(c)) for c in ("region_start", "region_end", "length"))
    regions = np.arange(batch.num_rows)
    sketches, blocks = batch.column("minimizers"), batch.column("blocks")
    size = _numbers(sketches.value_lengths())
    owner, query = np.repeat(regions, size), _numbers(sketches.flatten()) + HALF
    parts = blocks.flatten()
    of_part = np.repeat(regions, _numbers(blocks.value_lengths()))
    places, keys = parts.field("at"), parts.field("keys")
    lengths = _numbers(places.value_lengths())
    places = places.flatten().to_numpy(zero_copy_only=False)
    # what is out of a region's reach is left before numbers are widened to 64 bits
    low, high = (np.repeat(x[of_part] - (_numbers(parts.field("block")) << bits), lengths) for x in (start, end + length))
    reach = np.flatnonzero((places >= low) & (places < high) & (places < (2**bits if gathered else HALF)))
    member = np.repeat(np.arange(len(lengths)), lengths)[reach]
    base = (_numbers(parts.field("block")) << bits)[member]
    member, places = of_part[member], places[reach] + base
    keys = keys.flatten().to_numpy(zero_copy_only=False)[reach].astype(np.int64) + HALF
    order = np.lexsort((places, member))
    width = np.maximum(0, length - (w - 1) - (k - 1))
    found = best_windows(owner, query, member[order], places[order], keys[order], start, end, width)
    kept = [batch.column(c).take(pa.array(found[:, 0])) for c in _KEPT]
    own = [pa.array(size[found[:, 0]]), *[pa.array(found[:, c]) for c in range(1, 5)]]
    return pa.RecordBatch.from_arrays([*kept, *own], names=[*_KEPT, *_FOUND])


_KEPT = ["query_id", "fragment_id", "file_id", "contig_id", "region_start", "region_end", "length"]
_FOUND = ["sketch", "shared", "first_start", "last_start", "reference_keys"]


def block_bits(fragment_length: int) -> int:
    """Blocks are as long as the usual region reaches, which is up to two fragments."""
    return max(7, (fragment_length - 1).bit_length() + 1)


def _in_blocks(batches: Iterator[pa.RecordBatch], k: int, w: int, seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks_of(batch, "seq"):
            owner, position, key = minimizers_of_all(texts, k, w, seed)
            order = np.lexsort((position, owner))
            owner, position, key = owner[order], position[order], key[order]
            block = position >> bits
            here = np.unique(np.r_[owner << 32 | block, (owner << 32 | block - 1)[block > 0]])
            owner_of, block_of = here >> 32, here & 2**32 - 1
            place = owner << 40 | position
            low, high = (np.searchsorted(place, owner_of << 40 | block_of + n << bits) for n in (0, 2))
            count = high - low
            taken = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at = (position[taken] - np.repeat(block_of << bits, count)).astype(np.int32)
            keys = (key[taken] - HALF).astype(np.int32)
            offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
            kept = [c.take(pa.array(owner_of)) for c in part.columns[:-1]]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at, keys)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(block_of), *lists], names=[*part.schema.names[:-1], "block", "at", "keys"])


def reference_blocks(segments: DataFrame, keys: list[str], k: int, w: int, seed: int, fragment_length: int) -> DataFrame:
    """(*keys, block, at, keys): the minimizers of every sequence in `seq`, a row for every 2**block_bits letters with
    those of the next as many letters as well, so that a region needs one row only unless it is longer than these.

    They come in blocks from where the sequence is read. To take 32 bits each, `at` counts from the block's start and
    `keys` are less by half their range. A block without minimizers in reach has no row.
    """
    bits = block_bits(fragment_length)
    rows = segments.select(*keys, "seq")
    own = T.StructType.fromDDL("block long, at array<int>, keys array<int>")
    schema = T.StructType([*rows.schema.fields[:-1], *own.fields])
    return rows.mapInArrow(lambda batches: _in_blocks(batches, k, w, seed, bits), schema)


def index_of_blocks(blocks: DataFrame, fragment_length: int) -> DataFrame:
    """(shard, file_id, contig_id, key, pos): the minimizers of `reference_blocks`, each once."""
    bits = block_bits(fragment_length)
    pairs = blocks.select("shard", "file_id", "contig_id", "block", F.explode(F.arrays_zip("at", "keys")).alias("m")).filter(F.col("m.at") < 2**bits)
    return pairs.select(
        "shard",
        "file_id",
        "contig_id",
        (F.col("m.keys").cast("long") + F.lit(HALF)).alias("key"),
        (F.shiftleft("block", bits) + F.col("m.at")).alias("pos"),
    )


_REGION = ["query_id", "fragment_id", "file_id", "contig_id", "region_start", "region_end"]


def window_scores(regions: DataFrame, fragments: DataFrame, blocks: DataFrame, k: int, w: int, fragment_length: int) -> DataFrame:
    """The best window of every region: its columns, length, sketch, shared, first_start, last_start, reference_keys.

    Regions that share nothing have no row. `fragments` has query_id, fragment_id, length (`fragment_length` at most),
    minimizers; `blocks` are `reference_blocks` of the same fragment length. The regions are written once.

    A region is shuffled with its sketch to the one block that holds all it needs, and is scored there; blocks are
    not copied by any shuffle. Only a region that is longer than a block, as repeats side by side make them, gathers several.
    """
    bits = block_bits(fragment_length)
    regions = materialize(regions.select(*_REGION))
    sketches = fragments.select(
        "query_id", "fragment_id", F.col("length").cast("long").alias("length"), F.transform("minimizers", lambda x: (x - F.lit(HALF)).cast("int")).alias("minimizers")
    )
    fitting = F.col("region_end") - F.col("region_start") + F.lit(fragment_length) <= 2**bits
    one = F.struct("block", "at", "keys")
    places = blocks.select("contig_id", "block", "at", "keys")
    first = F.shiftright("region_start", bits).alias("block")
    short = regions.filter(fitting).join(sketches, ["query_id", "fragment_id"]).select(*_REGION, "length", "minimizers", first)
    scored = _score(short.join(places, ["contig_id", "block"]).withColumn("blocks", F.array(one)), k, w, bits, False)
    long = regions.filter(~fitting)
    if long.isEmpty():
        return scored
    lengths = sketches.select("query_id", "fragment_id", "length")
    every = F.sequence(F.shiftright("region_start", bits), F.shiftright(F.col("region_end") + F.col("length") - 1, bits))
    touched = long.join(lengths, ["query_id", "fragment_id"]).withColumn("block", F.explode(every))
    gathered = touched.join(places, ["contig_id", "block"]).groupBy(*_REGION, "length").agg(F.collect_list(one).alias("blocks"))
    whole = gathered.join(sketches.drop("length"), ["query_id", "fragment_id"])
    return scored.unionByName(_score(whole, k, w, bits, True))


def _score(rows: DataFrame, k: int, w: int, bits: int, gathered: bool) -> DataFrame:
    kinds = {"query_id": "int", "file_id": "int"}
    schema = ", ".join([*(f"{c} {kinds.get(c, 'long')}" for c in _KEPT), *(f"{c} long" for c in _FOUND)])
    typed = rows.select(*[F.col(c).cast(kinds.get(c, "long")).alias(c) for c in _KEPT], "minimizers", "blocks")
    return typed.mapInArrow(lambda batches: _scored(batches, k, w, bits, gathered), schema)


def mappings_of(scores: DataFrame, k: int, threshold: float, confidence: float) -> DataFrame:
    """Scored regions as mappings, without those that even at the upper end of their identity miss the threshold.

    reference_start is the middle of the first and the last best window; union_minimizers is the sketch size.
    """
    jaccard = F.col("shared") / F.col("sketch")
    kept = scores
    if threshold > 0:
        kept = scores.filter(upper_identity_column(F.col("sketch"), F.col("shared"), k, confidence) >= threshold)
    return kept.select(
        "query_id",
        "file_id",
        "contig_id",
        "fragment_id",
        F.col("length").alias("fragment_length"),
        F.expr("(first_start + last_start) div 2").alias("reference_start"),
        (100 * (1 - mash_distance(jaccard, k))).alias("identity"),
        F.col("sketch").alias("query_minimizers"),
        F.col("reference_keys").alias("reference_minimizers"),
        "shared",
        F.col("sketch").alias("union_size"),
        jaccard.alias("jaccard"),
    )
