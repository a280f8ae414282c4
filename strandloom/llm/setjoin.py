"""All similar pairs between set-valued records, by a prefix-filtered join.

Records with equal sets form one class, and only classes are joined. The tokens of a set are ordered by rarity over
all rows: the counts of the frequent ones are exact, those of the others estimated by buckets (any one order for all
sets gives the same pairs). A set of n tokens that is similar to another shares a token with it among its
first n - ceil(t n) + 1, and with a larger one among its first n - ceil(2 t n / (1 + t)) + 1: only those are
indexed. A pair that meets at a token is kept if sizes and places in the order still allow enough overlap, and is
then verified on the whole sets.

A list of sets under one token that is long, by its exact number of postings, is not joined: its sets are indexed by
that token and each further one in reach, as a pair that needs L + 1 tokens in common has its first L + 1 of them at
most L places beyond the prefix. Lists of two tokens that are still long are split by a third one, and so on. A list is only
split if its pairs outnumber the postings of the split, so that no split costs more than it saves. Pairs that need no
more tokens than those of the list are similar by these alone; they meet under the list and their two sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import materialize

#: A token's count is exact from this share of all occurrences on; so there are at most so many, 16 bytes each.
FREQUENT_TOKENS = 16_384
#: Buckets that occurrences are first counted by: four for every token that can be frequent.
BUCKET_BITS = 16
#: From so many postings on a list may be split,
HOT_ROWS = 500
#: if its postings squared are so many times the postings of the split.
SPLIT_GAIN = 8
#: Tokens that a list is split by at most; longer lists of so many tokens are joined as they are.
DEEPEST = 6


def token_set(tokens: Column) -> Column:
    """The distinct non-null tokens, ordered; null for a null array."""
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull())))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that looks random."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tokens_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("tokens").flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _buckets_of(tokens: np.ndarray) -> np.ndarray:
    return (_mixed(tokens) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(2**BUCKET_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(_buckets_of(_tokens_of(batch)), minlength=len(counts))
    there = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["bucket", "n"])


def _counts_within(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _tokens_of(batch)
        found, counts = np.unique(tokens[wanted[_buckets_of(tokens)]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], names=["token", "n"])


class Rarity(NamedTuple):
    """What the order of the tokens goes by: exact counts of the frequent ones, ascending by token, and for all
    others the count of their bucket, as long as it is below what makes a token frequent. Its size is fixed."""

    frequent: np.ndarray
    counts: np.ndarray
    buckets: np.ndarray
    least: int

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of the tokens, or more."""
        estimate = np.minimum(self.buckets[_buckets_of(tokens)], self.least - 1)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
            estimate = np.where(self.frequent[at] == tokens, self.counts[at], estimate)
        return estimate


def rarity_of(sets: DataFrame, limit: int = FREQUENT_TOKENS) -> Rarity:
    """Exact counts of the tokens with more than 1 / limit of all occurrences, `limit` tokens at most; bucket counts else.

    All occurrences are first counted by hash buckets, of which there is a fixed number. A frequent token makes its
    bucket a frequent one, and few buckets are: only the tokens in those are counted one by one.
    """
    by_bucket = sets.mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    buckets = np.zeros(2**BUCKET_BITS, np.int64)
    buckets[by_bucket["bucket"].to_numpy()] = by_bucket["n"].to_numpy()
    least = max(2, int(buckets.sum()) // limit + 1)
    shared = sets.sparkSession.sparkContext.broadcast(buckets >= least)
    exact = sets.mapInArrow(lambda batches: _counts_within(batches, shared.value), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = exact.filter(F.col("n") >= least).toArrow().sort_by("token")
    return Rarity(found["token"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64), buckets, least)


class _Ordered(NamedTuple):
    """The sets of a batch with their tokens by rarity, one behind the other."""

    ids: np.ndarray
    size: np.ndarray
    row: np.ndarray
    tokens: np.ndarray
    estimate: np.ndarray
    first: np.ndarray  # of each set, where its tokens begin

    @classmethod
    def of(cls, batch: pa.RecordBatch, rarity: Rarity) -> _Ordered:
        lists = batch.column("tokens")
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = _tokens_of(batch)
        row = np.repeat(np.arange(len(size)), size)
        estimate = rarity.of(tokens)
        order = np.lexsort((tokens, estimate, row))
        ids = batch.column("set_id").to_numpy(zero_copy_only=False)
        return cls(ids, size, row, tokens[order], estimate[order], np.cumsum(size) - size)


def _prefix(n: np.ndarray, share: float) -> np.ndarray:
    return n - np.ceil(share * n - 1e-9).astype(np.int64) + 1


def _smaller_share(threshold: float) -> float:
    return 2 * threshold / (1 + threshold)


#: key, set_id; meta: size (29 bits), tokens behind those of the key (30), tokens of the key (3), whether the set may be
#: the smaller one of a pair (1); place of the last token; reach: postings that a split would make of this one, -1 for none
POSTINGS = "key long, set_id long, meta long, place int, reach int"


def _emitted(key: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray, met: int, smaller: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
    meta = n << 34 | (n - 1 - place) << 4 | met << 1 | smaller
    columns = [pa.array(key.view(np.int64)), pa.array(ids), pa.array(meta), pa.array(place.astype(np.int32)), pa.array(reach.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "set_id", "meta", "place", "reach"])


def _reach(n: np.ndarray, place: np.ndarray, threshold: float, met: int) -> np.ndarray:
    """Places behind this one at which the next common token of a pair may stand, if `met` are in common so far."""
    return np.maximum(np.minimum(_prefix(n, threshold) + met, n) - 1 - place, 0)


def _postings(batches: Iterator[pa.RecordBatch], rarity: Rarity, threshold: float, least_count: int) -> Iterator[pa.RecordBatch]:
    """The prefix of every set, as far as its tokens may be that frequent."""
    for batch in batches:
        s = _Ordered.of(batch, rarity)
        n, place = s.size[s.row], np.arange(len(s.tokens)) - s.first[s.row]
        kept = np.flatnonzero((place < _prefix(n, threshold)) & (s.estimate >= least_count))
        n, place = n[kept], place[kept]
        smaller = (place < _prefix(n, _smaller_share(threshold))).astype(np.int64)
        yield _emitted(_mixed(s.tokens[kept]), s.ids[s.row[kept]], n, place, 1, smaller, _reach(n, place, threshold, 1))


def _chained(key: np.ndarray, value: np.ndarray | int) -> np.ndarray:
    return _mixed((_mixed(key) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(5) + np.asarray(value).astype(np.uint64))


def _overlap(n: int, m: int, threshold: float) -> int:
    return math.ceil((n + m) * threshold / (1 + threshold) - 1e-9)


def _split(batches: Iterator[pa.RecordBatch], rarity: Rarity, threshold: float, met: int) -> Iterator[pa.RecordBatch]:
    """The postings of long lists of `met` tokens (a set's: `lists`) with one token more each."""
    for batch in batches:
        s = _Ordered.of(batch, rarity)
        lists = batch.column("lists")
        row = np.repeat(np.arange(len(s.ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        fields = lists.flatten()
        key, place, smaller = (fields.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "place", "smaller"))
        n = s.size[row]
        more = _reach(n, place, threshold, met)
        of = np.repeat(np.arange(len(row)), more)
        further = place[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
        m = n[of]
        made = _chained(key[of], s.tokens[s.first[row[of]] + further])
        may_be_smaller = (further < _prefix(m, _smaller_share(threshold)) + met).astype(np.int64)
        yield _emitted(made, s.ids[row[of]], m, further, met + 1, may_be_smaller, _reach(m, further, threshold, met + 1))
        # pairs that are similar by the tokens of the list alone: both sets are tiny, and meet under their two sizes
        largest = math.floor(met / threshold + 1e-9)
        here = {int(x) for x in np.unique(n[n <= largest])}
        for large in range(1, largest + 1 if here else 1):
            for small in range(math.ceil(large * threshold - 1e-9), large + 1):
                if (large in here or small in here) and _overlap(large, small, threshold) <= met:
                    sides = [(n == large, smaller * (small == large))]
                    if small < large:
                        sides.append(((n == small) & (smaller == 1), smaller))
                    for side, role in sides:
                        at = np.flatnonzero(side)
                        own = _chained(_chained(_chained(key[at], -1), large), small)
                        yield _emitted(own, s.ids[row[at]], n[at], place[at], met, role[at], np.full(len(at), -1))


def _least_overlap(n: Column, m: Column, threshold: float) -> Column:
    return F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))


def set_classes(df: DataFrame, record_id: Column, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(set_id, tokens): one row for every different non-empty set, named by its smallest record; written once.
    (record, set_id): the class of every record, each once. Equal sets are found by a 128-bit hash."""
    rows = df.select(record_id.alias("record"), token_set(tokens).alias("tokens")).filter(
        "record IS NOT NULL AND size(tokens) > 0"
    )
    marks = [F.xxhash64("tokens").alias("h1"), F.xxhash64(F.reverse("tokens"), F.lit(1)).alias("h2")]
    rows = rows.select("record", "tokens", *marks)
    sets = materialize(
        rows.groupBy("h1", "h2").agg(F.min("record").alias("set_id"), F.first("tokens").alias("tokens"))
    )
    classes = rows.select("record", "h1", "h2").distinct().join(sets.select("h1", "h2", "set_id"), ["h1", "h2"])
    return sets.select("set_id", "tokens"), classes.select("record", "set_id")


def _long_lists(postings: DataFrame, hot_rows: int) -> DataFrame:
    """(key): lists of at least `hot_rows` postings whose pairs outnumber what a split would make of them."""
    sized = postings.filter("reach >= 0").groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("reach").alias("made"))
    return sized.filter((F.col("n") >= hot_rows) & (F.col("n") * F.col("n") >= SPLIT_GAIN * F.col("made"))).select("key")


def index_of(sets: DataFrame, threshold: float, frequent_limit: int = FREQUENT_TOKENS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The postings of all sets, without those of the lists that were split.

    Only lists of a token that may occur `hot_rows` times are counted, and only the sets in long ones are looked up
    again. The keys of long lists are a table, as they may be many.
    """
    known = sets.sparkSession.sparkContext.broadcast(rarity_of(sets, frequent_limit))
    index = sets.mapInArrow(lambda batches: _postings(batches, known.value, threshold, 0), POSTINGS)
    latest = sets.mapInArrow(lambda batches: _postings(batches, known.value, threshold, hot_rows), POSTINGS)
    split = []
    for met in range(1, DEEPEST):
        long = materialize(_long_lists(latest, hot_rows))
        if long.isEmpty():
            break
        split.append(long)
        own = F.struct("key", F.col("place").cast("long").alias("place"), F.col("meta").bitwiseAND(1).alias("smaller"))
        # a set has a posting for each of its prefix tokens at most, and so for each step
        by_set = latest.filter("reach >= 0").join(long, "key", "left_semi").groupBy("set_id").agg(F.collect_list(own).alias("lists"))
        made = by_set.join(sets, "set_id").mapInArrow(lambda batches, met=met: _split(batches, known.value, threshold, met), POSTINGS)
        latest = materialize(made)
        index = index.unionByName(latest)
    index = index.select("key", "set_id", "meta")
    if split:
        index = index.join(reduce(DataFrame.unionByName, split), "key", "left_anti")
    return index


def similar_sets(sets: DataFrame, threshold: float, frequent_limit: int = FREQUENT_TOKENS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b, n_a, n_b, shared): pairs a < b of different sets with Jaccard similarity of at least `threshold`."""
    candidates = candidate_pairs(index_of(sets, threshold, frequent_limit, hot_rows), threshold)
    left, right = sets.toDF("a", "tokens_a"), sets.toDF("b", "tokens_b")
    pairs = candidates.join(left, "a").join(right, "b").select(
        "a",
        "b",
        F.size("tokens_a").alias("n_a"),
        F.size("tokens_b").alias("n_b"),
        F.size(F.array_intersect("tokens_a", "tokens_b")).alias("shared"),
    )
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return pairs.filter(F.col("shared") >= union * F.lit(threshold) - F.lit(1e-9))


def candidate_pairs(index: DataFrame, threshold: float) -> DataFrame:
    """(a, b): different pairs that meet in the index and whose sizes and places allow enough overlap.

    The larger set of a pair probes with the tokens that any partner may share first; the smaller one, whose partners
    are as large as itself at least, is met at fewer. Both sides are the same table, so that it is shuffled once.
    """
    found = index.toDF("key", "id_x", "meta_x").join(index.toDF("key", "id_y", "meta_y"), "key")
    size, rest = ((lambda side, f=f: F.expr(f.format(m=f"meta_{side}"))) for f in ("shiftright({m}, 34)", "shiftright({m}, 4) & 1073741823"))
    n, m = size("x"), size("y")
    met = F.expr("shiftright(meta_x, 1) & 7")
    # the last term is of both sides, lest the planner filters one of them before the shuffle that they share
    possible = (
        ((n > m) | ((n == m) & (F.col("id_x") > F.col("id_y"))))
        & (m >= n * F.lit(threshold) - F.lit(1e-9))
        & (met + F.least(rest("x"), rest("y")) >= _least_overlap(n, m, threshold) + F.expr("(1 - (meta_y & 1)) * 1073741824"))
    )
    return found.filter(possible).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def similar_pairs(df: DataFrame, record_id: Column, tokens: Column, threshold: float) -> DataFrame:
    """(record_a, record_b, shared, jaccard): all pairs record_a < record_b of different records whose token sets
    are not empty and have (intersection size) / (union size) >= threshold, 0 < threshold <= 1.

    Record ids and tokens are integers. Null tokens and repeated tokens do not count; a null or empty array, or a
    null id, has no partner. Repeated rows of a record are one record (their sets must agree). An empty table gives
    no rows, further columns are ignored. Pairs of equal sets are all given, so the result is as large as they are
    many; `similar_classes` keeps them folded.
    """
    sets, classes = set_classes(df, record_id, tokens)
    across = similar_sets(sets, threshold).select("a", "b", "shared", (F.col("n_a") + F.col("n_b") - F.col("shared")).alias("union"))
    same = (
        classes.groupBy("set_id")
        .agg(F.count(F.lit(1)).alias("members"))
        .filter("members > 1")
        .join(sets, "set_id")
        .select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.size("tokens").alias("shared"), F.size("tokens").alias("union"))
    )
    folded = across.unionByName(same)
    left, right = classes.toDF("left", "a"), classes.toDF("right", "b")
    return (
        folded.join(left, "a")
        .join(right, "b")
        .filter("a <> b OR left < right")
        .select(
            F.least("left", "right").alias("record_a"),
            F.greatest("left", "right").alias("record_b"),
            "shared",
            (F.col("shared") / F.col("union")).alias("jaccard"),
        )
    )


def similar_classes(df: DataFrame, record_id: Column, tokens: Column, threshold: float) -> DataFrame:
    """(record, class_id, links): for every record with a non-empty set, the smallest record with the same set, and
    its number of partners: records with another set that is similar, plus the other members of its class."""
    sets, classes = set_classes(df, record_id, tokens)
    members = classes.groupBy("set_id").agg(F.count(F.lit(1)).alias("members"))
    pairs = similar_sets(sets, threshold).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(members.toDF("b", "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    links = members.join(outside, members.set_id == outside.a, "left").select(
        "set_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    )
    return classes.join(links, "set_id").select("record", F.col("set_id").alias("class_id"), "links")
