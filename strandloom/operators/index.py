"""The minimizer index: an ordinary table (shard, file_id, contig_id, key, pos), its key counts, shards and thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of the number of partitions of a build, bytes of a record, bytes a partition aims at.
PARTITIONS_LEAST, PARTITIONS_MOST = 16, 4096
RECORD_BYTES, PARTITION_BYTES = 12, 512 * 2**20


def key_counts(index: DataFrame) -> DataFrame:
    """(shard, key, hits): occurrences of each key in each shard."""
    return index.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("hits"))


def frequency_threshold(counts: DataFrame, percent: float) -> DataFrame:
    """(shard, threshold): keys with at least `threshold` hits are over-frequent.

    floor(keys * percent / 100) keys of a shard may be ignored. Going through the hit counts from the largest down,
    the threshold is the last one at which the keys passed are still that many or fewer. A shard without one is
    unlimited and has no row. The window runs over the different hit counts of a shard, not over its keys.
    """
    classes = counts.groupBy("shard", "hits").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("shard").orderBy(F.desc("hits")).rowsBetween(Window.unboundedPreceding, 0)
    passed = classes.withColumn("passed", F.sum("n").over(down))
    total = F.sum("n").over(Window.partitionBy("shard"))
    allowed = passed.withColumn("allowed", F.floor(total * F.lit(float(percent)) / 100))
    return allowed.filter("passed <= allowed").groupBy("shard").agg(F.min("hits").alias("threshold"))


def usable_index(index: DataFrame, percent: float) -> DataFrame:
    """The index without the over-frequent keys; all of it if percent is 0 or less."""
    if percent <= 0:
        return index
    counts = key_counts(index)
    dropped = counts.join(frequency_threshold(counts, percent), "shard").filter("hits >= threshold").select("shard", "key")
    return index.join(dropped, ["shard", "key"], "left_anti")


def index_summary(index: DataFrame) -> DataFrame:
    """(shard, reference_files, contigs, unique_keys, hits) of every shard."""
    keys = key_counts(index).groupBy("shard").agg(F.count(F.lit(1)).alias("unique_keys"), F.sum("hits").alias("hits"))
    contigs = index.select("shard", "file_id", "contig_id").distinct()
    files = contigs.groupBy("shard").agg(F.countDistinct("file_id").alias("reference_files"), F.count(F.lit(1)).alias("contigs"))
    return files.join(keys, "shard").select("shard", "reference_files", "contigs", "unique_keys", "hits")


def partition_count(records: int) -> int:
    """Partitions of an external build: a power of two, so that each stays near its size."""
    wanted = max(1, math.ceil(records * RECORD_BYTES / PARTITION_BYTES))
    return min(PARTITIONS_MOST, max(PARTITIONS_LEAST, 1 << (wanted - 1).bit_length()))


def partition_of(key: Column, partitions: int) -> Column:
    """The top bits of a 32-bit key."""
    return F.shiftrightunsigned(key.cast("long"), 32 - (partitions.bit_length() - 1)).cast("int")


def plan_shards(minimizers: list[int], budget: int) -> list[tuple[int, int, int]]:
    """(first file, number of files, minimizers) of each shard, filled in file order up to the budget; a file beyond
    the budget has a shard of its own. One number per reference file reaches the driver."""
    shards: list[list[int]] = []
    for file, count in enumerate(minimizers):
        if shards and shards[-1][2] + count <= budget:
            shards[-1][1] += 1
            shards[-1][2] += count
        else:
            shards.append([file, 1, count])
    return [tuple(s) for s in shards]


def shard_of(file_id: Column, shards: list[tuple[int, int, int]]) -> Column:
    """The shard, from 1, of a file number."""
    number = F.lit(None).cast("int")
    starts = F.array(*[F.lit(first) for first, _, _ in shards])
    return F.size(F.filter(starts, lambda s: s <= file_id)).cast("int") if shards else number


def hit_histogram(counts: DataFrame) -> DataFrame:
    """(bin, keys, hits): keys by the length of their hit lists; a bin is named by its upper bound, null beyond all."""
    edges = [1, 2, 4, 9, 24, 49, 99, 249, 499, 999, 4999, 9999, 49999]  # fixed values
    upper = F.lit(None).cast("int")
    for edge in reversed(edges):
        upper = F.when(F.col("hits") <= edge, edge).otherwise(upper)
    return counts.groupBy(upper.alias("bin")).agg(F.count(F.lit(1)).alias("keys"), F.sum("hits").alias("hits"))


def index_metrics(counts: DataFrame) -> DataFrame:
    """(shard, keys, hits, longest): counters of every shard from its `key_counts`; longest is the longest hit list."""
    return counts.groupBy("shard").agg(F.count(F.lit(1)).alias("keys"), F.sum("hits").alias("hits"), F.max("hits").alias("longest"))


def merge_metrics(metrics: DataFrame) -> DataFrame:
    """One row over all shards: sums, and the longest of the longest."""
    return metrics.agg(
        F.count(F.lit(1)).alias("shards"),
        F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("longest"),
    )
