"""Seed join and candidate regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seed_hits(fragments: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, fragment_id, file_id, contig_id, pos): the places of every seed of every fragment in the index.

    Only ids travel with the seeds; sketches stay behind. A key that very many seeds or places share makes a skewed
    join partition, which adaptive execution splits.
    """
    wanted = fragments.select("query_id", "fragment_id", F.explode("seeds").alias("key"))
    return wanted.join(index, "key").select("query_id", "fragment_id", "file_id", "contig_id", "pos")


def candidate_bands(hits: DataFrame, fragments: DataFrame) -> DataFrame:
    """(query_id, fragment_id, file_id, contig_id, band_start, band_end): for each run of `min_shared` hits within one
    fragment length, the starts at which a fragment would cover all of them.

    `fragments` has query_id, fragment_id, length, min_shared. A group is one fragment on one contig.
    """
    keys = ["query_id", "fragment_id", "file_id", "contig_id"]
    placed = hits.groupBy(*keys).agg(F.array_sort(F.collect_list("pos")).alias("at"))
    known = fragments.select("query_id", "fragment_id", "length", F.greatest("min_shared", F.lit(1)).alias("m"))
    runs = placed.join(known, ["query_id", "fragment_id"]).filter(F.size("at") >= F.col("m"))
    bands = F.transform(
        F.sequence(F.lit(0), F.size("at") - F.col("m")),
        lambda i: F.struct(F.get("at", i).alias("first"), F.get("at", i + F.col("m") - 1).alias("last")),
    )
    return (
        runs.select(*keys, "length", F.explode(bands).alias("b"))
        .filter(F.col("b.last") - F.col("b.first") < F.col("length"))
        .select(
            *keys,
            F.greatest(F.lit(0).cast("long"), F.col("b.last") - F.col("length") + 1).alias("band_start"),
            F.col("b.first").alias("band_end"),
        )
    )


def merge_bands(bands: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(*keys, region_start, region_end): bands that overlap or share an end point, merged; closed intervals.

    One fragment on one contig is a group here, which its length bounds.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = bands.withColumn("_new", F.when(reach.isNull() | (reach < F.col(start)), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias("region_start"), F.max(end).alias("region_end")).drop("_island")


def candidate_regions(hits: DataFrame, fragments: DataFrame) -> DataFrame:
    """(query_id, fragment_id, file_id, contig_id, region_start, region_end)"""
    keys = ["query_id", "fragment_id", "file_id", "contig_id"]
    return merge_bands(candidate_bands(hits, fragments), keys, "band_start", "band_end")
