"""Reciprocal-best mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_MARGIN = 20


def position_bin(start: Column, length: int | Column) -> Column:
    """The bin of a reference position: bins are the fragment length less a margin wide, 1 at least."""
    width = F.greatest((F.lit(length) if isinstance(length, int) else length) - BIN_MARGIN, F.lit(1))
    return F.floor(start / width).cast("long")


def query_best(mappings: DataFrame) -> DataFrame:
    """The best mapping of every fragment on every reference file: highest identity, then contig, then start.

    The planner keeps the best row of each group before the shuffle (window group limit).
    """
    order = Window.partitionBy("query_id", "file_id", "fragment_id").orderBy(
        F.desc("identity"), F.desc("contig_id"), F.desc("reference_start")
    )
    return mappings.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def reference_best(mappings: DataFrame, length: int | Column) -> DataFrame:
    """Of those, the best in every position bin of every contig: highest identity, then the last fragment."""
    order = Window.partitionBy("query_id", "contig_id", "_bin").orderBy(F.desc("identity"), F.desc("fragment_id"))
    binned = mappings.withColumn("_bin", position_bin(F.col("reference_start"), length))
    return binned.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "_bin")


def reciprocal_best(mappings: DataFrame, length: int | Column) -> DataFrame:
    return reference_best(query_best(mappings), length)


def with_reciprocal_flag(mappings: DataFrame, length: int | Column) -> DataFrame:
    """All mappings with is_reciprocal_best."""
    keys = ["query_id", "file_id", "contig_id", "fragment_id", "reference_start"]
    best = reciprocal_best(mappings, length).select(*keys).withColumn("_best", F.lit(True))
    return mappings.join(best, keys, "left").withColumn("is_reciprocal_best", F.coalesce("_best", F.lit(False))).drop("_best")
