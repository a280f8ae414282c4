"""Continuous periods and gaps of overlapping intervals per entity.

Starts and ends are ranked independently of each other: at rank i a gap lies where the (i+1)-th start exceeds the
i-th end. Ranks are counted in two steps, within position buckets and over buckets, so no task holds a whole
entity: equal positions are first summed up, a bucket holds at most `2**bucket_bits` distinct positions, and the
step over buckets sees one row per bucket of an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialize

BUCKET_BITS = 16


def _cumulated(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Add, for each (column, name) of `sums`, the running sum of the column over an entity's positions."""
    within = Window.partitionBy("entity", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(c).over(within).alias(f"_in_{n}") for c, n in sums.items()])
    # a running sum's maximum is the bucket's total; taken from `local`, it shares its shuffle
    totals = local.groupBy("entity", "bucket").agg(*[F.max(f"_in_{n}").alias(f"_sum_{n}") for n in sums.values()])
    before = Window.partitionBy("_entity").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("entity").alias("_entity"),
        F.col("bucket").alias("_bucket"),
        *[f"_sum_{n}" for n in sums.values()],
    ).select(
        "_entity",
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums.values()],
    )
    joined = local.join(bases, (F.col("entity") == F.col("_entity")) & (F.col("bucket") == F.col("_bucket")))
    return joined.select(
        *df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums.values()]
    )


def periods_and_gaps(df: DataFrame, entity: Column, start: Column, end: Column, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(entity, piece_kind, start_position, end_position): `merged` periods of the union of an entity's half-open
    intervals, and `gap` rows between one period and the next.

    Intervals that touch are continuous. An interval covers from the smaller to the larger of its two positions.
    One with a null entity, start or end, or of no length, covers nothing. Repeated rows change nothing. An empty
    table gives no rows; further columns are ignored. Positions are integers, negative ones included.
    """
    spans = df.select(
        entity.alias("entity"),
        F.least(start, end).cast("long").alias("lo"),
        F.greatest(start, end).cast("long").alias("hi"),
        (start.isNotNull() & end.isNotNull() & entity.isNotNull()).alias("whole"),
    ).filter("whole AND lo < hi")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    events = spans.select(
        "entity",
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("pos"), one.alias("starts"), none.alias("ends")),
                F.struct(F.col("hi").alias("pos"), none.alias("starts"), one.alias("ends")),
            )
        ).alias("e"),
    ).select("entity", F.shiftright("e.pos", bucket_bits).alias("bucket"), "e.pos", "e.starts", "e.ends")
    points = events.groupBy("entity", "bucket", "pos").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    # said here once, or the planner would say it on one side of the joins below only, and read everything twice
    points = points.filter("entity IS NOT NULL AND bucket IS NOT NULL").repartition("entity", "bucket")

    ranked = _cumulated(points, {"starts": "started", "ends": "ended"})
    bounds = ranked.select(
        "entity",
        "bucket",
        "pos",
        ((F.col("starts") > 0) & (F.col("started") - F.col("starts") == F.col("ended") - F.col("ends"))).cast("long").alias("opens"),
        ((F.col("ends") > 0) & (F.col("started") == F.col("ended"))).cast("long").alias("closes"),
    ).filter("opens + closes > 0")
    numbered = _cumulated(materialize(bounds), {"opens": "n_open", "closes": "n_close"})

    merged, gap = F.lit("merged").alias("piece_kind"), F.lit("gap").alias("piece_kind")
    at = F.col("pos")
    nothing = F.lit(None).cast("long")
    uses = F.array(
        F.struct(merged, F.when(F.col("opens") == 1, F.col("n_open")).alias("k"), at.alias("a"), nothing.alias("b")),
        F.struct(merged, F.when(F.col("closes") == 1, F.col("n_close")).alias("k"), nothing.alias("a"), at.alias("b")),
        F.struct(gap, F.when(F.col("closes") == 1, F.col("n_close")).alias("k"), at.alias("a"), nothing.alias("b")),
        F.struct(gap, F.when(F.col("opens") == 1, F.col("n_open") - 1).alias("k"), nothing.alias("a"), at.alias("b")),
    )
    paired = (
        numbered.select("entity", F.explode(uses).alias("u"))
        .select("entity", "u.*")
        .filter("k IS NOT NULL")
        .groupBy("entity", "piece_kind", "k")
        .agg(F.max("a").alias("start_position"), F.max("b").alias("end_position"))
    )
    return paired.filter("start_position IS NOT NULL AND end_position IS NOT NULL").drop("k")
