"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are dealt into content-hashed slices (a hot key spreads over all of them), every slice counts its keys, the
counts are prefix-summed over the slices, and so each row gets its exact position within its key without any task
seeing the whole key. Positions cut a key into chunks of equal size, which are processed apart from each other;
their boundary states (first position, last position, partial result) are merged in chunk order.

A slice number is a hash of the row's own values, so a recomputed task after a lost executor numbers alike.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialize, slices_of

CHUNK_ROWS = 65_536


def _dealt(rows: DataFrame, key: str, order: list[str], slices: int) -> DataFrame:
    """Add `slice` and `_hash`, a hash of the key, and bring rows together by both: a hot key is in all slices."""
    marked = rows.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")).withColumn("_hash", F.hash(key))
    # neither is ever null; said here, the planner does not say it on one side of a later join only and shuffle twice
    return marked.filter("slice IS NOT NULL AND _hash IS NOT NULL").repartition(slices, "slice", "_hash")


def number_rows(rows: DataFrame, key: str, order: list[str], slices: int) -> DataFrame:
    """Add `slice` and `ordinal`, the 0-based exact position of a row within its key in (slice, order) order.

    A null key is a key of its own. `order` must tell rows apart within a key for the numbering to be the same in
    every run. The widest window is one (slice, key); the prefix sum of a key sees one row per slice.
    """
    return _number_dealt(_dealt(rows, key, order, slices), key, order).drop("_hash")


def _number_dealt(dealt: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows stay where they were dealt to: only the counts of the slices are shuffled, to their key and back."""
    within = Window.partitionBy("slice", "_hash", key).orderBy(*order)
    local = dealt.withColumn("_local", F.row_number().over(within) - 1)
    counts = dealt.groupBy("slice", "_hash", key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_by", "_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("slice").alias("_slice"), F.col("_hash").alias("_by"), F.col(key).alias("_key"), "_n").withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    # said in a way that the planner does not take for a join key, by which the rows are not dealt
    same = F.coalesce(F.col(key) == F.col("_key"), F.col(key).isNull() & F.col("_key").isNull())
    numbered = local.join(offsets, (F.col("slice") == F.col("_slice")) & (F.col("_hash") == F.col("_by")) & same)
    return numbered.withColumn("ordinal", F.col("_offset") + F.col("_local")).drop("_slice", "_by", "_key", "_n", "_offset", "_local")


def distinct_records(
    df: DataFrame, record_id: Column, key: Column, value: Column, order: Column | None, slices: int
) -> DataFrame:
    """(record, key, value, position, slice, _hash): every record once, dealt into slices.

    Copies of a record agree in key, value and position, hence meet in one slice; a row with a null record id is a
    record of its own and is kept. The slice also hashes the record, so a hot key is spread evenly.
    """
    rows = df.select(
        record_id.alias("record"), key.alias("key"), value.alias("value"), (order if order is not None else F.lit(None).cast("long")).alias("position")
    )
    dealt = _dealt(rows, "key", ["record", "key", "value", "position"], slices)
    first = F.row_number().over(Window.partitionBy("slice", "_hash", "record").orderBy("key", "position", "value"))
    return dealt.withColumn("_copy", first).filter((F.col("_copy") == 1) | F.col("record").isNull()).drop("_copy")


def chunk_states(
    df: DataFrame,
    record_id: Column,
    key: Column,
    value: Column,
    chunk_rows: int = CHUNK_ROWS,
    slices: int | None = None,
) -> DataFrame:
    """(key, chunk, first, last, records, total): one boundary state for every equal-sized chunk of a key."""
    slices = slices or slices_of(df.sparkSession)
    dealt = distinct_records(df, record_id, key, value, None, slices)
    numbered = _number_dealt(dealt, "key", ["record", "value"])
    chunk = F.floor(F.col("ordinal") / F.lit(chunk_rows)).alias("chunk")
    return numbered.groupBy("key", chunk).agg(
        F.min("ordinal").alias("first"),
        F.max("ordinal").alias("last"),
        F.count(F.lit(1)).alias("records"),
        F.sum(F.coalesce("value", F.lit(0))).alias("total"),
    )


def per_key_totals(
    df: DataFrame,
    record_id: Column,
    key: Column,
    value: Column,
    chunk_rows: int = CHUNK_ROWS,
    slices: int | None = None,
) -> DataFrame:
    """(key, records, total, chunks): number of distinct records of a key and the sum of their values.

    Nulls: a null value counts as 0, a null key is a key of its own, a row with a null record id is its own record.
    Repeated rows of a record count once. An empty table gives no rows. Further columns are ignored. The chunks of
    a key must join without gap or overlap, or the query fails. Written once, a row for each key.
    """
    states = chunk_states(df, record_id, key, value, chunk_rows, slices)
    merged = states.groupBy("key").agg(
        F.sum("records").alias("records"),
        F.sum("total").alias("total"),
        F.count(F.lit(1)).alias("chunks"),
        F.min("first").alias("_first"),
        F.max("last").alias("_last"),
    )
    whole = (F.col("_first") == 0) & (F.col("_last") == F.col("records") - 1)
    checked = F.when(whole, F.col("records")).otherwise(F.raise_error(F.lit("chunks of a key do not join")).cast("long"))
    return materialize(merged.select("key", checked.alias("records"), "total", "chunks"))


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """The keys of `per_key_totals` whose total is at least `share` of the total over all keys."""
    return totals.filter(is_heavy(totals, share))


def is_heavy(totals: DataFrame, share: float) -> Column:
    """Whether a key's total is at least `share` of all, compared in whole numbers: 0.01 is one hundredth exactly."""
    part = Fraction(str(share))
    overall = totals.agg(F.sum("total").alias("overall")).scalar()
    return F.col("total") * F.lit(part.denominator) >= overall * F.lit(part.numerator)


def running_totals(
    df: DataFrame,
    record_id: Column,
    key: Column,
    value: Column,
    order: Column,
    chunk_width: int,
    slices: int | None = None,
) -> DataFrame:
    """(key, record, position, value, running): the sum of a key's values up to and with each record, by position.

    Position ranges of `chunk_width` are the chunks, so that a window never holds a whole hot key: within a chunk a
    running sum, across chunks the prefix sum of the chunk totals. Ties in position go by record id. A null
    position comes first, as position null; a null value adds 0.
    """
    slices = slices or slices_of(df.sparkSession)
    rows = distinct_records(df, record_id, key, value, order, slices).withColumn(
        "_chunk", F.floor(F.col("position") / F.lit(chunk_width))
    )
    amount = F.coalesce("value", F.lit(0))
    within = Window.partitionBy("key", "_chunk").orderBy("position", "record").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(amount).over(within))
    totals = rows.groupBy("key", "_chunk").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("key").alias("_key"), F.col("_chunk").alias("_part"), "_sum").withColumn(
        "_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))
    )
    joined = local.join(
        bases, F.col("key").eqNullSafe(F.col("_key")) & F.col("_chunk").eqNullSafe(F.col("_part"))
    )
    return joined.select("key", "record", "position", "value", (F.col("_base") + F.col("_local")).alias("running"))
