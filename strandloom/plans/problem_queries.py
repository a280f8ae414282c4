"""The pN_ queries of the core problems, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.intervals import periods_and_gaps
from strandloom.operators.skew import heavy_keys, is_heavy, per_key_totals, running_totals
from strandloom.session import table

KEY_SPACE = 2**32
HEAVY_SHARE = 0.01


def unsigned_key() -> Column:
    return F.pmod(F.col("minimizer_key"), F.lit(KEY_SPACE))


def _key_totals(spark: SparkSession, data_dir: str) -> DataFrame:
    records = table(spark, data_dir, "grouped_keys")
    return per_key_totals(records, F.col("record_id"), unsigned_key(), F.coalesce("hit_count", F.lit(0)))


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return heavy_keys(_key_totals(spark, data_dir), HEAVY_SHARE).select(F.col("key").alias("minimizer_key"))


def p4_key_totals(spark: SparkSession, data_dir: str) -> DataFrame:
    totals = _key_totals(spark, data_dir)
    return totals.select(
        F.col("key").alias("minimizer_key"),
        "records",
        F.col("total").alias("hit_count"),
        is_heavy(totals, HEAVY_SHARE).alias("is_heavy"),
    )


def p4_running_hits(spark: SparkSession, data_dir: str) -> DataFrame:
    records = table(spark, data_dir, "grouped_keys")
    running = running_totals(
        records, F.col("record_id"), unsigned_key(), F.col("hit_count"), F.col("record_id"), chunk_width=65_536
    )
    return running.select(
        F.col("key").alias("minimizer_key"), F.col("record").alias("record_id"), F.col("running").alias("hits_so_far")
    )


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    regions = table(spark, data_dir, "regions")
    pieces = periods_and_gaps(regions, F.col("reference_contig_id"), F.col("start_position"), F.col("end_position"))
    return pieces.withColumnRenamed("entity", "reference_contig_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_key_totals": p4_key_totals,
    "p4_running_hits": p4_running_hits,
    "p5_found": p5_found,
}

_RECORDS = """
records AS (
  SELECT record_id, any_value((minimizer_key + 4294967296) % 4294967296) AS k, any_value(coalesce(hit_count, 0)) AS h
  FROM grouped_keys GROUP BY record_id)"""

ORACLE = {
    "p4_found": f"""
WITH {_RECORDS},
totals AS (SELECT k, sum(h) AS total FROM records GROUP BY k)
SELECT k AS minimizer_key FROM totals WHERE total * 100 >= (SELECT sum(total) FROM totals)""",
    "p4_key_totals": f"""
WITH {_RECORDS},
totals AS (SELECT k, CAST(count(*) AS BIGINT) AS records, CAST(sum(h) AS BIGINT) AS total FROM records GROUP BY k)
SELECT k AS minimizer_key, records, total AS hit_count,
       total * 100 >= (SELECT sum(total) FROM totals) AS is_heavy FROM totals""",
    "p4_running_hits": f"""
WITH {_RECORDS}
SELECT k AS minimizer_key, record_id,
       CAST(sum(h) OVER (PARTITION BY k ORDER BY record_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits_so_far
FROM records""",
    "p5_found": """
WITH iv AS (
  SELECT reference_contig_id AS c, least(start_position, end_position) AS s, greatest(start_position, end_position) AS e
  FROM regions
  WHERE reference_contig_id IS NOT NULL AND start_position IS NOT NULL AND end_position IS NOT NULL
    AND start_position <> end_position),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY c ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
            OVER (PARTITION BY c ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM marked),
stretches AS (SELECT c, i, min(s) AS s, max(e) AS e FROM islands GROUP BY c, i),
nexts AS (SELECT c, e AS s, lead(s) OVER (PARTITION BY c ORDER BY i) AS e FROM stretches)
SELECT c AS reference_contig_id, 'merged' AS piece_kind, s AS start_position, e AS end_position FROM stretches
UNION ALL
SELECT c, 'gap', s, e FROM nexts WHERE e IS NOT NULL""",
}
