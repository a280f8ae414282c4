"""Length-weighted identity and its distribution, by genome pair or by query contig."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.mash import t_critical_column, tail_support

NAN = float("nan")


def or_nan(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(NAN))


def _median_of(values: Column) -> Column:
    """The median of a sorted array; its size is at least 1."""
    size = F.size(values)
    low, high = F.get(values, F.floor((size - 1) / 2).cast("int")), F.get(values, F.floor(size / 2).cast("int"))
    return (low + high) / 2


def distribution(best: DataFrame, groups: list[str]) -> DataFrame:
    """Per group of reciprocal-best mappings: shared_fragments, shared_bases, weighted_identity, median, stddev, mad,
    ci_95_upper, ci_95_lower, f99, f80 and the counts behind them; what one fragment cannot give is null.

    The interval is that of the unweighted mean. Medians are exact; a group has at most one row per fragment, whose
    identities are held for them, so that one pass is enough.
    """
    identity, length = F.col("identity"), F.col("fragment_length")
    first = best.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("shared_fragments"),
        F.sum(length).alias("shared_bases"),
        F.sum(identity * length).alias("weighted_identity"),
        F.avg(identity).alias("mean"),
        F.sort_array(F.collect_list(identity)).alias("_identities"),
        F.stddev_samp(identity).alias("stddev"),
        F.avg((identity >= 99).cast("double")).alias("f99"),
        F.avg((identity <= 80).cast("double")).alias("f80"),
    )
    n = F.col("shared_fragments")
    half = F.when(n > 1, t_critical_column(n - 1) * F.col("stddev") / F.sqrt(n.cast("double"))).otherwise(0.0)
    result = first.withColumn("ci_95_upper", F.col("mean") + half).withColumn("ci_95_lower", F.col("mean") - half)
    result = result.withColumn("median", _median_of(F.col("_identities")))
    away = F.array_sort(F.transform("_identities", lambda x: F.abs(x - F.col("median"))))
    return result.withColumn("mad", _median_of(away)).drop("_identities")


def pair_summary(best: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """One row for every query and reference file with a reciprocal-best mapping; NaN where there is no value.

    `queries` has query_id and mapped_length.
    """
    summed = distribution(best, ["query_id", "file_id"]).join(queries.select("query_id", "mapped_length"), "query_id")
    return summed.select(
        "query_id",
        "file_id",
        or_nan(F.try_divide("weighted_identity", "shared_bases")).alias("ani"),
        or_nan(F.try_divide("shared_bases", "mapped_length")).alias("af"),
        (F.col("mapped_length") / F.lit(float(length))).alias("total_fragments"),
        *[or_nan(F.col(c)).alias(c) for c in ("median", "stddev", "mad", "ci_95_upper", "ci_95_lower", "f99", "f80")],
        "shared_fragments",
    )


def with_every_file(df: DataFrame, files: DataFrame) -> DataFrame:
    """Each row once for every file id, which is what a table with all pairs is made of. The ids are one value of the plan,
    not literals in it."""
    ids = files.agg(F.collect_set("file_id").alias("ids")).scalar()
    return df.withColumn("_ids", ids).withColumn("file_id", F.explode("_ids")).drop("_ids")


_CONTIG_GROUPS = ["query_id", "file_id", "query_contig"]
_STATISTICS = ("median", "stddev", "mad", "ci_95_upper", "ci_95_lower", "f99", "f80")


def eligible_contigs(fragments: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """(query_id, query_contig, eligible_fragments) of `fragments` (query_id, contig_id). `contigs` (query_id, query_contig, ...)
    adds those that have no fragment, and its other columns."""
    eligible = fragments.groupBy("query_id", F.col("contig_id").alias("query_contig")).agg(F.count(F.lit(1)).alias("eligible_fragments"))
    if contigs is None:
        return eligible
    return contigs.join(eligible, ["query_id", "query_contig"], "left").fillna(0, ["eligible_fragments"])


def found_contigs(best: DataFrame) -> DataFrame:
    """One row for every reference file and query contig with a mapping; NaN where there is no value."""
    return distribution(best, _CONTIG_GROUPS).select(
        *_CONTIG_GROUPS,
        "shared_fragments",
        "shared_bases",
        or_nan(F.try_divide("weighted_identity", "shared_bases")).alias("ani"),
        *[or_nan(F.col(c)).alias(c) for c in _STATISTICS],
    )


def contig_summary(best: DataFrame, fragments: DataFrame, files: DataFrame) -> DataFrame:
    """One row for every reference file and query contig, those without a mapping included (NaN).

    `best` has query_contig; `fragments` query_id, contig_id; `files` is the list of reference file ids, the one factor
    of the output besides the query's contigs.
    """
    every = with_every_file(eligible_contigs(fragments), files)
    return every.join(found_contigs(best), _CONTIG_GROUPS, "left").select(
        *_CONTIG_GROUPS,
        "eligible_fragments",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shared_fragments", "shared_bases")],
        *[or_nan(F.col(c)).alias(c) for c in ("ani", *_STATISTICS)],
    )


def hidden_support(summary: DataFrame) -> DataFrame:
    """Add p99 and p80: how likely so many identities of 99 and more, or 80 and less, are by chance."""
    def support(cut: float, above: bool):
        @F.pandas_udf("double")
        def tail(n: pd.Series, median: pd.Series, mad: pd.Series, share: pd.Series) -> pd.Series:
            rows = zip(n, median, mad, share, strict=True)
            return pd.Series([tail_support(int(a), m, d, round(a * s) if s == s else 0, cut, above) for a, m, d, s in rows], dtype=float)

        return tail

    return summary.withColumn("p99", or_nan(support(99.0, True)("shared_fragments", "median", "mad", "f99"))).withColumn(
        "p80", or_nan(support(80.0, False)("shared_fragments", "median", "mad", "f80"))
    )


def run_summary(pairs: DataFrame) -> DataFrame:
    """One row: emitted pairs and the range of their ANI and aligned fraction."""
    return pairs.filter("shared_fragments > 0").agg(
        F.count(F.lit(1)).alias("emitted_pairs"),
        *[f(c).alias(f"{c}_{name}") for c in ("ani", "af") for name, f in (("min", F.min), ("max", F.max))],
    )
