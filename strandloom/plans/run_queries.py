"""Queries of what a run reads, stores and writes, and of the distributions behind its figures, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from dataclasses import replace
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.mash import binomial_survival, distance_lower_bound, distance_to_jaccard, incomplete_beta, jaccard_to_distance, normal_cdf, t_cdf
from strandloom.operators.index import index_metrics, key_counts, merge_metrics
from strandloom.operators.reciprocal import with_reciprocal_flag
from strandloom.operators.summary import eligible_contigs, found_contigs, hidden_support
from strandloom.params import Genome, Parameters
from strandloom.plans import engine_queries as engine
from strandloom.plans import report
from strandloom.plans.engine_queries import K, LENGTH, N_RUN, SEED, W, Query
from strandloom.plans.pipeline import load_reference
from strandloom.session import shared_folder, table
from strandloom.sources.fasta import read_contigs

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(function: Query) -> Query:
        QUERIES[name], ORACLE[name] = function, sql
        return function

    return add


# Sources ------------------------------------------------------------------------------------------------------------

LINE = 70


def _paths(spark: SparkSession, folder: str) -> dict[int, str]:
    """file_id -> path of the one file in each folder file_id=..."""
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    listed, found = at.getFileSystem(settings).listFiles(at, True), {}
    while listed.hasNext():
        path = listed.next().getPath().toString()
        name = path.rsplit("/", 1)[1]
        if name.startswith("part-"):
            found[int(path.split("file_id=")[1].split("/")[0])] = path.removeprefix("file:")
    return found


def fasta_files(spark: SparkSession, data_dir: str, compression: str) -> tuple[Genome, ...]:
    """The query contigs written as FASTA files, one for each genome, its file_id for a label; contigs go by their ids."""
    folder = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    lines = F.regexp_replace("seq", f"(.{{{LINE}}})", "$1\n")
    records = engine.contigs(spark, data_dir).select("file_id", "contig_id", F.concat(F.lit(">"), F.col("contig_id").cast("string"), F.lit(" contig\n"), lines).alias("value"))
    ordered = records.repartition("file_id").sortWithinPartitions("file_id", "contig_id").select("file_id", "value")
    ordered.write.partitionBy("file_id").option("compression", compression).text(folder)
    return tuple(Genome(path, str(file)) for file, path in sorted(_paths(spark, folder).items()))


_FASTA = f"""WITH {engine.CONTIGS}
SELECT dense_rank() OVER (ORDER BY file_id) - 1 AS file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY contig_id) - 1 AS INTEGER) AS contig_id,
       CAST(contig_id AS VARCHAR) AS name, CAST(len(seq) AS INTEGER) AS letters, md5(seq) AS digest FROM c"""


def _read_back(compression: str) -> Query:
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        read = read_contigs(spark, fasta_files(spark, data_dir, compression), "query")
        return read.select(F.col("file_id").cast("long").alias("file_id"), "contig_id", "name", F.length("seq").alias("letters"), F.md5("seq").alias("digest"))

    return run


query("fasta_scan", _FASTA)(_read_back("none"))
query("fasta_gzip_scan", _FASTA)(_read_back("gzip"))

_STORED_BUDGET = 8_000


@query(
    "stored_shards",
    f"""WITH RECURSIVE {engine._SEGMENTS},
{engine.minimizer_sql('mz', 'c', 'file_id, contig_id')},
es AS (SELECT file_id, count(*) AS contigs, sum(ceil(2 * greatest(segment_end - segment_start - {K + W - 1} + 1, 0) / {W + 1}.0)) AS n FROM segments GROUP BY file_id),
pn AS (SELECT file_id, contigs, n, row_number() OVER (ORDER BY file_id) AS r FROM es),
ps AS (
  SELECT r, file_id, contigs, 1 AS shard, n AS filled FROM pn WHERE r = 1
  UNION ALL
  SELECT pn.r, pn.file_id, pn.contigs, CASE WHEN filled + pn.n <= {_STORED_BUDGET} THEN shard ELSE shard + 1 END,
         CASE WHEN filled + pn.n <= {_STORED_BUDGET} THEN filled + pn.n ELSE pn.n END
  FROM ps JOIN pn ON pn.r = ps.r + 1),
hits AS (SELECT file_id, count(*) AS hits FROM mz GROUP BY file_id)
SELECT CAST(shard AS INTEGER) AS shard, count(*) AS reference_files, CAST(sum(contigs) AS BIGINT) AS contigs, CAST(sum(coalesce(hits, 0)) AS BIGINT) AS hits
FROM ps LEFT JOIN hits USING (file_id) WHERE shard IN (1, 3) GROUP BY shard""",
)
def stored_shards(spark: SparkSession, data_dir: str) -> DataFrame:
    """A database built from FASTA files, stored, and read again for two of its shards."""
    folder = f"{shared_folder(spark)}/database-{uuid.uuid4().hex}".removeprefix("file:")
    settings = Parameters(
        kmer_size=K, window_size=W, hash_seed=SEED, fragment_length=LENGTH, split_n_run=N_RUN, reference_sketch=folder, max_shard_minimizers=_STORED_BUDGET, quiet=True
    )
    load_reference(spark, replace(settings, references=fasta_files(spark, data_dir, "gzip")), StringIO())
    read = load_reference(spark, replace(settings, shards="1,3", queries=(Genome("-", "any"),)), StringIO())
    counted = [
        read.files.groupBy("shard").agg(F.count(F.lit(1)).alias("reference_files")),
        read.contigs.groupBy("shard").agg(F.count(F.lit(1)).alias("contigs")),
        read.index.groupBy("shard").agg(F.count(F.lit(1)).alias("hits")),
    ]
    found = counted[0].join(counted[1], "shard").join(counted[2], "shard")
    return found.select(F.col("shard").cast("int").alias("shard"), "reference_files", "contigs", "hits")


@query(
    "index_metrics_merged",
    f"""WITH {engine.KEYS}, kc AS (SELECT shard, key, count(*) AS hits FROM i GROUP BY shard, key)
SELECT count(DISTINCT shard) AS shards, count(*) AS keys, CAST(sum(hits) AS BIGINT) AS hits, max(hits) AS longest FROM kc""",
)
def index_metrics_merged(spark: SparkSession, data_dir: str) -> DataFrame:
    return merge_metrics(index_metrics(key_counts(engine.key_index(spark, data_dir))))


# Tables that are written --------------------------------------------------------------------------------------------


def _text(value: str, digits: int) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'NaN' ELSE printf('%.{digits}f', round({value}, 9)) END"


_STATS_TEXT = ", ".join(_text(v, 3) for v in ("med", "sd", "mad", "mean + half", "mean - half", "f99", "f80"))
_ROUNDED = ("ani", "af", "median", "stddev", "mad", "ci_95_upper", "ci_95_lower", "f99", "f80")


def _rounded(df: DataFrame) -> DataFrame:
    """Figures to nine digits, so that both engines have the same ones to format."""
    return df.withColumns({c: F.round(c, 9) for c in _ROUNDED if c in df.columns})


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumns({"query": F.concat(F.lit("q"), F.col("query_id").cast("string")), "reference": F.concat(F.lit("r"), F.col("file_id").cast("string"))})


@query(
    "pair_lines",
    f"""WITH {engine._BEST}, {engine._distribution_sql('query_id, file_id')}, {engine._LENGTHS}
SELECT concat_ws(chr(9), 'q' || query_id, 'r' || file_id, {_text('weighted / bases', 3)}, {_text('bases / mapped_length', 3)},
                 {_text(f'mapped_length / {LENGTH}.0', 2)}, {_STATS_TEXT}) AS line
FROM di JOIN ql USING (query_id)""",
)
def pair_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    return report.lines_of(_labelled(_rounded(engine._pairs(spark, data_dir))), report.pair_line, ["query_id", "file_id"])


@query(
    "contig_lines",
    engine.ORACLE["per_contig_zero_fill"][: engine.ORACLE["per_contig_zero_fill"].rindex("SELECT query_id, file_id")]
    + f"""SELECT concat_ws(chr(9), 'q' || query_id, 'r' || file_id, 'c' || query_contig, eligible_fragments, coalesce(n, 0), coalesce(bases, 0),
                 {_text('weighted / bases', 3)}, {_STATS_TEXT}) AS line
FROM el CROSS JOIN fl LEFT JOIN di USING (query_id, file_id, query_contig)""",
)
def contig_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    best, known = engine._best_of_contigs(spark, data_dir)
    ids = [[r[0] for r in table(spark, data_dir, t).select(c).dropna().distinct().orderBy(c).collect()] for t, c in (("fragments", "query_id"), ("ref_contigs", "file_id"))]
    contigs = eligible_contigs(known).withColumn("name", F.concat(F.lit("c"), F.col("query_contig").cast("string")))
    return report.contig_table({i: f"q{i}" for i in ids[0]}, [(i, f"r{i}") for i in ids[1]], contigs, _rounded(found_contigs(best)))


@query(
    "mapping_lines",
    f"""WITH {engine._BEST}, {engine.FRAGS},
mm AS (SELECT DISTINCT ON (mapping_id) * FROM mappings),
fl AS (SELECT m.*, EXISTS (SELECT 1 FROM rb WHERE rb.query_id = m.query_id AND rb.file_id = m.file_id AND rb.contig_id = m.contig_id
         AND rb.fragment_id = m.fragment_id AND rb.reference_start = m.reference_start) AS is_best FROM m)
SELECT concat_ws(chr(9), 'q' || fl.query_id, 'r' || fl.file_id, 'c' || f.contig_id, coalesce(r.name, CAST(fl.contig_id AS VARCHAR)), fl.fragment_id,
         coalesce(CAST(f.frag_start AS VARCHAR), 'None'), coalesce(CAST(f.frag_end AS VARCHAR), 'None'),
         coalesce(r.segment_start, 0) + fl.reference_start, coalesce(r.segment_start, 0) + fl.reference_start + fl.fragment_length,
         {_text('fl.identity', 6)}, mm.query_minimizer_count, mm.reference_minimizer_count, fl.shared, fl.union_size,
         {_text('mm.jaccard', 8)}, fl.fragment_length, CASE WHEN is_best THEN 'true' ELSE 'false' END) AS line
FROM fl JOIN f USING (query_id, fragment_id) JOIN mm USING (mapping_id) LEFT JOIN ref_contigs r ON r.reference_contig_id = fl.contig_id""",
)
def mapping_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    flagged = with_reciprocal_flag(engine.mappings(spark, data_dir), LENGTH)
    counts = table(spark, data_dir, "mappings").dropDuplicates(["mapping_id"]).select(
        "mapping_id", F.col("query_minimizer_count").alias("query_minimizers"), F.col("reference_minimizer_count").alias("reference_minimizers"), F.round("jaccard", 9).alias("jaccard")
    )
    placed = engine.fragments(spark, data_dir).select(
        "query_id", "fragment_id", F.concat(F.lit("c"), F.col("contig_id").cast("string")).alias("query_contig"), "frag_start", "frag_end"
    )
    names = table(spark, data_dir, "ref_contigs").select(F.col("reference_contig_id").alias("contig_id"), F.col("name").alias("reference_contig"), "segment_start")
    rows = flagged.withColumn("identity", F.round("identity", 9)).join(counts, "mapping_id").join(placed, ["query_id", "fragment_id"]).join(names, "contig_id", "left")
    return report.lines_of(_labelled(rows), report.mapping_line, ["query_id", "file_id", "fragment_id", "contig_id", "reference_start"])


# Distributions ------------------------------------------------------------------------------------------------------


@query(
    "mash_bounds",
    f"""WITH {engine._SHARED},{engine._upper_sql('up', 'pr', 16, 0.9)},
su AS (SELECT s, x, max(tail) AS tail FROM up_t GROUP BY s, x)
SELECT s AS sketch, x AS shared, round(x / s, 9) AS jaccard, round(1 - upper / 100, 7) AS lower_distance, round(CASE WHEN x = s THEN 1 ELSE tail END, 7) AS survival
FROM up LEFT JOIN su USING (s, x) WHERE x > 0""",
)
def mash_bounds(spark: SparkSession, data_dir: str) -> DataFrame:
    """For every different sketch and count of shared keys: the similarity by way of its distance, the lower bound of the
    distance, and how likely as many shared keys or more are."""
    known = engine.mappings(spark, data_dir).filter("union_size > 0 AND shared BETWEEN 1 AND union_size")
    pairs = known.select(F.col("union_size").cast("long").alias("sketch"), F.col("shared").cast("long").alias("shared")).distinct()

    def bounds(batches):
        for rows in batches:
            found = []
            for s, x in zip(rows["sketch"], rows["shared"], strict=True):
                distance = jaccard_to_distance(x / s, 16)
                found.append((s, x, distance_to_jaccard(distance, 16), distance_lower_bound(distance, s, 16, 0.9), binomial_survival(x, s, x / s)))
            yield pd.DataFrame(found, columns=["sketch", "shared", "jaccard", "lower_distance", "survival"])

    made = pairs.mapInPandas(bounds, "sketch long, shared long, jaccard double, lower_distance double, survival double")
    return made.select("sketch", "shared", F.round("jaccard", 9).alias("jaccard"), *[F.round(c, 7).alias(c) for c in ("lower_distance", "survival")])


_STEPS = 400


def _integral(upper: str, inner: str) -> str:
    """Simpson's rule from 0 to `upper` of `inner`, an expression of a."""
    weight = f"CASE WHEN j = 0 OR j = {_STEPS} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    at = f"(({upper}) * j / {_STEPS})"
    return f"(({upper}) / {3 * _STEPS}.0 * list_sum(list_transform(range(0, {_STEPS + 1}), lambda j: {weight} * {inner.replace('{a}', at)})))"


def _t_cdf_sql(t: str, df: str) -> str:
    """Student's t up to 30 degrees of freedom by the angle whose tangent is t / sqrt(df), the normal distribution by that of t."""
    student = f"0.5 + exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {_integral(f'atan({t} / sqrt({df}))', f'pow(cos({{a}}), {df} - 1)')}"
    normal = f"0.5 + {_integral(f'atan({t})', 'exp(-pow(tan({a}), 2) / 2) / pow(cos({a}), 2)')} / sqrt(2 * pi())"
    return f"CASE WHEN {df} > 30 THEN {normal} ELSE {student} END"


@query(
    "t_distribution",
    f"""WITH g AS (SELECT CAST(df AS INTEGER) AS df, i / 4.0::DOUBLE AS t FROM range(1, 36) d(df), range(-20, 21) x(i))
SELECT df, t, round({_t_cdf_sql('t', 'df')}, 6) AS t_cdf, round({_t_cdf_sql('t', '31')}, 6) AS normal_cdf,
       round(CASE WHEN t = 0 THEN 1 ELSE 2 * (1 - (0.5 + exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi())
             * {_integral('atan(abs(t) / sqrt(df))', 'pow(cos({a}), df - 1)')})) END, 6) AS beta FROM g""",
)
def t_distribution(spark: SparkSession, data_dir: str) -> DataFrame:
    """Student's t, the normal distribution and the incomplete beta function behind them, on a grid."""
    grid = spark.range(1, 36).select(F.col("id").cast("int").alias("df"), F.explode(F.sequence(F.lit(-20), F.lit(20))).alias("i"))

    def cdfs(batches):
        for rows in batches:
            t, df = rows["t"], rows["df"]
            yield pd.DataFrame(
                {
                    "df": df,
                    "t": t,
                    "t_cdf": [t_cdf(a, int(n)) for a, n in zip(t, df, strict=True)],
                    "normal_cdf": [normal_cdf(a) for a in t],
                    "beta": [incomplete_beta(n / 2, 0.5, n / (n + a * a)) for a, n in zip(t, df, strict=True)],
                }
            )

    found = grid.select("df", (F.col("i") / 4).alias("t")).mapInPandas(cdfs, "df int, t double, t_cdf double, normal_cdf double, beta double")
    return found.select("df", "t", *[F.round(c, 6).alias(c) for c in ("t_cdf", "normal_cdf", "beta")])


def _support_sql(name: str, cut: float, share: str, above: bool) -> str:
    p = "1 - c" if above else "c"
    return f"""
{name}_c AS (SELECT query_id, file_id, n, CAST(round(n * {share}) AS BIGINT) AS hits, {_t_cdf_sql(f'(({cut} - med) / mad)', '(n - 1)')} AS c
             FROM di WHERE n > 1 AND mad > 0),
{name}_p AS (SELECT query_id, file_id, n, hits, least(greatest({p}, 0), 1) AS p FROM {name}_c),
{name} AS (SELECT query_id, file_id, CASE WHEN hits <= 0 THEN 1.0 WHEN p <= 0 THEN 0.0 WHEN p >= 1 THEN 1.0 ELSE
             list_sum(list_transform(range(hits, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) END AS p
           FROM {name}_p)"""


@query(
    "hidden_support",
    f"""WITH {engine._BEST}, {engine._distribution_sql('query_id, file_id')},
{_support_sql('hi', 99.0, 'f99', True)}, {_support_sql('lo', 80.0, 'f80', False)}
SELECT query_id, file_id, round(hi.p, 5) AS p99, round(lo.p, 5) AS p80 FROM di LEFT JOIN hi USING (query_id, file_id) LEFT JOIN lo USING (query_id, file_id)""",
)
def support(spark: SparkSession, data_dir: str) -> DataFrame:
    found = hidden_support(engine._pairs(spark, data_dir))
    return found.select("query_id", "file_id", *[F.round(F.when(~F.isnan(c), F.col(c)), 5).alias(c) for c in ("p99", "p80")])
