"""One query for each operator of the comparison, over the test tables, with the SQL that gives the same rows.

The references of the sequence queries are the query contigs themselves with fixed replacements made in them, which is
a divergence that both engines can make.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.mash import mash_distance, minimum_shared_column, upper_identity_column
from strandloom.operators.index import (
    frequency_threshold,
    hit_histogram,
    index_summary,
    key_counts,
    partition_of,
    plan_shards,
    shard_of,
    usable_index,
)
from strandloom.operators.reciprocal import query_best, reciprocal_best, reference_best, with_reciprocal_flag
from strandloom.operators.regions import candidate_bands, candidate_regions, merge_bands, seed_hits
from strandloom.operators.scoring import index_of_blocks, reference_blocks, window_scores
from strandloom.operators.segments import fragment_starts, mapped_length, minimizer_estimate, split_on_n, window_count
from strandloom.operators.sketch import fragment_sketches, query_totals, reference_minimizers
from strandloom.operators.summary import contig_summary, distribution, pair_summary, run_summary
from strandloom.params import Parameters
from strandloom.plans.pipeline import compare, fragments_of_queries, Reference
from strandloom.session import materialize, table

K, W, SEED, LENGTH, N_RUN = 14, 10, 42, 300, 10
MUTATIONS = (("GAT", "GAC"), ("CCA", "CTA"))
SETTINGS = Parameters(kmer_size=K, window_size=W, hash_seed=SEED, fragment_length=LENGTH, mash_threshold=0.0, split_n_run=N_RUN)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


# Inputs -------------------------------------------------------------------------------------------------------------

CONTIGS = """
c AS (SELECT file_id, contig_id, any_value(seq) AS seq FROM contigs
      WHERE side = 'query' AND seq IS NOT NULL AND seq <> '' GROUP BY file_id, contig_id)"""
FRAGS = """
f AS (SELECT DISTINCT ON (fragment_id) * FROM fragments)"""
MAPS = """
m AS (SELECT DISTINCT ON (mapping_id) query_id, reference_file_id AS file_id, reference_contig_id AS contig_id,
             query_fragment_id AS fragment_id, query_fragment_length AS fragment_length, reference_start, identity,
             shared_minimizers AS shared, union_minimizers AS union_size, mapping_id
      FROM mappings WHERE query_fragment_id IS NOT NULL AND identity BETWEEN 0 AND 100)"""
KEYS = f"""{FRAGS},
k AS (SELECT query_id % 4 AS shard, query_id AS file_id, CAST(contig_id AS BIGINT) AS contig_id, frag_start AS pos,
             (unnest(minimizers) + 4294967296) % 4294967296 AS key FROM f),
i AS (SELECT * FROM k WHERE key IS NOT NULL)"""


def contigs(spark: SparkSession, data_dir: str) -> DataFrame:
    known = table(spark, data_dir, "contigs").filter("side = 'query' AND seq <> ''")
    return known.select("file_id", "contig_id", "seq").dropDuplicates(["file_id", "contig_id"])


def fragments(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "fragments").dropDuplicates(["fragment_id"])


def mappings(spark: SparkSession, data_dir: str) -> DataFrame:
    known = table(spark, data_dir, "mappings").filter("query_fragment_id IS NOT NULL AND identity BETWEEN 0 AND 100")
    return known.dropDuplicates(["mapping_id"]).select(
        "query_id",
        F.col("reference_file_id").alias("file_id"),
        F.col("reference_contig_id").alias("contig_id"),
        F.col("query_fragment_id").alias("fragment_id"),
        F.col("query_fragment_length").alias("fragment_length"),
        "reference_start",
        "identity",
        F.col("shared_minimizers").alias("shared"),
        F.col("union_minimizers").alias("union_size"),
        "mapping_id",
    )


def key_index(spark: SparkSession, data_dir: str) -> DataFrame:
    """The minimizers of the fragments table as an index in four shards."""
    keys = fragments(spark, data_dir).select(
        (F.col("query_id") % 4).alias("shard"),
        F.col("query_id").alias("file_id"),
        F.col("contig_id").cast("long").alias("contig_id"),
        F.col("frag_start").alias("pos"),
        F.explode("minimizers").alias("key"),
    )
    return keys.withColumn("key", F.pmod("key", F.lit(2**32))).filter("key IS NOT NULL")


def diverged(contigs: DataFrame, sites: tuple[tuple[str, str], ...] = MUTATIONS) -> DataFrame:
    seq = F.upper("seq")
    for old, new in sites:
        seq = F.replace(seq, F.lit(old), F.lit(new))
    return contigs.withColumn("seq", seq)


def sequence_index(spark: SparkSession, data_dir: str) -> DataFrame:
    """Minimizers of the diverged contigs, each contig one segment, all in one shard."""
    keyed = diverged(contigs(spark, data_dir)).withColumn("contig_id", F.col("contig_id").cast("long"))
    return reference_minimizers(keyed, ["file_id", "contig_id"], K, W, SEED).select(F.lit(1).alias("shard"), "*")


def sequence_blocks(spark: SparkSession, data_dir: str) -> DataFrame:
    keyed = diverged(contigs(spark, data_dir)).withColumn("contig_id", F.col("contig_id").cast("long"))
    return reference_blocks(keyed, ["file_id", "contig_id"], K, W, SEED, LENGTH).select(F.lit(1).alias("shard"), "*")


def sequence_fragments(spark: SparkSession, data_dir: str) -> DataFrame:
    return fragments_of_queries(contigs(spark, data_dir), SETTINGS)


# Sequences ----------------------------------------------------------------------------------------------------------


def minimizer_sql(name: str, source: str, keys: str, K: int = K) -> str:  # noqa: N803
    """CTEs that end in `name`(keys, pos, key): minimizers of source(keys, seq), in every window as chosen."""
    lead = lambda e, j: f"lead({e}, {j}) OVER o" if j else e
    forward = " + ".join(f"{lead('b', j)} * {4 ** (K - 1 - j)}" for j in range(K))
    backward = " + ".join(f"(3 - {lead('b', j)}) * {4**j}" for j in range(K))
    x1 = f"(xor(x0, x0 >> 16) * {0x2C1B3C6D}) % 4294967296"
    x2 = f"(xor(x1, x1 >> 15) * {0x297A2D39}) % 4294967296"
    return f"""
{name}_l AS (SELECT {keys}, unnest(string_split(upper(seq), '')) AS letter, unnest(range(len(seq))) AS pos FROM {source}),
{name}_b AS (SELECT {keys}, pos, instr('ACGT', letter) - 1 AS b FROM {name}_l),
{name}_k AS (
  SELECT {keys}, pos, isbad, CASE WHEN b >= 2 THEN 1 ELSE 0 END AS heavy,
         CAST({forward} AS BIGINT) AS fw, CAST({backward} AS BIGINT) AS bw, {lead('b', K - 1)} IS NOT NULL AS whole
  FROM (SELECT * REPLACE (greatest(b, 0) AS b), b < 0 AS isbad FROM {name}_b) WINDOW o AS (PARTITION BY {keys} ORDER BY pos)),
{name}_x0 AS (SELECT *, (least(fw, bw) + {SEED}) % 4294967296 AS x0 FROM {name}_k),
{name}_x1 AS (SELECT *, {x1} AS x1 FROM {name}_x0),
{name}_x2 AS (SELECT *, {x2} AS x2 FROM {name}_x1),
{name}_h AS MATERIALIZED (SELECT {keys}, pos, isbad, heavy, fw, bw, CASE WHEN whole THEN xor(x2, x2 >> 16) END AS h FROM {name}_x2),
{name}_w AS (
  SELECT {keys}, pos, sum(CASE WHEN isbad THEN 1 ELSE 0 END) OVER v AS n_bad, sum(heavy) OVER v AS n_heavy, count(*) OVER v AS n,
         min(CASE WHEN h IS NULL THEN NULL ELSE h * 1000000 + pos END) OVER u AS left_best,
         min(CASE WHEN h IS NULL THEN NULL ELSE h * 1000000 + 999999 - pos END) OVER u AS right_best
  FROM {name}_h
  WINDOW v AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {K + W - 2} FOLLOWING),
         u AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)),
{name}_c AS (
  SELECT {keys}, pos AS win, CASE WHEN 2 * n_heavy > {K + W - 1} THEN left_best % 1000000 ELSE 999999 - right_best % 1000000 END AS pos
  FROM {name}_w WHERE n = {K + W - 1} AND n_bad = 0),
{name}_d AS (
  SELECT *, lag(pos) OVER (PARTITION BY {keys} ORDER BY win) AS before FROM {name}_c),
{name} AS MATERIALIZED (
  SELECT {keys}, pos, least(hh.fw, hh.bw) AS key
  FROM {name}_d d JOIN {name}_h hh USING ({keys}, pos)
  WHERE d.before IS DISTINCT FROM d.pos AND hh.fw <> hh.bw)"""


_SEGMENTS = f"""{CONTIGS},
sl AS (SELECT file_id, contig_id, unnest(string_split(upper(seq), '')) AS letter, unnest(range(len(seq))) AS i FROM c),
sn AS (SELECT file_id, contig_id, i, letter = 'N' AS n FROM sl),
sg AS (SELECT *, i - row_number() OVER (PARTITION BY file_id, contig_id, n ORDER BY i) AS g FROM sn),
sr AS (SELECT file_id, contig_id, n, min(i) AS a, max(i) + 1 AS b FROM sg GROUP BY file_id, contig_id, n, g),
sc AS (SELECT *, n AND b - a >= {N_RUN} AS cut FROM sr),
so AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, contig_id ORDER BY a) AS part FROM sc),
segments AS (SELECT file_id, contig_id, min(a) AS segment_start, max(b) AS segment_end FROM so WHERE NOT cut
             GROUP BY file_id, contig_id, part)"""


@query("split_n_segments", f"WITH {_SEGMENTS} SELECT file_id, contig_id, segment_start, segment_end FROM segments")
def split_n_segments(spark: SparkSession, data_dir: str) -> DataFrame:
    split = split_on_n(contigs(spark, data_dir), ["file_id", "contig_id"], N_RUN)
    return split.select("file_id", "contig_id", "segment_start", "segment_end")


def _ranges_sql(length: int, stride: int, least: int) -> str:
    if length == stride == least:
        body = f"SELECT file_id, contig_id, i AS frag_start, i + {length} AS frag_end FROM s WHERE i + {length} <= n"
    else:
        body = f"""
SELECT file_id, contig_id, 0 AS frag_start, n AS frag_end FROM l WHERE n >= {least} AND n <= {length}
UNION ALL SELECT file_id, contig_id, i, i + {length} FROM s WHERE n > {length} AND i + {length} <= n
UNION ALL SELECT file_id, contig_id, i, n FROM s
  WHERE n > {length} AND i = ((n - {length}) // {stride} + 1) * {stride} AND n - i >= {least}"""
        if least == length:
            body += f"""
UNION ALL SELECT file_id, contig_id, n - {length}, n FROM l
  WHERE n > {length} AND (n - {length}) % {stride} <> 0 AND n - ((n - {length}) // {stride} + 1) * {stride} < {least}"""
    return f"""WITH {CONTIGS}, l AS (SELECT file_id, contig_id, len(seq) AS n FROM c),
s AS (SELECT *, unnest(range(0, n + {stride}, {stride})) AS i FROM l) {body}"""


def _ranges(length: int, stride: int, least: int) -> Query:
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        cut = contigs(spark, data_dir).select("file_id", "contig_id", F.explode(fragment_starts(F.length("seq"), length, stride, least)).alias("f"))
        return cut.select("file_id", "contig_id", F.col("f.start").alias("frag_start"), F.col("f.end").alias("frag_end"))

    return run


for _name, _shape in {"compat": (300, 300, 300), "overlap": (300, 100, 300), "tail": (300, 250, 100)}.items():
    query(f"fragment_ranges_{_name}", _ranges_sql(*_shape))(_ranges(*_shape))


@query(
    "contig_estimates",
    f"""WITH {CONTIGS}
SELECT file_id, contig_id, len(seq) - CASE WHEN len(seq) % {LENGTH} >= 100 THEN 0 ELSE len(seq) % {LENGTH} END AS mapped,
       greatest(len(seq) - {K + W - 1} + 1, 0) AS windows,
       CAST(ceil(2 * greatest(len(seq) - {K + W - 1} + 1, 0) / {W + 1}.0) AS BIGINT) AS estimate FROM c""",
)
def contig_estimates(spark: SparkSession, data_dir: str) -> DataFrame:
    n = F.length("seq")
    return contigs(spark, data_dir).select(
        "file_id", "contig_id", mapped_length(n, LENGTH, 100).alias("mapped"), window_count(n, K, W).alias("windows"), minimizer_estimate(n, K, W).alias("estimate")
    )


@query("minimizers_windowed", f"WITH {CONTIGS}, {minimizer_sql('mz', 'c', 'file_id, contig_id')} SELECT * FROM mz")
def minimizers_windowed(spark: SparkSession, data_dir: str) -> DataFrame:
    return reference_minimizers(contigs(spark, data_dir), ["file_id", "contig_id"], K, W, SEED)


def _fragments_sql(length: int, k: int) -> str:
    return f"""{_SEGMENTS},
fs AS (SELECT file_id, contig_id, segment_start, segment_end - segment_start AS n,
              unnest(range(segment_start, segment_end, {length})) AS frag_start FROM segments),
fr AS (SELECT file_id, contig_id, frag_start, substr(seq, frag_start + 1, {length}) AS seq FROM fs JOIN c USING (file_id, contig_id)
       WHERE frag_start + {length} <= segment_start + n),
{minimizer_sql('qm', 'fr', 'file_id, contig_id, frag_start', k)},
sk AS (SELECT file_id AS query_id, contig_id, frag_start, list_sort(list(DISTINCT key)) AS minimizers FROM qm GROUP BY ALL),
qf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY contig_id, frag_start) - 1 AS fragment_id FROM sk)"""


_FRAGMENTS = _fragments_sql(LENGTH, K)


@query(
    "fragment_sketch",
    f"""WITH {_FRAGMENTS}
SELECT query_id, contig_id, frag_start, len(minimizers) AS n_keys, CAST(list_sum(minimizers) AS BIGINT) AS key_sum,
       minimizers[1] AS least_key FROM sk""",
)
def fragment_sketch(spark: SparkSession, data_dir: str) -> DataFrame:
    shape = {"k": K, "w": W, "seed": SEED, "length": LENGTH, "stride": LENGTH, "least": LENGTH, "n_run": N_RUN}
    sketched = fragment_sketches(contigs(spark, data_dir), ["file_id", "contig_id"], **shape)
    return sketched.select(
        F.col("file_id").alias("query_id"),
        "contig_id",
        "frag_start",
        F.size("minimizers").cast("long").alias("n_keys"),
        F.aggregate("minimizers", F.lit(0).cast("long"), lambda a, x: a + x).alias("key_sum"),
        F.get("minimizers", F.lit(0)).alias("least_key"),
    )


@query(
    "minmer_seeds",
    f"""WITH {_FRAGMENTS}
SELECT query_id, fragment_id, contig_id, frag_start, unnest(minimizers[1:5]) AS key FROM qf""",
)
def minmer_seeds(spark: SparkSession, data_dir: str) -> DataFrame:
    found = fragments_of_queries(contigs(spark, data_dir), replace(SETTINGS, minmer_count=5))
    return found.select("query_id", "fragment_id", "contig_id", "frag_start", F.explode("seeds").alias("key"))


@query(
    "query_totals",
    f"""WITH {_FRAGMENTS}
SELECT query_id, count(*) AS fragments, count(*) * {LENGTH} AS mapped_length, CAST(sum(len(minimizers)) AS BIGINT) AS minimizers,
       CAST(sum(len(minimizers)) AS BIGINT) AS seeds FROM qf GROUP BY query_id""",
)
def totals_of_queries(spark: SparkSession, data_dir: str) -> DataFrame:
    return query_totals(sequence_fragments(spark, data_dir))


# Index --------------------------------------------------------------------------------------------------------------


@query(
    "inverted_index_counts",
    f"""WITH {KEYS} SELECT shard, key, count(*) AS hits FROM i GROUP BY shard, key""",
)
def inverted_index_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    return key_counts(key_index(spark, data_dir))


_THRESHOLD = f"""{KEYS},
kc AS (SELECT shard, key, count(*) AS hits FROM i GROUP BY shard, key),
cl AS (SELECT shard, hits, count(*) AS n FROM kc GROUP BY shard, hits),
cu AS (SELECT *, sum(n) OVER (PARTITION BY shard ORDER BY hits DESC) AS passed,
              floor(sum(n) OVER (PARTITION BY shard) * 1.0 / 100) AS allowed FROM cl),
th AS (SELECT shard, min(hits) AS threshold FROM cu WHERE passed <= allowed GROUP BY shard)"""


@query("frequency_threshold", f"WITH {_THRESHOLD} SELECT * FROM th")
def frequency_threshold_of_shards(spark: SparkSession, data_dir: str) -> DataFrame:
    return frequency_threshold(key_counts(key_index(spark, data_dir)), 1.0)


@query(
    "frequency_filtered_hits",
    f"""WITH {_THRESHOLD}
SELECT shard, file_id, contig_id, pos, key FROM i JOIN kc USING (shard, key) LEFT JOIN th USING (shard)
WHERE threshold IS NULL OR hits < threshold""",
)
def frequency_filtered_hits(spark: SparkSession, data_dir: str) -> DataFrame:
    return usable_index(key_index(spark, data_dir), 1.0).select("shard", "file_id", "contig_id", "pos", "key")


@query(
    "index_summary",
    f"""WITH {KEYS}
SELECT shard, count(DISTINCT file_id) AS reference_files, count(DISTINCT (file_id, contig_id)) AS contigs,
       count(DISTINCT key) AS unique_keys, count(*) AS hits FROM i GROUP BY shard""",
)
def summary_of_index(spark: SparkSession, data_dir: str) -> DataFrame:
    return index_summary(key_index(spark, data_dir))


@query(
    "hit_histogram",
    f"""WITH {KEYS}, kc AS (SELECT shard, key, count(*) AS hits FROM i GROUP BY shard, key)
SELECT CASE WHEN hits <= 1 THEN 1 WHEN hits <= 2 THEN 2 WHEN hits <= 4 THEN 4 WHEN hits <= 9 THEN 9 WHEN hits <= 24 THEN 24
            WHEN hits <= 49 THEN 49 WHEN hits <= 99 THEN 99 WHEN hits <= 249 THEN 249 WHEN hits <= 499 THEN 499
            WHEN hits <= 999 THEN 999 WHEN hits <= 4999 THEN 4999 WHEN hits <= 9999 THEN 9999
            WHEN hits <= 49999 THEN 49999 END AS bin,
       count(*) AS keys, CAST(sum(hits) AS BIGINT) AS hits FROM kc GROUP BY 1""",
)
def histogram_of_hits(spark: SparkSession, data_dir: str) -> DataFrame:
    return hit_histogram(key_counts(key_index(spark, data_dir)))


@query(
    "partition_ids",
    """WITH r AS (SELECT DISTINCT ON (record_id) *, (minimizer_key + 4294967296) % 4294967296 AS k FROM grouped_keys)
SELECT record_id, partition_index, CAST(k >> 28 AS INTEGER) AS partition_id FROM r""",
)
def partition_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    records = table(spark, data_dir, "grouped_keys").dropDuplicates(["record_id"])
    return records.select("record_id", "partition_index", partition_of(F.pmod("minimizer_key", F.lit(2**32)), 16).alias("partition_id"))


_BUDGET = 5000
_SHARDS = f"""{FRAGS},
pc AS (SELECT query_id, sum(coalesce(len(minimizers), 0)) AS n FROM f GROUP BY query_id),
pn AS (SELECT query_id, n, row_number() OVER (ORDER BY query_id) AS r FROM pc),
ps AS (
  SELECT r, query_id, n, 1 AS shard, n AS filled FROM pn WHERE r = 1
  UNION ALL
  SELECT pn.r, pn.query_id, pn.n, CASE WHEN filled + pn.n <= {_BUDGET} THEN shard ELSE shard + 1 END,
         CASE WHEN filled + pn.n <= {_BUDGET} THEN filled + pn.n ELSE pn.n END
  FROM ps JOIN pn ON pn.r = ps.r + 1)"""


def _shard_plan(spark: SparkSession, data_dir: str) -> DataFrame:
    sizes = fragments(spark, data_dir).groupBy("query_id").agg(F.sum(F.coalesce(F.size("minimizers"), F.lit(0)).cast("long")).alias("n"))
    counted = sizes.orderBy("query_id").collect()  # one row per reference file
    planned = plan_shards([max(0, r.n) for r in counted], _BUDGET)
    numbered = [(r.query_id, i, max(0, r.n)) for i, r in enumerate(counted)]
    files = spark.createDataFrame(numbered, "query_id int, file int, n long")
    return files.select("query_id", "n", shard_of(F.col("file"), planned).alias("shard"))


@query("shard_plan", f"WITH RECURSIVE {_SHARDS} SELECT query_id, shard, CAST(n AS BIGINT) AS n FROM ps")
def shard_plan(spark: SparkSession, data_dir: str) -> DataFrame:
    return _shard_plan(spark, data_dir)


@query(
    "shard_pruned_query",
    f"""WITH RECURSIVE {_SHARDS}
SELECT shard, count(*) AS fragments FROM f JOIN ps USING (query_id) WHERE shard IN (1, 3) GROUP BY shard""",
)
def shard_pruned_query(spark: SparkSession, data_dir: str) -> DataFrame:
    chosen = _shard_plan(spark, data_dir).filter("shard IN (1, 3)")
    return fragments(spark, data_dir).join(chosen, "query_id").groupBy("shard").agg(F.count(F.lit(1)).alias("fragments"))


# Regions and scores -------------------------------------------------------------------------------------------------

_DIVERGED = """
rc AS (SELECT file_id, CAST(contig_id AS BIGINT) AS contig_id, replace(replace(upper(seq), 'GAT', 'GAC'), 'CCA', 'CTA') AS seq FROM c)"""


def _hits_sql(length: int, k: int, references: str) -> str:
    return f"""{_fragments_sql(length, k)},{references},
{minimizer_sql('rm', 'rc', 'file_id, contig_id', k)},
seeds AS (SELECT query_id, fragment_id, unnest(minimizers) AS key FROM qf),
hits AS (SELECT query_id, fragment_id, file_id, rm.contig_id, pos FROM seeds JOIN rm USING (key))"""


_HITS = _hits_sql(LENGTH, K, _DIVERGED)
_BANDS = """{hits},
nh AS (SELECT *, row_number() OVER (PARTITION BY query_id, fragment_id, file_id, contig_id ORDER BY pos) AS r FROM hits),
bands AS (SELECT a.query_id, a.fragment_id, a.file_id, a.contig_id, greatest(0, b.pos - {length} + 1) AS band_start, a.pos AS band_end
          FROM {a} JOIN nh b ON a.query_id = b.query_id AND a.fragment_id = b.fragment_id AND a.file_id = b.file_id
               AND a.contig_id = b.contig_id AND b.r = a.r + {m} - 1
          WHERE b.pos - a.pos < {length}),
bm AS (SELECT *, max(band_end) OVER (PARTITION BY query_id, fragment_id, file_id, contig_id ORDER BY band_start, band_end
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bands),
bi AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < band_start THEN 1 ELSE 0 END)
                 OVER (PARTITION BY query_id, fragment_id, file_id, contig_id ORDER BY band_start, band_end ROWS UNBOUNDED PRECEDING) AS island FROM bm),
regions_ AS (SELECT query_id, fragment_id, file_id, contig_id, min(band_start) AS region_start, max(band_end) AS region_end
             FROM bi GROUP BY query_id, fragment_id, file_id, contig_id, island)"""
_BANDS_3, _BANDS_1 = (_BANDS.format(hits=_HITS, length=LENGTH, a="nh a", m=m) for m in (3, 1))


@query("seed_hits", f"WITH {_HITS} SELECT * FROM hits")
def hits_of_seeds(spark: SparkSession, data_dir: str) -> DataFrame:
    return seed_hits(sequence_fragments(spark, data_dir), sequence_index(spark, data_dir))


def _bands_input(spark: SparkSession, data_dir: str, m: int) -> tuple[DataFrame, DataFrame]:
    found = sequence_fragments(spark, data_dir)
    return seed_hits(found, sequence_index(spark, data_dir)), found.withColumn("min_shared", F.lit(m))


@query("candidate_bands", f"WITH {_BANDS_3} SELECT * FROM bands")
def bands_of_hits(spark: SparkSession, data_dir: str) -> DataFrame:
    return candidate_bands(*_bands_input(spark, data_dir, 3))


@query("candidate_regions", f"WITH {_BANDS_3} SELECT * FROM regions_")
def regions_of_hits(spark: SparkSession, data_dir: str) -> DataFrame:
    return candidate_regions(*_bands_input(spark, data_dir, 3))


@query(
    "region_merge",
    """WITH r AS (
  SELECT DISTINCT query_id, fragment_id, reference_contig_id AS c, least(start_position, end_position) AS s,
         greatest(start_position, end_position) AS e
  FROM regions WHERE reference_contig_id IS NOT NULL AND start_position IS NOT NULL AND end_position IS NOT NULL),
mk AS (SELECT *, max(e) OVER (PARTITION BY query_id, fragment_id, c ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
il AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < s THEN 1 ELSE 0 END)
                 OVER (PARTITION BY query_id, fragment_id, c ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM mk)
SELECT query_id, fragment_id, c AS reference_contig_id, min(s) AS region_start, max(e) AS region_end
FROM il GROUP BY query_id, fragment_id, c, i""",
)
def region_merge(spark: SparkSession, data_dir: str) -> DataFrame:
    known = table(spark, data_dir, "regions").filter("reference_contig_id IS NOT NULL AND start_position IS NOT NULL AND end_position IS NOT NULL")
    ordered = known.select(
        "query_id",
        "fragment_id",
        "reference_contig_id",
        F.least("start_position", "end_position").alias("s"),
        F.greatest("start_position", "end_position").alias("e"),
    ).distinct()
    return merge_bands(ordered, ["query_id", "fragment_id", "reference_contig_id"], "s", "e")


def _scores_sql(bands: str, length: int, k: int) -> str:
    return f"""{bands},
rg AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM regions_),
wm AS (SELECT rid, region_end, m.pos, m.key
       FROM rg r JOIN rm m ON m.file_id = r.file_id AND m.contig_id = r.contig_id AND m.pos >= region_start AND m.pos < region_end + {length}),
wi AS (SELECT DISTINCT a.rid, a.pos, b.key FROM wm a JOIN wm b ON a.rid = b.rid
       WHERE a.pos <= a.region_end AND b.pos >= a.pos AND b.pos < a.pos + {length - (W - 1) - (k - 1)}),
wq AS (SELECT DISTINCT rid, pos FROM wi),
uu AS (SELECT wi.*, 1 AS r, 0 AS q FROM wi
       UNION ALL SELECT wq.*, unnest(minimizers) AS key, 0, 1 FROM wq JOIN rg USING (rid) JOIN qf USING (query_id, fragment_id)),
ud AS (SELECT rid, pos, key, max(r) AS r, max(q) AS q FROM uu GROUP BY ALL),
ur AS (SELECT *, row_number() OVER (PARTITION BY rid, pos ORDER BY key) AS rank, sum(q) OVER (PARTITION BY rid, pos) AS sketch FROM ud),
us AS (SELECT rid, pos, any_value(sketch) AS sketch,
              sum(CASE WHEN r = 1 AND q = 1 AND rank <= sketch THEN 1 ELSE 0 END) AS shared, sum(r) AS reference_keys
       FROM ur GROUP BY ALL),
ub AS (SELECT *, max(shared) OVER (PARTITION BY rid) AS top FROM us),
best_of AS (
  SELECT rid, CAST(any_value(sketch) AS BIGINT) AS sketch, CAST(any_value(shared) AS BIGINT) AS shared, min(pos) AS first_start,
         max(pos) AS last_start, CAST(arg_max(reference_keys, pos) AS BIGINT) AS reference_keys
  FROM ub WHERE shared = top AND shared > 0 GROUP BY rid),
scores AS MATERIALIZED (
  SELECT query_id, fragment_id, file_id, contig_id, region_start, region_end, sketch, shared, first_start, last_start, reference_keys
  FROM best_of JOIN rg USING (rid))"""


_SCORES = _scores_sql(_BANDS_1, LENGTH, K)


@query("window_scores", f"WITH {_SCORES} SELECT * FROM scores")
def scores_of_windows(spark: SparkSession, data_dir: str) -> DataFrame:
    blocks = materialize(sequence_blocks(spark, data_dir))
    found = materialize(sequence_fragments(spark, data_dir)).withColumn("min_shared", F.lit(1))
    regions = candidate_regions(seed_hits(found, index_of_blocks(blocks, LENGTH)), found)
    return window_scores(regions, found, blocks, K, W, LENGTH).drop("length")


# Mash ---------------------------------------------------------------------------------------------------------------


def _upper_sql(name: str, pairs: str, k: int, confidence: float) -> str:
    """CTEs that end in `name`(s, x, upper): percent identity at the upper end of the similarities that x shared of s keys
    make likely, for the rows (s, x) of `pairs`: the most shared keys that are reached or passed with the tail's probability."""
    return f"""
{name}_i AS (SELECT s, x, unnest(range(x, s + 1)) AS i FROM {pairs} WHERE x > 0 AND x < s),
{name}_p AS (SELECT *, exp(lgamma(s + 1) - lgamma(i + 1) - lgamma(s - i + 1) + i * ln(x / s) + (s - i) * ln(1 - x / s)) AS p FROM {name}_i),
{name}_t AS (SELECT *, sum(p) OVER (PARTITION BY s, x ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS tail FROM {name}_p),
{name}_m AS (SELECT s, x, greatest(x, max(CASE WHEN tail >= {(1 - confidence) / 2!r} THEN i END)) AS most FROM {name}_t GROUP BY s, x),
{name} AS (SELECT s, x, CASE WHEN x <= 0 THEN 0 WHEN x >= s OR most >= s THEN 100
                        ELSE 100 * (1 + ln(2 * (most / s) / (1 + most / s)) / {k}) END AS upper
           FROM {pairs} LEFT JOIN {name}_m USING (s, x))"""


def _minimum_sql(name: str, sizes: str, k: int, identity: float, confidence: float) -> str:
    """CTEs that end in `name`(s, least): the fewest shared keys of the rows (s) of `sizes` that may belong to this identity. Going
    down from what the identity itself makes of s keys, the last before one whose upper identity is too low."""
    return f"""
{name}_s AS (SELECT s, CAST(ceil(s * (1 / (2 * exp({k} * {1 - identity / 100!r}) - 1))) AS BIGINT) AS strict FROM {sizes}),
{name}_c AS (SELECT s, strict, unnest(range(1, strict)) AS x FROM {name}_s),
{_upper_sql(name + '_u', name + '_c', k, confidence)},
{name}_f AS (SELECT s, max(x) AS x FROM {name}_u WHERE upper < {identity} GROUP BY s),
{name} AS (SELECT s, CASE WHEN strict <= 1 THEN 1 ELSE coalesce(x + 1, 1) END AS least FROM {name}_s LEFT JOIN {name}_f USING (s))"""


@query(
    "mash_identity",
    f"""WITH {MAPS}
SELECT mapping_id, round(CASE WHEN shared = 0 THEN 1 WHEN shared = union_size THEN 0
       ELSE -ln(2 * (shared / union_size) / (1 + shared / union_size)) / 16 END, 9) AS distance FROM m WHERE union_size > 0""",
)
def mash_identity(spark: SparkSession, data_dir: str) -> DataFrame:
    known = mappings(spark, data_dir).filter("union_size > 0")
    return known.select("mapping_id", F.round(mash_distance(F.col("shared") / F.col("union_size"), 16), 9).alias("distance"))


@query(
    "min_shared_lookup",
    f"""WITH {FRAGS}, sz AS (SELECT DISTINCT len(minimizers) AS s FROM f WHERE len(minimizers) > 0),
{_minimum_sql('ms', 'sz', 16, 80.0, 0.9)}
SELECT CAST(s AS INTEGER) AS sketch, CAST(least AS INTEGER) AS min_shared FROM ms""",
)
def min_shared_lookup(spark: SparkSession, data_dir: str) -> DataFrame:
    sizes = fragments(spark, data_dir).select(F.size("minimizers").alias("sketch")).filter("sketch > 0").distinct()
    return sizes.select("sketch", minimum_shared_column(F.col("sketch"), 16, 80.0, 0.9).alias("min_shared"))


_SHARED = f"""{MAPS},
mp AS (SELECT mapping_id, CAST(union_size AS BIGINT) AS s, CAST(shared AS BIGINT) AS x FROM m WHERE union_size > 0 AND shared BETWEEN 0 AND union_size),
pr AS (SELECT DISTINCT s, x FROM mp)"""


@query(
    "identity_filter",
    f"""WITH {_SHARED},{_upper_sql('up', 'pr', 16, 0.9)}
SELECT mapping_id, round(upper, 6) AS upper_identity FROM mp JOIN up USING (s, x) WHERE upper >= 80""",
)
def identity_filter(spark: SparkSession, data_dir: str) -> DataFrame:
    known = mappings(spark, data_dir).filter("union_size > 0 AND shared BETWEEN 0 AND union_size")
    upper = upper_identity_column(F.col("union_size"), F.col("shared"), 16, 0.9)
    return known.select("mapping_id", upper.alias("upper")).filter("upper >= 80").select("mapping_id", F.round("upper", 6).alias("upper_identity"))


# Reciprocal best and summaries --------------------------------------------------------------------------------------

_BEST = f"""{MAPS},
qb AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, file_id, fragment_id
         ORDER BY identity DESC, contig_id DESC, reference_start DESC, mapping_id DESC) = 1),
rb AS (SELECT * FROM qb QUALIFY row_number() OVER (PARTITION BY query_id, contig_id, reference_start // {LENGTH - 20}
         ORDER BY identity DESC, fragment_id DESC, mapping_id DESC) = 1)"""
_KEYS = "query_id, file_id, contig_id, fragment_id, reference_start"


@query("query_best", f"WITH {_BEST} SELECT {_KEYS}, round(identity, 9) AS identity FROM qb")
def best_of_queries(spark: SparkSession, data_dir: str) -> DataFrame:
    return query_best(mappings(spark, data_dir)).select(*_KEYS.split(", "), F.round("identity", 9).alias("identity"))


@query(
    "reference_best",
    f"""WITH {MAPS},
rb AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, contig_id, reference_start // {LENGTH - 20}
         ORDER BY identity DESC, fragment_id DESC) = 1)
SELECT query_id, contig_id, reference_start // {LENGTH - 20} AS bin, fragment_id, round(identity, 9) AS identity FROM rb""",
)
def best_of_references(spark: SparkSession, data_dir: str) -> DataFrame:
    best = reference_best(mappings(spark, data_dir), LENGTH)
    bins = F.floor(F.col("reference_start") / (LENGTH - 20)).cast("long").alias("bin")
    return best.select("query_id", "contig_id", bins, "fragment_id", F.round("identity", 9).alias("identity"))


@query(
    "reciprocal_flags",
    f"""WITH {_BEST}
SELECT m.mapping_id, EXISTS (SELECT 1 FROM rb WHERE rb.query_id = m.query_id AND rb.file_id = m.file_id AND rb.contig_id = m.contig_id
  AND rb.fragment_id = m.fragment_id AND rb.reference_start = m.reference_start) AS is_reciprocal_best FROM m""",
)
def reciprocal_flags(spark: SparkSession, data_dir: str) -> DataFrame:
    return with_reciprocal_flag(mappings(spark, data_dir), LENGTH).select("mapping_id", "is_reciprocal_best")


_T = "[12.706,4.303,3.182,2.776,2.571,2.447,2.365,2.306,2.262,2.228,2.201,2.179,2.160,2.145,2.131,2.120,2.110,2.101,2.093,2.086,2.080,2.074,2.069,2.064,2.060,2.056,2.052,2.048,2.045,2.042]"


def _distribution_sql(groups: str, extra: str = "") -> str:
    return f"""
md AS (SELECT *, median(identity) OVER (PARTITION BY {groups}) AS med FROM rb{extra}),
st AS (SELECT {groups}, count(*) AS n, CAST(sum(fragment_length) AS BIGINT) AS bases, sum(identity * fragment_length) AS weighted,
              avg(identity) AS mean, any_value(med) AS med, stddev_samp(identity) AS sd, median(abs(identity - med)) AS mad,
              avg(CASE WHEN identity >= 99 THEN 1.0 ELSE 0 END) AS f99, avg(CASE WHEN identity <= 80 THEN 1.0 ELSE 0 END) AS f80
       FROM md GROUP BY {groups}),
di AS (SELECT *, CASE WHEN n > 1 THEN (CASE WHEN n <= 31 THEN {_T}[n - 1] ELSE 1.96 END) * sd / sqrt(n) ELSE 0 END AS half FROM st)"""


_ROUNDED = ("median", "stddev", "mad", "ci_95_upper", "ci_95_lower", "f99", "f80")
_DI = "round(med, 6) AS median, round(sd, 6) AS stddev, round(mad, 6) AS mad, round(mean + half, 6) AS ci_95_upper, round(mean - half, 6) AS ci_95_lower, round(f99, 6) AS f99, round(f80, 6) AS f80"


def _no_nan(*names: str) -> list:
    return [F.round(F.when(~F.isnan(n), F.col(n)), 6).alias(n) for n in names]


@query(
    "ani_distribution",
    f"""WITH {_BEST}, {_distribution_sql('query_id, file_id')}
SELECT query_id, file_id, n AS shared_fragments, bases AS shared_bases, round(weighted, 4) AS weighted_identity, {_DI} FROM di""",
)
def ani_distribution(spark: SparkSession, data_dir: str) -> DataFrame:
    found = distribution(reciprocal_best(mappings(spark, data_dir), LENGTH), ["query_id", "file_id"])
    return found.select("query_id", "file_id", "shared_fragments", "shared_bases", F.round("weighted_identity", 4).alias("weighted_identity"), *_no_nan(*_ROUNDED))


_LENGTHS = f"""{FRAGS},
ql AS (SELECT query_id, CAST(sum(frag_end - frag_start) AS BIGINT) AS mapped_length FROM f GROUP BY query_id)"""


def _query_lengths(spark: SparkSession, data_dir: str) -> DataFrame:
    return fragments(spark, data_dir).groupBy("query_id").agg(F.sum(F.col("frag_end") - F.col("frag_start")).alias("mapped_length"))


def _pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    return pair_summary(reciprocal_best(mappings(spark, data_dir), LENGTH), _query_lengths(spark, data_dir), LENGTH)


_PAIRS = f"""{_BEST}, {_distribution_sql('query_id, file_id')}, {_LENGTHS},
pairs AS (SELECT query_id, file_id, round(weighted / bases, 6) AS ani, round(bases / mapped_length, 6) AS af,
                 round(mapped_length / {LENGTH}.0, 6) AS total_fragments, {_DI}, n AS shared_fragments FROM di JOIN ql USING (query_id))"""


@query("pair_ani", f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_ani(spark: SparkSession, data_dir: str) -> DataFrame:
    found = _pairs(spark, data_dir)
    return found.select("query_id", "file_id", *_no_nan("ani", "af", "total_fragments", *_ROUNDED), "shared_fragments")


@query(
    "run_summary",
    f"""WITH {_PAIRS}
SELECT count(*) AS emitted_pairs, min(ani) AS ani_min, max(ani) AS ani_max, min(af) AS af_min, max(af) AS af_max FROM pairs""",
)
def summary_of_run(spark: SparkSession, data_dir: str) -> DataFrame:
    return run_summary(_pairs(spark, data_dir)).select("emitted_pairs", *_no_nan("ani_min", "ani_max", "af_min", "af_max"))


@query(
    "per_contig_zero_fill",
    f"""WITH {_BEST}, {_LENGTHS},
fc AS (SELECT fragment_id, query_id, contig_id AS query_contig FROM f),
rbc AS (SELECT rb.*, query_contig FROM rb JOIN fc USING (query_id, fragment_id)),
{_distribution_sql('query_id, file_id, query_contig').replace('FROM rb)', 'FROM rbc)')},
el AS (SELECT query_id, contig_id AS query_contig, count(*) AS eligible_fragments FROM f GROUP BY query_id, contig_id),
fl AS (SELECT DISTINCT file_id FROM ref_contigs)
SELECT query_id, file_id, query_contig, eligible_fragments, coalesce(n, 0) AS shared_fragments, round(weighted / bases, 6) AS ani, {_DI}
FROM el CROSS JOIN fl LEFT JOIN di USING (query_id, file_id, query_contig)""",
)
def per_contig_zero_fill(spark: SparkSession, data_dir: str) -> DataFrame:
    found = contig_summary(*_best_of_contigs(spark, data_dir), table(spark, data_dir, "ref_contigs"))
    return found.select("query_id", "file_id", "query_contig", "eligible_fragments", "shared_fragments", *_no_nan("ani", *_ROUNDED))


def _best_of_contigs(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reciprocal-best mappings with their query contig, and the fragments."""
    known = fragments(spark, data_dir).select("query_id", "fragment_id", "contig_id")
    return reciprocal_best(mappings(spark, data_dir), LENGTH).join(known.withColumnRenamed("contig_id", "query_contig"), ["query_id", "fragment_id"]), known


@query(
    "mapping_stats",
    f"""WITH {_BEST}, {FRAGS}
SELECT m.mapping_id, m.query_id, m.file_id, f.contig_id AS query_contig, r.name AS reference_contig, f.frag_start AS query_start,
       r.segment_start + m.reference_start AS reference_start, r.segment_start + m.reference_start + m.fragment_length AS reference_end
FROM m JOIN f USING (query_id, fragment_id) LEFT JOIN ref_contigs r ON r.reference_contig_id = m.contig_id""",
)
def mapping_stats(spark: SparkSession, data_dir: str) -> DataFrame:
    known = fragments(spark, data_dir).select("query_id", "fragment_id", F.col("contig_id").alias("query_contig"), F.col("frag_start").alias("query_start"))
    dims = table(spark, data_dir, "ref_contigs").select(F.col("reference_contig_id").alias("contig_id"), F.col("name").alias("reference_contig"), "segment_start")
    start = F.col("segment_start") + F.col("reference_start")
    return (
        mappings(spark, data_dir)
        .join(known, ["query_id", "fragment_id"])
        .join(dims, "contig_id", "left")
        .select(
            "mapping_id",
            "query_id",
            "file_id",
            "query_contig",
            "reference_contig",
            "query_start",
            start.alias("reference_start"),
            (start + F.col("fragment_length")).alias("reference_end"),
        )
    )


def compared(spark: SparkSession, data_dir: str):
    """Every query genome against every diverged one."""
    known = contigs(spark, data_dir)
    blocks = materialize(sequence_blocks(spark, data_dir))
    files = known.select("file_id").distinct().withColumn("shard", F.lit(1))
    return compare(known, Reference(index_of_blocks(blocks, LENGTH), blocks, known, files), SETTINGS)


def _ani_sql(scores: str, length: int, k: int, kept: str = "scores") -> str:
    return f"""{scores},
ms AS (SELECT query_id, file_id, contig_id, fragment_id, {length} AS fragment_length, (first_start + last_start) // 2 AS reference_start,
              100 * (1 - CASE WHEN shared = sketch THEN 0 ELSE -ln(2 * (shared / sketch) / (1 + shared / sketch)) / {k} END) AS identity
       FROM {kept}),
qb AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY query_id, file_id, fragment_id
         ORDER BY round(identity, 9) DESC, contig_id DESC, reference_start DESC) = 1),
rb AS (SELECT * FROM qb QUALIFY row_number() OVER (PARTITION BY query_id, contig_id, reference_start // {length - 20}
         ORDER BY round(identity, 9) DESC, fragment_id DESC) = 1),
{_distribution_sql('query_id, file_id')},
ql AS (SELECT query_id, count(*) * {length} AS mapped_length FROM qf GROUP BY query_id)
SELECT query_id, file_id, round(weighted / bases, 6) AS ani, round(bases / mapped_length, 6) AS af,
       round(mapped_length / {length}.0, 6) AS total_fragments, {_DI}, n AS shared_fragments FROM di JOIN ql USING (query_id)"""


_GENOME_ANI = f"WITH {_ani_sql(_SCORES, LENGTH, K)}"


@query("genome_ani", _GENOME_ANI)
@query("genome_ani_unfiltered", _GENOME_ANI)
def genome_ani(spark: SparkSession, data_dir: str) -> DataFrame:
    """Without a threshold every chance hit is a mapping, so that in the end all pairs of genomes have a row."""
    pairs = compared(spark, data_dir).pairs
    return pairs.select("query_id", "file_id", *_no_nan("ani", "af", "total_fragments", *_ROUNDED), "shared_fragments")


# With the settings that a run has if nothing else is asked for, but for shorter fragments: k-mer size, threshold, confidence.
USUAL = Parameters(window_size=W, hash_seed=SEED, fragment_length=800, split_n_run=N_RUN)
# Every genome has a reference of its own, and one that it shares with the next genome and that is further away.
FURTHER = (*MUTATIONS, ("TTG", "TAG"), ("ACG", "ATG"), ("GCC", "GTC"), ("AGT", "AAT"))


def _replaced_sql(sites: tuple[tuple[str, str], ...]) -> str:
    seq = "upper(seq)"
    for old, new in sites:
        seq = f"replace({seq}, '{old}', '{new}')"
    return seq


_TWO_REFERENCES = f"""
rc AS (SELECT file_id, CAST(contig_id AS BIGINT) AS contig_id, {_replaced_sql(MUTATIONS)} AS seq FROM c
       UNION ALL SELECT 1000000 + file_id // 2, 1000000000 + contig_id, {_replaced_sql(FURTHER)} FROM c)"""
_USUAL_BANDS = _BANDS.format(
    hits=f"""{_hits_sql(USUAL.fragment_length, USUAL.kmer_size, _TWO_REFERENCES)},
sz AS (SELECT DISTINCT len(minimizers) AS s FROM qf),
{_minimum_sql('least_of', 'sz', USUAL.kmer_size, USUAL.mash_threshold, USUAL.mash_confidence)},
fl AS (SELECT query_id, fragment_id, least FROM qf JOIN least_of ON s = len(minimizers))""",
    length=USUAL.fragment_length,
    a="nh a JOIN fl ON fl.query_id = a.query_id AND fl.fragment_id = a.fragment_id",
    m="fl.least",
)
_USUAL_SCORES = f"""{_scores_sql(_USUAL_BANDS, USUAL.fragment_length, USUAL.kmer_size)},
sx AS (SELECT DISTINCT sketch AS s, shared AS x FROM scores),
{_upper_sql('up', 'sx', USUAL.kmer_size, USUAL.mash_confidence)},
kept AS (SELECT scores.* FROM scores JOIN up ON s = sketch AND x = shared WHERE upper >= {USUAL.mash_threshold})"""


@query("genome_ani_default", f"WITH {_ani_sql(_USUAL_SCORES, USUAL.fragment_length, USUAL.kmer_size, 'kept')}")
def genome_ani_default(spark: SparkSession, data_dir: str) -> DataFrame:
    """With threshold and confidence as usual, every genome against all of two generations of references."""
    known = contigs(spark, data_dir).withColumn("contig_id", F.col("contig_id").cast("long"))
    shared = diverged(known, FURTHER).select(
        (F.lit(1_000_000) + F.floor(F.col("file_id") / 2)).cast("int").alias("file_id"), (F.col("contig_id") + 1_000_000_000).alias("contig_id"), "seq"
    )
    references = diverged(known).select("file_id", "contig_id", "seq").unionByName(shared)
    made = reference_blocks(references, ["file_id", "contig_id"], USUAL.kmer_size, W, SEED, USUAL.fragment_length)
    blocks = materialize(made.select(F.lit(1).alias("shard"), "*"))
    files = references.select("file_id").distinct().withColumn("shard", F.lit(1))
    reference = Reference(index_of_blocks(blocks, USUAL.fragment_length), blocks, references, files)
    pairs = compare(contigs(spark, data_dir), reference, USUAL).pairs
    return pairs.select("query_id", "file_id", *_no_nan("ani", "af", "total_fragments", *_ROUNDED), "shared_fragments")
