"""The pN_ queries of this package, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.packing import faults_of, fill_of, pack_documents
from strandloom.llm.repetition import repetition, repetitive
from strandloom.llm.setjoin import similar_classes, similar_pairs
from strandloom.llm.splitting import split_fragments, split_texts
from strandloom.llm.tokenizer import count_tokens, encode_texts
from strandloom.llm.topn import top_n
from strandloom.session import materialize, table

SIMILAR = 0.6
PIECE, PIECE_OVERLAP = 2000, 200
TOP = 5
TOKENIZER = "byte_bpe_50k"
REPETITIVE = 0.3


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return split_fragments(*(table(spark, data_dir, t) for t in ("fragments", "contigs", "genomes", "sketch_params")))


def p1_documents(spark: SparkSession, data_dir: str) -> DataFrame:
    return split_texts(table(spark, data_dir, "documents"), "doc_id", "text", PIECE, PIECE_OVERLAP)


def p1_documents_covered(spark: SparkSession, data_dir: str) -> DataFrame:
    """What the pieces of every document add up to, and how many break a rule."""
    documents = table(spark, data_dir, "documents").select("doc_id", F.length("text").cast("long").alias("letters"))
    pieces = p1_documents(spark, data_dir)
    behind = Window.partitionBy("doc_id").orderBy("piece")  # of one document, which is in one row before
    reach = F.lead("piece_start").over(behind) + PIECE_OVERLAP
    marked = pieces.join(documents, "doc_id").select(
        "*",
        (F.col("piece_end") - F.col("piece_start") > PIECE).cast("long").alias("is_too_long"),
        (F.coalesce(F.least(reach, F.col("letters")), F.col("letters")) != F.col("piece_end")).cast("long").alias("is_off"),
    )
    return marked.groupBy("doc_id", "letters").agg(
        F.min("piece_start").alias("first_start"),
        F.max("piece_end").alias("last_end"),
        F.sum("is_too_long").alias("too_long"),
        F.sum("is_off").alias("wrong_overlaps"),
        (F.count(F.lit(1)) > 1).alias("is_split"),
    )


def _unsigned(tokens: Column) -> Column:
    """Keys modulo 2^32, kept as the 32-bit integers with the same bits to halve what is shuffled."""
    return F.transform(tokens, lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)).cast("array<int>")


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    fragments = table(spark, data_dir, "fragments")
    pairs = similar_pairs(fragments, F.col("fragment_id"), _unsigned(F.col("minimizers")), SIMILAR)
    return pairs.select(F.col("record_a").alias("fragment_id_a"), F.col("record_b").alias("fragment_id_b"))


def p2_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    fragments = table(spark, data_dir, "fragments")
    pairs = similar_pairs(fragments, F.col("fragment_id"), _unsigned(F.col("minimizers")), SIMILAR)
    return pairs.select(
        F.col("record_a").alias("fragment_id_a"),
        F.col("record_b").alias("fragment_id_b"),
        F.col("shared").cast("long").alias("shared_minimizers"),
        F.round("jaccard", 9).alias("jaccard"),
    )


def p2_classes(spark: SparkSession, data_dir: str) -> DataFrame:
    fragments = table(spark, data_dir, "fragments")
    found = similar_classes(fragments, F.col("fragment_id"), _unsigned(F.col("minimizers")), SIMILAR)
    return found.withColumnRenamed("record", "fragment_id")


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    mappings = table(spark, data_dir, "mappings").filter("identity BETWEEN 0 AND 100")
    best = top_n(mappings, "query_fragment_id", "identity", ["reference_file_id", "reference_start", "mapping_id"], TOP)
    return best.select("query_fragment_id", "mapping_id")


def p6_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    return encode_texts(table(spark, data_dir, "documents"), "doc_id", "text", TOKENIZER)


def p7_containers(spark: SparkSession, data_dir: str) -> DataFrame:
    return pack_documents(table(spark, data_dir, "documents"), table(spark, data_dir, "pack_targets"))


def p7_fill(spark: SparkSession, data_dir: str) -> DataFrame:
    return fill_of(p7_containers(spark, data_dir), table(spark, data_dir, "pack_targets"))


def p7_faults(spark: SparkSession, data_dir: str) -> DataFrame:
    documents, targets = (table(spark, data_dir, t) for t in ("documents", "pack_targets"))
    sizes = count_tokens(documents.filter("doc_id IS NOT NULL"), "doc_id", "text", TOKENIZER).dropDuplicates(["doc_id"])
    return faults_of(materialize(pack_documents(documents, targets)), sizes, targets)


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return repetitive(table(spark, data_dir, "documents"), "doc_id", "text", REPETITIVE)


def p8_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    measured = repetition(table(spark, data_dir, "documents"), "doc_id", "text")
    return measured.select("doc_id", "words", "repeated_words", F.round("repeated_share", 9).alias("repeated_share"))


def p8_posterior(spark: SparkSession, data_dir: str) -> DataFrame:
    measured = repetition(table(spark, data_dir, "documents"), "doc_id", "text")
    return measured.select("doc_id", "repeated_share", "posterior", "possible")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_documents": p1_documents,
    "p1_documents_covered": p1_documents_covered,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_faults": p7_faults,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_posterior": p8_posterior,
}

_SETS = """
sets AS (
  SELECT fragment_id, list_sort(list_distinct(list_transform(
           list_filter(any_value(minimizers), lambda x: x IS NOT NULL),
           lambda x: (x + 4294967296) % 4294967296))) AS v
  FROM fragments GROUP BY fragment_id),
tokens AS (SELECT fragment_id, len(v) AS n, unnest(v) AS x FROM sets WHERE len(v) > 0),
shared AS (
  SELECT a.fragment_id AS fa, b.fragment_id AS fb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS s
  FROM tokens a JOIN tokens b ON a.x = b.x AND a.fragment_id < b.fragment_id
  GROUP BY 1, 2),
pairs AS (SELECT fa, fb, s, s / (na + nb - s) AS j FROM shared WHERE s >= 0.6 * (na + nb - s))"""

_SHARES = r"""
raw AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\p{L}+')) AS w,
               generate_subscripts(regexp_extract_all(coalesce(text, ''), '\p{L}+'), 1) AS i FROM documents),
words AS (SELECT doc_id, i, lower(w) AS w FROM raw),
runs AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER r AS run, count(*) OVER r AS n FROM words
  WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
again AS (
  SELECT doc_id, i, CASE WHEN n = 8 AND row_number() OVER (PARTITION BY doc_id, run ORDER BY i) > 1 THEN 1 ELSE 0 END AS a
  FROM runs),
covered AS (
  SELECT doc_id, max(a) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM again),
shares AS (
  SELECT d.doc_id, CAST(count(c) AS BIGINT) AS words, CAST(coalesce(sum(c), 0) AS BIGINT) AS repeated_words
  FROM documents d LEFT JOIN covered USING (doc_id) GROUP BY d.doc_id)"""

ORACLE = {
    "p1_found": r"""
WITH q AS (
  SELECT file_id AS query_id, any_value(params_id) AS params_id FROM genomes WHERE side = 'query' GROUP BY file_id),
c AS (
  SELECT file_id AS query_id, contig_id, any_value(seq) AS seq FROM contigs WHERE side = 'query' GROUP BY 1, 2),
f AS (
  SELECT f.fragment_id, greatest(any_value(frag_start), 0) AS a, any_value(p.fragment_length) AS l,
         any_value(p.fragment_stride) AS st, any_value(p.min_fragment_length) AS lmin, any_value(p.split_n_run) AS r,
         substr(any_value(c.seq), any_value(frag_start) + 1, any_value(frag_end) - any_value(frag_start)) AS s
  FROM fragments f JOIN q USING (query_id) JOIN sketch_params p USING (params_id)
  JOIN c ON c.query_id = f.query_id AND c.contig_id = f.contig_id
  WHERE frag_end - frag_start > p.fragment_length GROUP BY f.fragment_id),
letters AS (SELECT *, unnest(range(len(s))) AS i FROM f WHERE len(s) > 0),
isn AS (SELECT fragment_id, i, a, l, st, lmin, r, upper(s[i + 1]) = 'N' AS n FROM letters),
grp AS (
  SELECT *, i - row_number() OVER (PARTITION BY fragment_id, n ORDER BY i) AS g FROM isn),
runs AS (
  SELECT fragment_id, n, min(i) AS i0, max(i) + 1 AS i1, any_value(a) AS a, any_value(l) AS l, any_value(st) AS st,
         any_value(lmin) AS lmin, any_value(r) AS r
  FROM grp GROUP BY fragment_id, n, g),
parted AS (
  SELECT *, (n AND r > 0 AND i1 - i0 >= r) AS cut FROM runs),
ordered AS (
  SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY fragment_id ORDER BY i0) AS k FROM parted),
stretch AS (
  SELECT fragment_id, k, min(i0) + any_value(a) AS s0, max(i1) + any_value(a) AS s1, any_value(l) AS l,
         any_value(st) AS st, any_value(lmin) AS lmin
  FROM ordered WHERE NOT cut GROUP BY fragment_id, k),
long AS (SELECT *, s0 + unnest(range(0, s1 - s0, st)) AS p FROM stretch WHERE s1 - s0 > l AND s1 - s0 >= lmin),
firsts AS (SELECT *, (s1 - s0 - l) // st AS last_full FROM long)
SELECT fragment_id, s0 AS piece_start, s1 AS piece_end FROM stretch WHERE s1 - s0 <= l AND s1 - s0 >= lmin
UNION ALL
SELECT fragment_id, p, p + l FROM firsts WHERE p + l <= s1
UNION ALL
SELECT fragment_id, p, s1 FROM firsts WHERE p = s0 + (last_full + 1) * st AND s1 - p >= lmin""",
    "p1_documents_covered": """
SELECT doc_id, CAST(length(text) AS BIGINT) AS letters, CAST(0 AS BIGINT) AS first_start, CAST(length(text) AS BIGINT) AS last_end,
       CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_overlaps, length(text) > 2000 AS is_split
FROM documents WHERE length(text) > 0""",
    "p2_found": f"""
WITH {_SETS}
SELECT fa AS fragment_id_a, fb AS fragment_id_b FROM pairs""",
    "p2_pairs": f"""
WITH {_SETS}
SELECT fa AS fragment_id_a, fb AS fragment_id_b, s AS shared_minimizers, round(j, 9) AS jaccard FROM pairs""",
    "p2_classes": f"""
WITH {_SETS},
classes AS (SELECT fragment_id, min(fragment_id) OVER (PARTITION BY v) AS class_id FROM sets WHERE len(v) > 0),
ends AS (SELECT fa AS f FROM pairs UNION ALL SELECT fb FROM pairs),
links AS (SELECT f, count(*) AS n FROM ends GROUP BY f)
SELECT fragment_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS links
FROM classes LEFT JOIN links ON f = fragment_id""",
    "p3_found": """
WITH m AS (
  SELECT DISTINCT query_fragment_id, mapping_id, identity, reference_file_id, reference_start FROM mappings
  WHERE query_fragment_id IS NOT NULL AND identity >= 0 AND identity <= 100)
SELECT query_fragment_id, mapping_id FROM m
QUALIFY row_number() OVER (PARTITION BY query_fragment_id
  ORDER BY identity DESC, reference_file_id, reference_start, mapping_id) <= 5""",
    "p7_faults": """
SELECT target_id, CAST(0 AS BIGINT) AS containers_over, CAST(0 AS BIGINT) AS places_off, CAST(0 AS BIGINT) AS documents_off,
       CAST(0 AS BIGINT) AS needless_splits FROM pack_targets""",
    "p8_found": f"""
WITH {_SHARES}
SELECT doc_id FROM shares WHERE words > 0 AND repeated_words / words >= 0.3""",
    "p8_shares": f"""
WITH {_SHARES}
SELECT doc_id, words, repeated_words,
       CASE WHEN words > 0 THEN round(repeated_words / words, 9) ELSE 0.0 END AS repeated_share FROM shares""",
}
