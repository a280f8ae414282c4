"""The whole comparison as one plan over all queries and references, and the runs built from it."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TextIO

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.mash import minimum_shared_column
from strandloom.operators.index import hit_histogram, index_metrics, index_summary, key_counts, merge_metrics, plan_shards, usable_index
from strandloom.operators.reciprocal import reciprocal_best, with_reciprocal_flag
from strandloom.operators.regions import candidate_regions, seed_hits
from strandloom.operators.scoring import index_of_blocks, mappings_of, reference_blocks, window_scores
from strandloom.operators.segments import mapped_length, minimizer_estimate, split_on_n
from strandloom.operators.sketch import query_fragments, query_totals
from strandloom.operators.summary import eligible_contigs, found_contigs, pair_summary
from strandloom.params import ParameterError, Parameters, echo
from strandloom.plans import report
from strandloom.session import broadcast_if_small, local_session, materialize
from strandloom.sources import database
from strandloom.sources.fasta import read_contigs


@dataclass
class Reference:
    index: DataFrame  # shard, file_id, contig_id, key, pos
    blocks: DataFrame  # shard, contig_id, block, at, keys
    contigs: DataFrame  # contig_id, file_id, shard, name, segment_start, segment_end
    files: DataFrame  # file_id, shard, label, mapped_length


RECORD = ["file_id", "record_id", "segment"]


def reference_segments(contigs: DataFrame, n_run: int) -> DataFrame:
    """(contig_id, file_id, record_id, segment, name, segment_start, segment_end): the segments of reference contigs, each
    a contig of its own; contig_id counts them over all files in order. Written once.

    Numbers are prefix sums over (file, record); the one over files has a row for each file.
    """
    split = materialize(split_on_n(contigs.withColumnRenamed("contig_id", "record_id"), ["file_id", "record_id", "name"], n_run, with_seq=False))
    counts = split.groupBy("file_id", "record_id").agg(F.count(F.lit(1)).alias("_n"))
    before_file = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("file_id").agg(F.sum("_n").alias("_files_n"))
    file_base = files.withColumn("_file_base", F.coalesce(F.sum("_files_n").over(before_file), F.lit(0))).drop("_files_n")
    before = Window.partitionBy("file_id").orderBy("record_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").join(file_base, "file_id")
    numbered = split.join(bases, ["file_id", "record_id"])
    return numbered.withColumn("contig_id", (F.col("_file_base") + F.col("_base") + F.col("segment")).cast("long")).drop("_file_base", "_base")


def build_reference(contigs: DataFrame, files: DataFrame, p: Parameters) -> tuple[Reference, list[tuple[int, int, int]]]:
    """The reference side: segments, their minimizers and the shards they go to.

    `files` has file_id and label. A first pass finds the segments, a second one their minimizers, which are written once, in
    blocks; no sequence is shuffled. One estimate per reference file reaches the driver for the shard plan.
    """
    segments = reference_segments(contigs, p.split_n_run)
    length = F.col("segment_end") - F.col("segment_start")
    sized = segments.groupBy("file_id").agg(
        F.sum(minimizer_estimate(length, p.kmer_size, p.window_size)).alias("estimate"),
        F.sum(mapped_length(length, p.fragment_length, p.least)).alias("mapped_length"),
    )
    known = files.join(sized, "file_id", "left").fillna(0, ["estimate", "mapped_length"])
    estimates = [r.estimate for r in known.select("file_id", "estimate").orderBy("file_id").collect()]
    shards = plan_shards(estimates, p.max_shard_minimizers)
    of_file = [(file, number) for number, (first, count, _) in enumerate(shards, 1) for file in range(first, first + count)]
    shard_of_file = F.broadcast(contigs.sparkSession.createDataFrame(of_file, "file_id int, shard int"))
    split = split_on_n(contigs.withColumnRenamed("contig_id", "record_id"), ["file_id", "record_id"], p.split_n_run)
    placed = reference_blocks(split, RECORD, p.kmer_size, p.window_size, p.hash_seed, p.fragment_length)
    numbers = broadcast_if_small(segments.join(shard_of_file, "file_id").select(*RECORD, "contig_id", "shard"))
    blocks = materialize(placed.join(numbers, RECORD).select("shard", "file_id", "contig_id", "block", "at", "keys"))
    dims = segments.join(shard_of_file, "file_id").select("contig_id", "file_id", "shard", "name", "segment_start", "segment_end")
    index = index_of_blocks(blocks, p.fragment_length)
    return Reference(index, blocks, dims, known.join(shard_of_file, "file_id").select("file_id", "shard", "label", "mapped_length")), shards


def load_reference(spark: SparkSession, p: Parameters, log: TextIO) -> Reference:
    """The reference side of a run: the database if there is one, else what is built, and stored if so asked."""
    folder = p.reference_sketch if p.reference_sketch is None else database.found(p.reference_sketch)
    if folder is not None and database.exists(folder) and not (p.force and not p.queries):
        if not p.queries:
            raise ParameterError(f"the sketch {folder} exists; use --force to overwrite it")
        manifest = database.load_manifest(folder, p)
        if p.references and manifest["reference_checksum"] != database.checksum([g.label for g in p.references]):
            print(f"WARNING: the sketch {folder} was built from other references", file=log)
        return Reference(*database.read(spark, folder, manifest, database.chosen_shards(manifest, p.shard_numbers())))
    if not p.references:
        raise ParameterError(f"there is no sketch {folder} and no reference to build it from")
    contigs = read_contigs(spark, p.references, "reference")
    files = spark.createDataFrame([(i, g.label) for i, g in enumerate(p.references)], "file_id int, label string")
    built, planned = build_reference(contigs, files, p)
    if folder is None:
        return built
    summary = {r.shard: r for r in index_summary(built.index).collect()}
    segments = {r.shard: r.n for r in built.contigs.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths = {r.shard: r.n for r in built.files.groupBy("shard").agg(F.sum("mapped_length").alias("n")).collect()}
    shards = [
        {
            "shard": n,
            "first_reference": first,
            "references": count,
            "contigs": segments.get(n, 0),
            "minimizers": summary[n].hits if n in summary else 0,
            "unique_minimizers": summary[n].unique_keys if n in summary else 0,
            "mapped_length": lengths.get(n, 0),
        }
        for n, (first, count, _) in enumerate(planned, 1)
    ]
    database.write(folder, p, built.index, built.blocks, built.contigs, built.files, shards)
    manifest = database.load_manifest(folder, p)
    return Reference(*database.read(spark, folder, manifest, database.chosen_shards(manifest, p.shard_numbers())))


def map_fragments(fragments: DataFrame, reference: Reference, p: Parameters, watch: Observation | None = None) -> DataFrame:
    """All mappings of the fragments on the index, before any is preferred to another. `watch` gets the number of
    candidate regions while the plan runs."""
    usable = usable_index(reference.index, p.max_reference_frequency)
    least = minimum_shared_column(F.size("seeds"), p.kmer_size, p.mash_threshold, p.mash_confidence)
    sized = fragments.select("query_id", "fragment_id", "length", least.alias("min_shared"))
    regions = candidate_regions(seed_hits(fragments, usable), sized)
    if watch is not None:
        regions = regions.observe(watch, F.count(F.lit(1)).alias("regions"))
    scores = window_scores(regions, fragments, reference.blocks, p.kmer_size, p.window_size, p.fragment_length)
    return mappings_of(scores, p.kmer_size, p.mash_threshold, p.mash_confidence)


def fragments_of_queries(contigs: DataFrame, p: Parameters) -> DataFrame:
    renamed = contigs.withColumnRenamed("file_id", "query_id")
    return query_fragments(
        renamed,
        k=p.kmer_size,
        w=p.window_size,
        seed=p.hash_seed,
        length=p.fragment_length,
        stride=p.stride,
        least=p.least,
        n_run=p.split_n_run,
        minmers=p.minmer_count,
    )


@dataclass
class Comparison:
    fragments: DataFrame
    queries: DataFrame  # query_id, fragments, mapped_length, minimizers, seeds
    mappings: DataFrame
    best: DataFrame
    pairs: DataFrame
    regions: int  # candidate regions that were scored
    seconds: dict[str, float]  # of the phases


def _nothing(stage: str, event: str) -> None:
    pass


def compare(query_contigs: DataFrame, reference: Reference, p: Parameters, progress: Callable[[str, str], None] = _nothing) -> Comparison:
    """Everything about all queries and references; sketches, regions and mappings are written once, as several results use
    them. `progress` hears of each phase."""
    times = [time.time()]

    def done(stage: str) -> float:
        times.append(time.time())
        progress(stage, "complete")
        return times[-1] - times[-2]

    progress("query_collect", "start")
    fragments = fragments_of_queries(query_contigs, p)
    seconds = {"query_collect": done("query_collect")}
    watch = Observation("candidate regions")
    progress("candidate_discovery", "start")
    found = map_fragments(fragments, reference, p, watch)
    seconds["candidate_discovery"] = done("candidate_discovery")
    progress("scoring", "start")
    mappings = materialize(found)
    seconds["mapping"] = seconds["candidate_discovery"] + done("scoring")
    best = reciprocal_best(mappings, p.fragment_length)
    queries = query_totals(fragments)
    pairs = pair_summary(best, queries, p.fragment_length)
    try:
        regions = watch.get["regions"]
    except Py4JJavaError:  # the planner cut off a part of the plan that has no rows, and with it what watched them
        regions = 0
    return Comparison(fragments, queries, mappings, best, pairs, regions, seconds)


def metrics(result: Comparison, reference: Reference) -> list[str]:
    """The counters of a run over all shards."""
    counts = materialize(key_counts(reference.index))
    merged = merge_metrics(index_metrics(counts)).first()
    totals = result.queries.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fragments", "minimizers", "seeds")]).first()
    counters = {f"query_{c}": totals[c] for c in ("fragments", "minimizers", "seeds")} | {f"index_{c}": merged[c] for c in ("shards", "keys", "hits", "longest")}
    counters |= {"candidate_regions": result.regions, "mappings": result.mappings.count(), "reciprocal_best": result.best.count()}
    return report.metrics_lines(counters, hit_histogram(counts).orderBy(F.col("bin").asc_nulls_last()).collect())  # one row a bin


class _Progress:
    """Lines on what a run has done, with the time since it began and the driver's memory."""

    def __init__(self, wanted: bool, log: TextIO, began: float) -> None:
        self.wanted, self.log, self.began = wanted, log, began

    def __call__(self, stage: str, event: str) -> None:
        if self.wanted:
            facts = {"stage": stage, "event": event, "rss_gib": report.number(report.memory_gib(), 3), "elapsed_s": report.number(time.time() - self.began, 3)}
            print("PROGRESS", *[f"{k}={v}" for k, v in facts.items()], sep="\t", file=self.log)


def run(p: Parameters, spark: SparkSession | None = None, stdout: TextIO = sys.stdout, stderr: TextIO = sys.stderr) -> None:
    """One run as the parameters say: build a database, or compare and write the tables."""
    began = time.time()
    own = spark is None
    spark = spark or local_session(p.threads)
    try:
        if not p.quiet:
            print(echo(p), file=stderr)
        if not p.is_standard:
            print("WARNING: fragments overlap or vary in length; results differ from those of whole adjacent ones", file=stderr)
        progress = _Progress(p.verbose, stderr, began)
        progress("reference", "start")
        reference = load_reference(spark, p, stderr)
        seconds = {"reference_build": time.time() - began}
        progress("reference", "ready")
        if not p.queries:
            return
        contigs = read_contigs(spark, p.queries, "query")
        result = compare(contigs, reference, p, progress)
        seconds |= result.seconds
        usable = {r.query_id for r in result.queries.select("query_id").collect()}
        if not p.per_contig and len(p.queries) == 1 and not usable:
            raise ParameterError(f"no usable fragments in query {p.queries[0].label}")
        progress("output", "start")
        summed = report.write_all(p, result, reference, contigs, stdout)
        progress("output", "written")
        if p.verbose:
            print(*metrics(result, reference), sep="\n", file=stderr)
        if not p.quiet:
            print(report.summary_line(p, summed, result.regions, reference, seconds, time.time() - began), file=stderr)
    finally:
        if own:
            spark.stop()


def mapping_flags(result: Comparison, p: Parameters) -> DataFrame:
    return with_reciprocal_flag(result.mappings, p.fragment_length)


def contigs_of(result: Comparison, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All query contigs, and what was found for those with a mapping."""
    placed = result.fragments.select("query_id", "fragment_id", F.col("contig_id").alias("query_contig"))
    every = contigs.select(F.col("file_id").alias("query_id"), F.col("contig_id").alias("query_contig"), "name")
    return eligible_contigs(result.fragments, every), found_contigs(result.best.join(placed, ["query_id", "fragment_id"]))
