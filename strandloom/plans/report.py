"""The tables a run writes. Text is formatted here, digit by digit as Python rounds, not by SQL."""

from __future__ import annotations

import math
import resource
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import TYPE_CHECKING, TextIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.summary import run_summary, with_every_file
from strandloom.session import materialize, shared_folder, slices_of

if TYPE_CHECKING:
    from strandloom.params import Parameters
    from strandloom.plans.pipeline import Comparison, Reference

# Column names of the tables.
STATS = ("median_ANI", "stddev", "MAD", "ci_95_upper", "ci_95_lower", "F99", "F80")
PAIR_COLUMNS = ("query_file", "reference_file", "ANI", "AF", "total_fragments", *STATS)
CONTIG_COLUMNS = ("query_file", "reference_file", "query_contig", "eligible_fragments", "shared_fragments", "shared_bases", "ANI", *STATS)
MAPPING_COLUMNS = (
    "query_file", "reference_file", "query_contig", "reference_contig", "query_fragment_id", "query_start", "query_end",
    "reference_start", "reference_end", "identity", "query_minimizer_count", "reference_minimizer_count", "shared_minimizers",
    "union_minimizers", "jaccard", "fragment_length", "is_reciprocal_best",
)
_STAT_FIELDS = ("median", "stddev", "mad", "ci_95_upper", "ci_95_lower", "f99", "f80")


def number(value: float | None, digits: int) -> str:
    return "NaN" if value is None or math.isnan(value) else f"{value:.{digits}f}"


def _stats(row: dict) -> list[str]:
    return [number(row[f], 3) for f in _STAT_FIELDS]


def contig_tail(name: str | None, eligible: int, fragments: int, bases: int, figures: Iterable[float | None]) -> str:
    """A line of the per-contig table behind its two labels; `figures` are ANI and statistics."""
    return "\t".join([name or "", str(eligible), str(fragments), str(bases), *[number(value, 3) for value in figures]])


def pair_line(row: dict) -> str:
    known = [number(row[f], 3) for f in ("ani", "af")]
    return "\t".join([row["query"], row["reference"], *known, number(row["total_fragments"], 2), *_stats(row)])


def mapping_line(row: dict) -> str:
    start = (row["segment_start"] or 0) + row["reference_start"]
    places = [row["fragment_id"], row["frag_start"], row["frag_end"], start, start + row["fragment_length"]]
    counts = [row[f] for f in ("query_minimizers", "reference_minimizers", "shared", "union_size")]
    return "\t".join(
        [
            row["query"],
            row["reference"],
            row["query_contig"] if row["query_contig"] is not None else "unknown",
            row["reference_contig"] if row["reference_contig"] is not None else str(row["contig_id"]),
            *map(str, places),
            number(row["identity"], 6),
            *map(str, counts),
            number(row["jaccard"], 8),
            str(row["fragment_length"]),
            str(row["is_reciprocal_best"]).lower(),
        ]
    )


def _formatted(rows: DataFrame, line: Callable[[dict], str], kept: list[str]) -> DataFrame:
    """(*kept, line) of rows, formatted where they are."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.array([line(row) for row in batch.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lines], names=[*kept, "line"])

    return rows.mapInArrow(formatted, T.StructType([*[rows.schema[c] for c in kept], T.StructField("line", T.StringType())]))


def lines_of(rows: DataFrame, line: Callable[[dict], str], order: list[str]) -> DataFrame:
    """(line) of rows in this order, formatted where they are."""
    return _formatted(rows.orderBy(*order), line, [])


def write_lines(lines: DataFrame, path: str | None, stdout: TextIO, header: list[str] | None = None) -> None:
    """Write ordered lines behind a header. To a file, tasks write parts into the shared folder and the driver only joins their
    bytes; to standard output lines come through the driver, a partition at a time."""
    above = "".join(f"{text}\n" for text in header or [])
    if path is None:
        stdout.write(above)
        for row in lines.toLocalIterator():
            print(row.line, file=stdout)
        return
    Path(path).write_text(above)
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.text(folder)
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(settings)
    out = jvm.java.io.FileOutputStream(str(Path(path).absolute()), True)
    try:
        for name in sorted(status.getPath().getName() for status in files.listStatus(at)):
            if name.startswith("part-"):
                part = files.open(jvm.org.apache.hadoop.fs.Path(at, name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, settings, False)
                part.close()
    finally:
        out.close()
        files.delete(at, True)


def named(rows: DataFrame, p: Parameters, reference: Reference) -> DataFrame:
    """Rows with the labels of their query and their reference file."""
    spark = rows.sparkSession
    queries = spark.createDataFrame([(i, g.label) for i, g in enumerate(p.queries)], "query_id int, query string")
    return rows.join(queries, "query_id").join(reference.files.select("file_id", F.col("label").alias("reference")), "file_id")


def mapping_lines(p: Parameters, flagged: DataFrame, result: Comparison, reference: Reference, contigs: DataFrame) -> DataFrame:
    """One line for every mapping, in output order."""
    fragments = result.fragments.select("query_id", "fragment_id", F.col("contig_id").alias("query_contig_id"), "frag_start", "frag_end")
    query_names = contigs.select(F.col("file_id").alias("query_id"), F.col("contig_id").alias("query_contig_id"), F.col("name").alias("query_contig"))
    reference_names = reference.contigs.select("contig_id", "shard", F.col("name").alias("reference_contig"), "segment_start")
    rows = (
        flagged.join(fragments, ["query_id", "fragment_id"])
        .join(query_names, ["query_id", "query_contig_id"], "left")
        .join(reference_names, "contig_id", "left")
    )
    return lines_of(named(rows, p, reference), mapping_line, ["query_id", "shard", "fragment_id", "contig_id", "reference_start"])


def pair_lines(p: Parameters, result: Comparison, reference: Reference) -> DataFrame:
    return lines_of(named(result.pairs, p, reference), pair_line, ["query_id", "file_id"])


# What a row of the per-contig table is, in the order of a query's lines: the first three are lines of their own, contigs give a line
# for each reference file, and found ones take the place of such a line.
_SUMMARY_HEADER, _SUMMARY, _HEADER, _CONTIG, _FOUND = range(5)
_FIGURES = ("ani", *_STAT_FIELDS)
#: Lines that a task makes, and that are made at a time.
TASK_LINES, BATCH_LINES = 1_000_000, 50_000


def _head_line(row: dict) -> str:
    if row["kind"] == _SUMMARY_HEADER:
        return "\t".join(["# aggregate_summary_header", *PAIR_COLUMNS])
    return "\t".join(CONTIG_COLUMNS) if row["kind"] == _HEADER else f"# aggregate_summary\t{pair_line(row)}"


def plan_lines(contigs: list[tuple[int, int]], files: int, most: int) -> list[tuple[int, int, int, int]]:
    """(query, first file, end, task) of the parts of a table with a line for every contig and file, in order, from (query,
    number of contigs). A task has up to `most` lines, one of a file's summary included; only between files a query is parted."""
    parts, task, filled = [], 0, 0
    for query, count in contigs:
        at = 0
        while True:
            fits = (most - filled) // (count + 1)
            if fits < 1 and filled:
                task, filled = task + 1, 0
                continue
            end = min(files, at + max(1, fits))
            parts.append((query, at, end, task))
            filled += (end - at) * (count + 1)
            at = end
            if at >= files:
                break
    return parts


def _line_batch(lines: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lines], names=["line"])


class _Part:
    """The lines of a query's contigs for the reference files from `at` to `end`."""

    def __init__(self, query: str, at: int, end: int) -> None:
        self.query, self.at, self.end = query, at, end
        self.known: list[tuple[str | None, int]] = []
        self.places: dict[int, int] = {}
        self.tails: list[bytes] = []
        self.found: dict[int, dict[int, bytes]] = {}

    def add_contig(self, contig: int, name: str | None, eligible: int) -> None:
        self.places[contig] = len(self.tails)
        self.known.append((name, eligible))
        self.tails.append(contig_tail(name, eligible, 0, 0, [None] * len(_FIGURES)).encode())

    def add_found(self, file: int, contig: int, fragments: int, bases: int, figures: Iterable[float | None]) -> None:
        place = self.places.get(contig)
        if place is not None:
            self.found.setdefault(file, {})[place] = contig_tail(*self.known[place], fragments, bases, figures).encode()

    @property
    def step(self) -> int:
        return max(1, BATCH_LINES // max(1, len(self.tails)))

    def lines_to(self, end: int, labels: list[str]) -> Iterator[pa.RecordBatch]:
        """The lines of the files before `end` that were not yet made; all that was found for them must be known."""
        widths = np.array([len(t) for t in self.tails], np.int64)
        while self.at < end:
            files = range(self.at, min(end, self.at + self.step))
            heads = [f"{self.query}\t{labels[f]}\t".encode() for f in files]
            for a in range(0, len(self.tails), BATCH_LINES):
                own = self.tails[a : a + BATCH_LINES]
                sizes = np.add.outer(np.array([len(h) for h in heads], np.int64), widths[a : a + BATCH_LINES])
                texts = []
                for n, (file, head) in enumerate(zip(files, heads, strict=True)):
                    rows = own
                    if file in self.found:
                        rows = own.copy()
                        for place, tail in self.found[file].items():
                            if a <= place < a + len(own):
                                rows[place - a], sizes[n, place - a] = tail, len(head) + len(tail)
                    texts += head, head.join(rows)
                ends = np.zeros(sizes.size + 1, np.int32)
                np.cumsum(sizes.ravel(), out=ends[1:])
                yield _line_batch(pa.StringArray.from_buffers(sizes.size, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))))
            for file in files:
                self.found.pop(file, None)
            self.at = files.stop


def _table_lines(batches: Iterator[pa.RecordBatch], queries: dict[int, str], labels: list[str]) -> Iterator[pa.RecordBatch]:
    """The lines of sorted rows; what a part holds are its contigs and what was found for the files that are next."""
    part, key, ready = None, None, []
    for batch in batches:
        for query, first, end, kind, place, line, contig, name, eligible, fragments, bases, *figures in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (query, first):
                if part is not None:
                    yield from part.lines_to(part.end, labels)
                part, key = _Part(queries[query], first, end), (query, first)
            if ready and (kind >= _CONTIG or len(ready) >= BATCH_LINES):
                yield _line_batch(pa.array(ready, pa.string()))
                ready = []
            if kind == _CONTIG:
                part.add_contig(contig, name, eligible)
            elif kind == _FOUND:
                if place - part.at >= part.step:
                    yield from part.lines_to(place, labels)
                part.add_found(place, contig, fragments, bases, figures)
            else:
                if part.tails:
                    raise ValueError("a query's heads come before its contigs")
                ready.append(line)
    if ready:
        yield _line_batch(pa.array(ready, pa.string()))
    if part is not None:
        yield from part.lines_to(part.end, labels)


def contig_table(queries: dict[int, str], files: list[tuple[int, str]], contigs: DataFrame, found: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(line) for every query, reference file and contig of the query, in this order, behind the query's `heads`.

    `queries` has labels, `files` the ids with labels, in order. `contigs` has query_id, query_contig, name, eligible_fragments;
    `found` those (query_id, file_id, query_contig) of which there is more to say; `heads` query_id, kind, file_id, line.

    The table is as large as queries' contigs times files. It is neither joined nor sorted: only contigs and what was found are
    brought to the task whose part of the table they belong to, and the task makes the lines in order. One count per query
    reaches the driver, which plans the parts.
    """
    spark = contigs.sparkSession
    contigs = materialize(contigs.select("query_id", "query_contig", "name", F.col("eligible_fragments").cast("long").alias("eligible_fragments")))
    counts = {r.query_id: r["count"] for r in contigs.groupBy("query_id").count().collect()}
    sizes = [(query, counts.get(query, 0)) for query in sorted(queries)]
    lines = sum(count + 1 for _, count in sizes) * len(files)
    parts = plan_lines(sizes, len(files), min(TASK_LINES, max(BATCH_LINES, -(-lines // slices_of(spark)))))
    plan = F.broadcast(spark.createDataFrame(parts, "query_id int, first int, end int, task int"))
    places = F.broadcast(spark.createDataFrame([(file, n) for n, (file, _) in enumerate(files)], "file_id long, place int"))
    own = ["task", "query_id", "first", "end", "kind", "place"]
    rows = contigs.join(plan, "query_id").withColumn("kind", F.lit(_CONTIG)).withColumn("place", F.lit(None).cast("int"))
    placed = found.join(places, "file_id").join(plan, "query_id").filter("place >= first AND place < end AND query_contig IS NOT NULL").withColumn("kind", F.lit(_FOUND))
    placed = placed.select(*own, "query_contig", *[F.col(c).cast("long").alias(c) for c in ("shared_fragments", "shared_bases")], *_FIGURES)
    rows = rows.unionByName(placed, allowMissingColumns=True)
    if heads is None:
        rows = rows.withColumn("line", F.lit(None).cast("string"))
    else:
        above = heads.join(plan.filter("first = 0"), "query_id").join(places, "file_id", "left")
        rows = rows.unionByName(above.select(*own, "line"), allowMissingColumns=True)
    table = ["query_id", "first", "end", "kind", "place", "line", "query_contig", "name", "eligible_fragments", "shared_fragments", "shared_bases", *_FIGURES]
    dealt = rows.repartitionById(max((task for *_, task in parts), default=0) + 1, F.col("task"))
    ordered = dealt.sortWithinPartitions("query_id", "first", "kind", "place", "query_contig").select(*table)
    labels = [label for _, label in files]
    return ordered.mapInArrow(lambda batches: _table_lines(batches, queries, labels), "line string")


def contig_lines(p: Parameters, result: Comparison, reference: Reference, contigs: DataFrame) -> DataFrame:
    """For each query a comment block with all references, then a line for every reference and contig; one header."""
    from strandloom.plans.pipeline import contigs_of

    spark = contigs.sparkSession
    queries = spark.createDataFrame([(i,) for i in range(len(p.queries))], "query_id int")
    total = F.coalesce("mapped_length", F.lit(0)) / F.lit(float(p.fragment_length))
    sized = queries.join(result.queries.select("query_id", "mapped_length"), "query_id", "left").select("query_id", total.alias("total_fragments"))
    every = with_every_file(sized, reference.files).join(result.pairs.drop("total_fragments"), ["query_id", "file_id"], "left")
    nothing = F.when((F.col("total_fragments") > 0) & F.col("ani").isNull(), 0.0)
    summaries = named(every.withColumn("af", F.coalesce("af", nothing)), p, reference).withColumn("kind", F.lit(_SUMMARY))
    heads = queries.withColumn("kind", F.lit(_SUMMARY_HEADER))
    if p.header:
        heads = heads.union(spark.createDataFrame([(0, _HEADER)], "query_id int, kind int"))
    above = _formatted(summaries.unionByName(heads, allowMissingColumns=True), _head_line, ["query_id", "kind", "file_id"])
    files = [(r.file_id, r.label) for r in reference.files.select("file_id", "label").orderBy("file_id").collect()]  # one row per reference file
    return contig_table({i: g.label for i, g in enumerate(p.queries)}, files, *contigs_of(result, contigs), above)


def write_all(p: Parameters, result: Comparison, reference: Reference, contigs: DataFrame, stdout: TextIO) -> Row:
    """Write the results and, if asked for, the mapping stats; returns the row that sums up the pairs."""
    from strandloom.plans.pipeline import mapping_flags

    if p.mapping_stats is not None:
        write_lines(mapping_lines(p, mapping_flags(result, p), result, reference, contigs), p.mapping_stats, stdout, ["\t".join(MAPPING_COLUMNS)])
    if p.per_contig:
        write_lines(contig_lines(p, result, reference, contigs), p.out, stdout)
    else:
        write_lines(pair_lines(p, result, reference), p.out, stdout, ["\t".join(PAIR_COLUMNS)] if p.header else None)
    return run_summary(result.pairs).first()


def memory_gib() -> float:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 2**20


def summary_line(p: Parameters, summed: Row, regions: int, reference: Reference, seconds: dict[str, float], total: float) -> str:
    """The closing line: counts, the range of identities and aligned fractions, the driver's memory, and the time of the phases."""
    facts = {
        "stage": "execution",
        "event": "complete",
        "queries": len(p.queries),
        "references": reference.files.count(),
        "total_runtime_s": number(total, 3),
        "peak_rss_gib": number(memory_gib(), 3),
        "emitted_pairs": summed.emitted_pairs,
        "candidate_regions": regions,
        **{f: number(summed[f], 3) for f in ("ani_min", "ani_max", "af_min", "af_max")},
        **{f"{phase}_s": number(seconds[phase], 3) for phase in ("reference_build", "mapping", "query_collect", "candidate_discovery")},
    }
    return "SUMMARY\t" + "\t".join(f"{k}={v}" for k, v in facts.items())


def metrics_lines(merged: dict[str, int], bins: list[Row]) -> list[str]:
    """The counters of a run, and how many keys of the index have how many hits."""
    counted = "METRICS\t" + "\t".join(f"{k}={v}" for k, v in merged.items())
    return [counted, *[f"SEED_HIT_BIN\tup_to={'inf' if r.bin is None else r.bin}\tkeys={r['keys']}\thits={r.hits}" for r in bins]]
