"""Minimizer sketches of reference segments and of query fragments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.dna import joined_codes, minimizers_of_all, sketches_of_ranges
from strandloom.operators.segments import fragment_ranges, n_free_ranges
from strandloom.session import broadcast_if_small, materialize

#: Letters whose minimizers are computed at a time.
AT_A_TIME = 2_000_000


def chunks_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    texts = batch.column(column).to_pylist()
    at, letters = 0, 0
    for k, text in enumerate(texts):
        letters += len(text or "")
        if letters >= AT_A_TIME or k == len(texts) - 1:
            yield batch.slice(at, k + 1 - at), texts[at : k + 1]
            at, letters = k + 1, 0


def _positioned(batches: Iterator[pa.RecordBatch], k: int, w: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks_of(batch, "seq"):
            owner, position, key = minimizers_of_all(texts, k, w, seed)
            order = np.lexsort((position, owner))
            rows = pa.array(owner[order])
            kept = [c.take(rows) for c in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(key[order]), pa.array(position[order])], names=[*part.schema.names[:-1], "key", "pos"]
            )


def reference_minimizers(segments: DataFrame, keys: list[str], k: int, w: int, seed: int) -> DataFrame:
    """(*keys, key, pos): every minimizer of every sequence in `seq`, by position; null sequences have none."""
    rows = segments.select(*keys, "seq")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("key", T.LongType()), T.StructField("pos", T.LongType())])
    return rows.mapInArrow(lambda batches: _positioned(batches, k, w, seed), schema)


def _sketched(
    batches: Iterator[pa.RecordBatch], k: int, w: int, seed: int, length: int, stride: int, least: int, n_run: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks_of(batch, "seq"):
            codes, offsets = joined_codes(texts)
            contig, segment, start, end = [], [], [], []
            for row, text in enumerate(texts):
                for low, high in n_free_ranges(text or "", n_run):
                    ranges = fragment_ranges(high - low, length, stride, least)
                    contig += [row] * len(ranges)
                    segment += [low] * len(ranges)
                    start += [low + a for a, _ in ranges]
                    end += [low + b for _, b in ranges]
            contig, segment, start, end = (np.array(x, np.int64) for x in (contig, segment, start, end))
            owner, key = sketches_of_ranges(codes, start + offsets[contig], end + offsets[contig], k, w, seed)
            used, size = np.unique(owner, return_counts=True)  # fragments without minimizers drop out here
            sketches = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(key))
            contig = contig[used]
            nth = np.arange(len(used)) - np.searchsorted(contig, contig)
            kept = [c.take(pa.array(contig)) for c in part.columns[:-1]]
            own = [pa.array(x) for x in (nth, segment[used], start[used], end[used])]
            names = [*part.schema.names[:-1], "nth", "segment_start", "frag_start", "frag_end", "minimizers"]
            yield pa.RecordBatch.from_arrays([*kept, *own, sketches], names=names)


def fragment_sketches(
    contigs: DataFrame, keys: list[str], *, k: int, w: int, seed: int, length: int, stride: int, least: int, n_run: int
) -> DataFrame:
    """(*keys, nth, segment_start, frag_start, frag_end, minimizers): the fragments of every sequence in `seq` that have
    minimizers, counted from 0 within the sequence, with their distinct keys, ascending.

    Sequences are split at long runs of N and cut to fragments where they are; only sketches leave the task.
    """
    rows = contigs.select(*keys, "seq")
    own = T.StructType.fromDDL("nth long, segment_start long, frag_start long, frag_end long, minimizers array<long>")
    schema = T.StructType([*rows.schema.fields[:-1], *own.fields])
    return rows.mapInArrow(lambda batches: _sketched(batches, k, w, seed, length, stride, least, n_run), schema)


def seeds(minimizers: str, count: int | None):
    """The first `count` keys of an ascending sketch; all of them without a count."""
    return F.col(minimizers) if count is None else F.slice(minimizers, 1, count)


def query_fragments(
    contigs: DataFrame, *, k: int, w: int, seed: int, length: int, stride: int, least: int, n_run: int, minmers: int | None = None
) -> DataFrame:
    """The fragments of query contigs (query_id, contig_id, seq) with their sketches.

    Columns: query_id, fragment_id, contig_id, frag_start, frag_end, length, minimizers, seeds. A fragment without
    minimizers is dropped before numbering. fragment_id counts from 0 within a query by contig and start: its place
    within the contig plus the counts of the contigs before, a table of one row per contig. The sketches are written
    once and not shuffled.
    """
    keys = ["query_id", "contig_id"]
    shape = {"k": k, "w": w, "seed": seed, "length": length, "stride": stride, "least": least, "n_run": n_run}
    sketched = materialize(fragment_sketches(contigs, keys, **shape))
    counts = sketched.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("query_id").orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return sketched.join(broadcast_if_small(bases), keys).select(
        "query_id",
        (F.col("_base") + F.col("nth")).alias("fragment_id"),
        "contig_id",
        "frag_start",
        "frag_end",
        (F.col("frag_end") - F.col("frag_start")).alias("length"),
        "minimizers",
        seeds("minimizers", minmers).alias("seeds"),
    )


def query_totals(fragments: DataFrame) -> DataFrame:
    """(query_id, fragments, mapped_length, minimizers, seeds) over the kept fragments of each query."""
    return fragments.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("fragments"),
        F.sum("length").alias("mapped_length"),
        F.sum(F.size("minimizers").cast("long")).alias("minimizers"),
        F.sum(F.size("seeds").cast("long")).alias("seeds"),
    )
