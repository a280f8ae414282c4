"""Splitting oversized items at natural boundaries, by agglomerative merging.

An item is a range of positions that is parted to atoms. All adjacent atoms are held in a heap by the strength of the
boundary between them, and merged, the weakest boundary first, while the merged atoms together with their overlap fit.

Texts have boundaries of five strengths: the ends of paragraphs, lines, sentences and words, and any place within a word.
An atom is refined by weaker boundaries only if it does not fit itself: the weaker ones inside an atom that fits would
all be merged away before any stronger one is looked at.

Fragments of a sequence have runs of letters that part them, whatever they contain: boundaries of infinite strength. The
stretches between these are atomic as long as they keep to the limit. A longer one is cut into atoms of `stride`
positions, whose pieces reach `overlap = limit - stride` positions into what follows. All its boundaries are of one
strength, and two whole atoms never fit, so there merging decides about the last atoms only; the rest is windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that the runs of a contig are gathered by: a fragment meets few of these parts, however long its contig is.
PART = 2**16
#: Boundaries of a text from the strongest to the weakest; each is the place behind what it matches.
PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 5.0, 4.0, 3.0, 2.0, 1.0
BOUNDARIES = (
    (PARAGRAPH, regex.compile(r"\n\s*\n")),
    (LINE, regex.compile(r"\n")),
    (SENTENCE, regex.compile(r"[.!?]+\s+")),
    (WORD, regex.compile(r"\s+")),
)


def merge_atoms(edges: list[int], strengths: list[float], fits: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Merge the atoms [edges[i], edges[i+1]) across their inner boundaries, weakest first and from the left among
    equals, wherever `fits(start, end)` holds for the merged range; the ranges that are left, in order.

    strengths[i] belongs to the boundary at edges[i + 1]. A merge that does not fit now never will, as ranges only
    grow, so each boundary leaves the heap once: n log n steps.
    """
    left = {b: a for a, b in zip(edges, edges[1:])}  # end of a range -> its start
    right = {a: b for a, b in zip(edges, edges[1:])}  # start of a range -> its end
    heap = [(s, at) for s, at in zip(strengths, edges[1:-1], strict=True) if s != float("inf")]
    heapq.heapify(heap)
    while heap:
        _, at = heapq.heappop(heap)
        start, end = left[at], right[at]
        if fits(start, end):
            del left[at], right[at]
            left[end], right[start] = start, end
    return sorted(right.items())


def atoms_of(text: str, most: int, boundaries=BOUNDARIES) -> tuple[list[int], list[float]]:
    """The edges of the atoms of a text, each of `most` letters at most, and the strengths of the inner ones."""
    edges, strengths = [0], []

    def refine(start: int, end: int, level: int) -> None:
        if end - start <= most:
            edges.append(end)
        elif level == len(boundaries):
            for at in range(start + most, end, most):
                edges.append(at)
                strengths.append(INSIDE)
            edges.append(end)
        else:
            strength, pattern = boundaries[level]
            for found in pattern.finditer(text, start, end):
                if start < found.end() < end:
                    refine(start, found.end(), level + 1)
                    strengths.append(strength)
                    start = found.end()
            refine(start, end, level + 1)

    refine(0, len(text), 0)
    return edges, strengths


def split_text(text: str, limit: int, overlap: int, boundaries=BOUNDARIES) -> list[tuple[int, int]]:
    """The pieces of a text, of at most `limit` letters, each reaching `overlap` letters into the one behind it."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    edges, strengths = atoms_of(text, limit - overlap, boundaries)
    runs = merge_atoms(edges, strengths, lambda a, b: min(b + overlap, n) - a <= limit)
    return [(a, min(b + overlap, n)) for a, b in runs]


def split_stretch(start: int, end: int, limit: int, stride: int, least: int) -> list[tuple[int, int]]:
    """The pieces of one stretch without breaks, of at least `least` and at most `limit` positions each."""
    if end - start < least or end <= start:
        return []
    if end - start <= limit:
        return [(start, end)]
    overlap = limit - stride
    edges = [*range(start, end, stride), end]

    def fits(a: int, b: int) -> bool:
        # at the stretch's end there is less to overlap with; a range that fills the limit by itself stays apart
        return min(b + overlap, end) - a < limit

    # all boundaries inside a stretch are equally weak
    runs = merge_atoms(edges, [0.0] * (len(edges) - 2), fits)
    pieces = [(a, min(b + overlap, end)) for a, b in runs]
    return [(a, b) for a, b in pieces if b - a == limit or (b == end and b - a >= least)]


def split_range(
    start: int, end: int, breaks: list[tuple[int, int]], limit: int, stride: int, least: int, least_break: int
) -> list[tuple[int, int]]:
    """The pieces of [start, end); `breaks` are ordered and disjoint, and those of at least `least_break` positions
    inside the range part it (none does if `least_break` is 0). Breaks that touch are one."""
    if least_break > 0:
        whole: list[tuple[int, int]] = []
        for a, b in breaks:
            if whole and whole[-1][1] == a:
                a = whole.pop()[0]
            whole.append((a, b))
        inside = [(max(a, start), min(b, end)) for a, b in whole]
        inside = [(a, b) for a, b in inside if b - a >= least_break]
    else:
        inside = []
    starts, ends = [start, *[b for _, b in inside]], [*[a for a, _ in inside], end]
    return [p for a, b in zip(starts, ends, strict=True) for p in split_stretch(a, b, limit, stride, least)]


def _runs_of(batches: Iterator[pa.RecordBatch], letters: bytes) -> Iterator[pa.RecordBatch]:
    wanted = np.zeros(256, bool)
    wanted[list(letters)] = True
    for batch in batches:
        owner, size, part, starts, ends = [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            # one byte a letter, so that places are letters; whatever is beyond ASCII is no wanted letter
            codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8) if text else np.zeros(0, np.uint8)
            for at in range(0, len(codes), PART):
                hit = np.zeros(min(PART, len(codes) - at) + 2, np.int8)
                hit[1:-1] = wanted[codes[at : at + PART]]
                change = np.flatnonzero(np.diff(hit)) + at
                owner.append(row)
                size.append(len(codes))
                part.append(at // PART)
                starts.append(change[0::2])
                ends.append(change[1::2])
        kept = [batch.column(i).take(pa.array(owner, type=pa.int64())) for i in range(batch.num_columns - 1)]
        numbers = [pa.array(x, type=pa.int64()) for x in (size, part)]
        lists = [pa.array(x, type=pa.list_(pa.int64())) for x in (starts, ends)]
        yield pa.RecordBatch.from_arrays([*kept, *numbers, *lists], names=[*batch.schema.names[:-1], "letters", "part", "run_starts", "run_ends"])


def letter_runs(df: DataFrame, keys: list[str], text: str, letters: str) -> DataFrame:
    """(*keys, letters, part, run_starts, run_ends): length of the text and, for every part of PART letters of it, the
    maximal runs there of any of `letters` (ASCII). A run that reaches into the next part is cut where that begins.

    A null or an empty text has no parts. The text itself does not leave the task.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    schema = f"{fields}, letters long, part long, run_starts array<long>, run_ends array<long>"
    code = letters.encode("ascii")
    return df.select(*keys, F.col(text).alias("text")).mapInArrow(lambda batches: _runs_of(batches, code), schema)


def _split_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        table = batch.to_pydict()
        for item, a, b, limit, stride, least, least_break, run_starts, run_ends in zip(
            *[table[k] for k in ("item", "start", "end", "limit", "stride", "least", "least_break", "run_starts", "run_ends")],
            strict=True,
        ):
            for s, e in split_range(a, b, list(zip(run_starts, run_ends, strict=True)), limit, stride, least, least_break):
                ids.append(item)
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, type=pa.int64()) for x in (ids, starts, ends)], names=["item", "piece_start", "piece_end"]
        )


def split_oversized(items: DataFrame) -> DataFrame:
    """(item, piece_start, piece_end): the pieces of every item.

    `items` has item (a unique long), start, end (half-open positions), limit, stride, least (the smallest piece
    worth keeping), least_break, and run_starts, run_ends (arrays: the runs of breaking letters, in order). Rows
    with a null in item, start, end, limit, stride or least, with limit or stride below 1, or stride above limit, give
    nothing, and neither does an item without positions. Arrays that are null or not of one size are no runs, a null least_break is 0. Further
    columns are ignored. Every item is split on its own; its rows are not repeated here.
    """
    nothing = F.array().cast("array<long>")
    paired = F.size("run_starts") == F.size("run_ends")
    rows = items.select(
        *[F.col(c).cast("long").alias(c) for c in ("item", "start", "end", "limit", "stride", "least")],
        F.coalesce(F.col("least_break").cast("long"), F.lit(0)).alias("least_break"),
        F.when(paired, F.col("run_starts")).otherwise(nothing).alias("run_starts"),
        F.when(paired, F.col("run_ends")).otherwise(nothing).alias("run_ends"),
    ).filter("item IS NOT NULL AND start < end AND limit >= 1 AND stride BETWEEN 1 AND limit AND least IS NOT NULL")
    return rows.mapInArrow(_split_all, "item long, piece_start long, piece_end long")


def oversized_fragments(fragments: DataFrame, genomes: DataFrame, params: DataFrame) -> DataFrame:
    """Fragments that span more letters than their query's settings allow, each once, with those settings.

    A fragment with a null id, query, start or end is none of them; neither is one whose query or settings are
    unknown. The two dimension tables are joined as small or as large as they are (the planner reads their sizes).
    """
    settings = (
        genomes.filter("side = 'query' AND params_id IS NOT NULL")
        .groupBy("file_id")
        .agg(F.min("params_id").alias("params_id"))
        .join(params.dropDuplicates(["params_id"]), "params_id")
        .select(
            F.col("file_id").alias("query_id"),
            F.col("fragment_length").alias("limit"),
            F.col("fragment_stride").alias("stride"),
            F.col("min_fragment_length").alias("least"),
            F.col("split_n_run").alias("least_break"),
        )
    )
    spans = fragments.select("query_id", "fragment_id", "contig_id", "frag_start", "frag_end").filter(
        "fragment_id IS NOT NULL AND frag_start < frag_end"
    )
    return (
        spans.join(settings, "query_id")
        .filter(F.col("frag_end") - F.col("frag_start") > F.col("limit"))
        .dropDuplicates(["fragment_id"])
    )


def split_fragments(fragments: DataFrame, contigs: DataFrame, genomes: DataFrame, params: DataFrame) -> DataFrame:
    """(fragment_id, piece_start, piece_end) of the oversized fragments, cut at their contig's runs of N.

    Only the places of the runs are joined to the fragments, never the sequences, and of these the ones in the parts of
    the contig that a fragment reaches over. A fragment is clipped to its contig's letters; one whose contig is
    missing, null or empty has no letters and gives nothing.
    """
    oversized = oversized_fragments(fragments, genomes, params)
    whole = contigs.filter("side = 'query' AND length(seq) > 0")
    runs = letter_runs(whole, ["file_id", "contig_id"], "seq", "Nn").dropDuplicates(["file_id", "contig_id", "part"])
    runs = runs.withColumnRenamed("file_id", "query_id")
    parts = F.sequence(F.floor(F.greatest("frag_start", F.lit(0)) / PART), F.floor((F.col("frag_end") - 1) / PART))
    reached = oversized.filter("frag_end > 0").withColumn("part", F.explode(parts))
    settings = ["limit", "stride", "least", "least_break"]
    gathered = (
        reached.join(runs, ["query_id", "contig_id", "part"])
        .groupBy("fragment_id", "frag_start", "frag_end", *settings)
        .agg(F.max("letters").alias("letters"), F.array_sort(F.collect_list(F.struct("part", "run_starts", "run_ends"))).alias("parts"))
    )
    items = gathered.select(
        F.col("fragment_id").alias("item"),
        F.greatest("frag_start", F.lit(0)).alias("start"),
        F.least("frag_end", "letters").alias("end"),
        *settings,
        *[F.flatten(F.col(f"parts.{c}")).alias(c) for c in ("run_starts", "run_ends")],
    )
    return split_oversized(items).withColumnRenamed("item", "fragment_id")


def _split_texts(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, nth, starts, ends = [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            pieces = split_text(text or "", limit, overlap)
            rows += [row] * len(pieces)
            nth += range(len(pieces))
            starts += [a for a, _ in pieces]
            ends += [b for _, b in pieces]
        numbers = [pa.array(x, type=pa.int64()) for x in (nth, starts, ends)]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, type=pa.int64())), *numbers], names=["id", "piece", "piece_start", "piece_end"])


def split_texts(df: DataFrame, doc_id: str, text: str, limit: int, overlap: int) -> DataFrame:
    """(doc_id, piece, piece_start, piece_end): every text as pieces of at most `limit` letters, in order, cut at the
    ends of paragraphs, lines, sentences or words where possible. A piece ends `overlap` letters behind where the next
    one starts, less at the end of the text; all together cover the text.

    A null or an empty text has no piece, one of at most `limit` letters is one. Rows are split each for itself,
    repeated ones and those with a null id included; an empty table gives no rows; further columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    schema = T.StructType([T.StructField("id", df.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("piece", "piece_start", "piece_end")]])
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _split_texts(batches, limit, overlap), schema).withColumnRenamed("id", doc_id)
