"""From sequences to segments and fragments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def n_free_ranges(sequence: str, n_run: int) -> list[tuple[int, int]]:
    """The non-empty stretches between runs of at least n_run letters N or n; all in one if n_run is 0."""
    if n_run <= 0:
        return [(0, len(sequence))] if sequence else []
    ranges, at = [], 0
    for run in re.finditer(f"[Nn]{{{n_run},}}", sequence):
        ranges.append((at, run.start()))
        at = run.end()
    ranges.append((at, len(sequence)))
    return [(a, b) for a, b in ranges if b > a]


def fragment_ranges(n: int, length: int, stride: int, least: int) -> list[tuple[int, int]]:
    """The fragments of a sequence of n letters; see `fragment_starts` for the rules, which this follows for kernels."""
    if n < max(least, 1):
        return []
    if n <= length and not stride == length == least:
        return [(0, n)]
    whole = [(at, at + length) for at in range(0, n - length + 1, stride)]
    if stride == length == least:
        return whole
    rest = whole[-1][0] + stride
    if n - rest >= least:
        return [*whole, (rest, n)]
    return [*whole, (n - length, n)] if least == length and whole[-1][1] != n else whole


def _segments(batches: Iterator[pa.RecordBatch], n_run: int, with_seq: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, starts, ends, numbers, parts = [], [], [], [], []
        for row, sequence in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            for number, (a, b) in enumerate(n_free_ranges(sequence or "", n_run)):
                rows.append(row)
                numbers.append(number)
                starts.append(a)
                ends.append(b)
                if with_seq:
                    parts.append(sequence[a:b])
        kept = [c.take(pa.array(rows, type=pa.int64())) for c in batch.columns[:-1]]
        own = [pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
        names = [*batch.schema.names[:-1], "segment", "segment_start", "segment_end"]
        if with_seq:
            own.append(pa.array(parts, pa.string()))
            names.append("seq")
        yield pa.RecordBatch.from_arrays([*kept, *own], names=names)


def split_on_n(contigs: DataFrame, keys: list[str], n_run: int, seq: str = "seq", with_seq: bool = True) -> DataFrame:
    """(*keys, segment, segment_start, segment_end, seq if wanted): the stretches of each sequence between long runs of N.

    Runs shorter than n_run stay within a segment; n_run 0 keeps every sequence whole. A null or empty sequence, or
    one that is all such runs, has no segments.
    """
    rows = contigs.select(*keys, F.col(seq).alias("seq"))
    own = T.StructType.fromDDL("segment int, segment_start long, segment_end long" + ", seq string" * with_seq)
    schema = T.StructType([*rows.schema.fields[:-1], *own.fields])
    return rows.mapInArrow(lambda batches: _segments(batches, n_run, with_seq), schema)


def fragment_starts(n: Column, length: Column | int, stride: Column | int, least: Column | int) -> Column:
    """Array of (start, end) of the fragments of a sequence of n letters.

    Shorter than `least`: none. Stride and least both the length: whole windows only. Not longer than the length: all of
    it. Else windows at multiples of the stride while they fit, and the rest from the next multiple if it has at
    least `least` letters; if it has not and `least` is the length, the last `length` letters instead, unless the
    last window is just that.
    """
    n, long = n.cast("long"), lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    length, stride, least = long(length), long(stride), long(least)
    fits = n >= length
    last = F.when(fits, F.floor((n - length) / stride)).otherwise(F.lit(0)).cast("long")
    windows = F.transform(
        F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct((i * stride).alias("start"), (i * stride + length).alias("end"))
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
    none = F.slice(whole, 1, 0)
    rest = (last + 1) * stride
    tail = F.array(F.struct(rest.alias("start"), n.alias("end")))
    closing = F.array(F.struct((n - length).alias("start"), n.alias("end")))
    strict = (stride == length) & (least == length)
    ending = (
        F.when(n - rest >= least, tail)
        .when((least == length) & (last * stride != n - length), closing)
        .otherwise(none)
    )
    return (
        F.when(n.isNull() | (n < least) | (n <= 0), none)
        .when(strict, windows)
        .when(n <= length, whole)
        .otherwise(F.concat(windows, ending))
    )


def mapped_length(n: Column, length: int, least: int) -> Column:
    """Letters of a sequence that fragments of stride = length cover."""
    return F.aggregate(
        fragment_starts(n, length, length, least), F.lit(0).cast("long"), lambda total, f: total + f["end"] - f["start"]
    )


def window_count(n: Column, k: int, w: int) -> Column:
    """Windows of w k-mers in a sequence of n letters."""
    return F.greatest(n.cast("long") - F.lit(k + w - 1) + 1, F.lit(0).cast("long"))


def minimizer_estimate(n: Column, k: int, w: int) -> Column:
    """Minimizers to be expected: two for every w + 1 windows."""
    return F.ceil(2 * window_count(n, k, w) / F.lit(float(w + 1))).cast("long")
