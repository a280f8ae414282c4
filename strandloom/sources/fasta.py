"""FASTA sources: files, plain or gzipped, and standard input, as a DataFrame of contigs."""

from __future__ import annotations

import gzip
import io
import sys
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

from strandloom.params import Genome, ParameterError, is_stdin
from strandloom.session import share_code

CONTIGS = "file_id int, contig_id int, name string, seq string"
#: Letters of sequence in one Arrow batch; a longer contig is a batch of its own.
BATCH_LETTERS = 16_000_000
#: A task reads one file, or several if there are more than so many.
MOST_TASKS = 20_000


def is_gzip_name(path: str) -> bool:
    return path.lower().endswith((".gz", ".bgz"))


def parse_fasta(lines: Iterable[bytes]) -> Iterator[tuple[str, str]]:
    """(name, sequence) of every record; the name is the header up to the first blank, white space in sequences is
    skipped, bytes that are no UTF-8 are replaced. One record is held at a time."""
    name: str | None = None
    sequence = bytearray()
    for line in lines:
        if line.startswith(b">"):
            if name is not None:
                yield name, sequence.decode("ascii", "replace")
            header = line[1:].strip().split(None, 1)
            name, sequence = (header[0].decode("utf-8", "replace") if header else ""), bytearray()
        elif name is not None:
            sequence += line.translate(None, _BLANKS)
        elif line.strip():
            raise ValueError("a FASTA record begins with '>'")
    if name is not None:
        yield name, sequence.decode("ascii", "replace")


_BLANKS = b" \t\r\n\v\f"


def opened(path: str) -> BinaryIO:
    """A file of this machine, or of any other place that an address names, as a stream."""
    if "://" not in path:
        return open(path, "rb")
    system, at = FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_stream(at, compression=None), 2**20)


def _batch(rows: list[tuple[int, int, str, str]], kind: pa.DataType) -> pa.RecordBatch:
    file, contig, name, seq = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(file, kind), pa.array(contig, pa.int32()), pa.array(name, pa.string()), pa.array(seq, pa.string())],
        names=["file_id", "contig_id", "name", "seq"],
    )


def _parsed(batches: Iterator[pa.RecordBatch], side: str) -> Iterator[pa.RecordBatch]:
    """The last column is the path of a file, which is read as it is parsed, or all that is in it."""
    for batch in batches:
        kind = batch.schema.field(0).type
        for file, label, packed, content in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            rows, letters = [], 0
            try:
                with opened(content) if isinstance(content, str) else io.BytesIO(content) as stream:
                    for number, (name, seq) in enumerate(parse_fasta(gzip.GzipFile(fileobj=stream) if packed else stream)):
                        rows.append((file, number, name, seq))
                        letters += len(seq)
                        if letters > BATCH_LETTERS:
                            yield _batch(rows, kind)
                            rows, letters = [], 0
            except (ValueError, OSError, EOFError) as error:
                raise ValueError(f"failed to read FASTA record from {side} {label}: {error}") from error
            if rows:
                yield _batch(rows, kind)


def contigs_of_files(files: DataFrame, side: str) -> DataFrame:
    """(file_id, contig_id, name, seq) of files given as (file_id, label, packed, content), where content is a file's bytes
    or its path; works on streams as well."""
    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "label", "packed", "content").mapInArrow(
        lambda batches: _parsed(batches, side), CONTIGS.replace("file_id int", f"file_id {kind}")
    )


def read_contigs(spark: SparkSession, genomes: tuple[Genome, ...], side: str) -> DataFrame:
    """(file_id, contig_id, name, seq): the records of all genomes. file_id is a genome's place in the list,
    contig_id a record's place in its file; the same file may be listed more than once. A file is read within one task,
    as a stream: what a task holds is a record, and some small ones. A record has less than 2^31 letters.

    Standard input is read by the driver, which it must fit; gzip is told by its first bytes there, by the name else.
    """
    share_code(spark)
    if not genomes:
        return spark.createDataFrame([], CONTIGS)
    files = [(n, g.label, is_gzip_name(g.path), g.path) for n, g in enumerate(genomes) if not is_stdin(g.path)]
    piped = [(n, g) for n, g in enumerate(genomes) if is_stdin(g.path)]
    parts = []
    if files:
        manifest = spark.createDataFrame(
            [(n, label, packed, path if "://" in path else str(Path(path).absolute())) for n, label, packed, path in files],
            "file_id int, label string, packed boolean, content string",
        )
        parts.append(contigs_of_files(manifest.repartition(min(len(files), MOST_TASKS)), side))
    for n, genome in piped:
        data = sys.stdin.buffer.read()
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        try:
            records = [(n, i, name, seq) for i, (name, seq) in enumerate(parse_fasta(io.BytesIO(data)))]
        except ValueError as error:
            raise ParameterError(f"failed to read FASTA record from {side} {genome.label}: {error}") from error
        parts.append(spark.createDataFrame(records, CONTIGS))
    contigs = parts[0]
    for part in parts[1:]:
        contigs = contigs.unionByName(part)
    return contigs
