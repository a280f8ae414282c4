"""Reference sketches that grow with a folder of FASTA files, as a structured stream.

Each file is read once, when it appears, and its minimizers are appended to a Parquet table; the query's checkpoint
makes that exactly once over restarts and lost executors. A file is known by the hash of its path, so ids do not
depend on the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.segments import split_on_n
from strandloom.operators.sketch import reference_minimizers
from strandloom.session import share_code
from strandloom.sources.fasta import contigs_of_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def contig_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file_id, contig_id, name, seq): the contigs of the files in a folder, those to come included; one that is
    no FASTA file is an error."""
    share_code(spark)
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    packed = F.lower("path").rlike(r"\.(gz|bgz)$")
    return contigs_of_files(files.select(F.xxhash64("path").alias("file_id"), F.col("path").alias("label"), packed.alias("packed"), "content"), "reference")


def minimizer_stream(contigs: DataFrame, k: int, w: int, seed: int, n_run: int) -> DataFrame:
    """(file_id, contig_id, segment_start, key, pos) of a stream of contigs; nothing is kept between batches."""
    segments = split_on_n(contigs, ["file_id", "contig_id"], n_run)
    return reference_minimizers(segments, ["file_id", "contig_id", "segment_start"], k, w, seed)


def append_minimizers(minimizers: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append all files that are there now to the table and end; to be run again as files come."""
    return minimizers.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(table)
