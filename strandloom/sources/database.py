"""A reference database on disk: an index table by shard, its dimension tables and a manifest.

    <folder>/manifest.json
    <folder>/index/shard=<n>/      key, file_id, contig_id, pos; bucketed and sorted by key
    <folder>/blocks/shard=<n>/     file_id, contig_id, block, at, keys; bucketed by contig and block
    <folder>/contigs/              one row per reference segment
    <folder>/files/                one row per reference file

The large tables are bucketed by what queries join them on, so a comparison shuffles its own fragments and regions but
never the database. The bucketing is declared to the session anew when a database is read.
"""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.params import ParameterError, Parameters

FORMAT = 3
SUFFIXES = (".sketch.zst", ".sketch")
#: Minimizers that a bucket of a shard aims at.
BUCKET_MINIMIZERS = 4_000_000
LARGE = {"index": ("key",), "blocks": ("contig_id", "block")}
#: What a query must have in common with the database it is run against.
BINDING = ("kmer_size", "window_size", "hash_seed", "fragment_length", "min_fragment_length", "split_n_run")


def checksum(labels: list[str]) -> int:
    """64-bit FNV-1a over the labels, each ended by a zero byte."""
    value = 0xCBF29CE484222325
    for byte in b"".join(label.encode() + b"\0" for label in labels):
        value = (value ^ byte) * 0x100000001B3 % 2**64
    return value


def binding_of(p: Parameters) -> dict[str, Any]:
    return {n: p.least if n == "min_fragment_length" else getattr(p, n) for n in BINDING}


def manifest_path(folder: str) -> Path:
    return Path(folder) / "manifest.json"


def exists(folder: str) -> bool:
    return manifest_path(folder).is_file()


def found(folder: str) -> str:
    """Where the database of this name is: there, or else, if the name has no ending, there with one of `SUFFIXES`."""
    if not exists(folder) and not Path(folder).suffix:
        for suffix in SUFFIXES:
            if exists(folder + suffix):
                return folder + suffix
    return folder


def check_contigs(contigs: DataFrame, shards: list[dict[str, Any]]) -> None:
    """The contigs of all shards must be numbered through, each once, or names would go to wrong contigs."""
    counted = contigs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("contig_id").alias("ids"), F.min("contig_id").alias("low"), F.max("contig_id").alias("high")).first()
    wanted = sum(s["contigs"] for s in shards)
    if counted.n != wanted or counted.ids != wanted or (wanted and (counted.low, counted.high) != (0, wanted - 1)):
        raise ParameterError(f"the contigs of the sketch are not numbered from 0 to {wanted - 1}, each once")


def _write_bucketed(df: DataFrame, path: str, keys: tuple[str, ...], buckets: int, codec: str) -> None:
    """Write a table by shard in buckets; its name in the session's catalog is given up again at once."""
    name = f"strandloom_{uuid.uuid4().hex}"
    # A task writes all of a bucket of a shard, as one file; shards and buckets are spread over as many tasks as a shuffle has.
    clustered = df.repartition("shard", F.pmod(F.hash(*keys), F.lit(buckets)))
    writer = clustered.write.mode("overwrite").partitionBy("shard").bucketBy(buckets, *keys).sortBy(*keys)
    writer.format("parquet").option("compression", codec).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def _read_bucketed(spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    name = f"strandloom_{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(keys)
    location = str(Path(path).absolute()).replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (shard) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{location}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def write(
    folder: str, p: Parameters, index: DataFrame, blocks: DataFrame, contigs: DataFrame, files: DataFrame, shards: list[dict[str, Any]]
) -> None:
    """Write a database; an existing one is replaced. The manifest comes last, so an unfinished one is not found."""
    manifest_path(folder).unlink(missing_ok=True)
    codec = "zstd" if p.bgzip else "snappy"
    options = {"mode": "overwrite", "compression": codec}
    buckets = max(1, -(-max((s["minimizers"] for s in shards), default=0) // BUCKET_MINIMIZERS))
    for name, table in (("index", index), ("blocks", blocks)):
        _write_bucketed(table, f"{folder}/{name}", LARGE[name], buckets, codec)
    contigs.write.parquet(f"{folder}/contigs", **options)
    files.write.parquet(f"{folder}/files", **options)
    labels = [g.label for g in p.references]
    manifest = {
        "format": FORMAT,
        **binding_of(p),
        "max_shard_minimizers": p.max_shard_minimizers,
        "buckets": buckets,
        "total_references": len(labels),
        **{f"total_{c}": sum(s[c] for s in shards) for c in ("contigs", "minimizers", "unique_minimizers", "mapped_length")},
        "built": int(time.time()),
        "reference_checksum": checksum(labels),
        "shards": shards,
    }
    Path(folder).mkdir(parents=True, exist_ok=True)
    manifest_path(folder).write_text(json.dumps(manifest, indent=2) + "\n")


def load_manifest(folder: str, p: Parameters) -> dict[str, Any]:
    """The manifest, if the database is whole and was built with what `p` asks for."""
    path = manifest_path(folder)
    try:
        manifest = json.loads(path.read_text())
    except (OSError, ValueError) as error:
        raise ParameterError(f"cannot read the manifest {path}: {error}") from error
    if manifest.get("format") != FORMAT:
        raise ParameterError(f"{path} has format {manifest.get('format')}, not {FORMAT}")
    differing = [f"{n} is {manifest.get(n)}, not {v}" for n, v in binding_of(p).items() if manifest.get(n) != v]
    if differing:
        raise ParameterError(f"the sketch {folder} was built with other parameters: {'; '.join(differing)}")
    if sum(s["references"] for s in manifest["shards"]) != manifest["total_references"]:
        raise ParameterError(f"{path}: the shards do not add up to {manifest['total_references']} references")
    missing = [s["shard"] for s in manifest["shards"] if s["minimizers"] and not Path(folder, "index", f"shard={s['shard']}").is_dir()]
    if missing:
        raise ParameterError(f"the sketch {folder} lacks shards {missing}")
    return manifest


def chosen_shards(manifest: dict[str, Any], wanted: list[int] | None) -> list[int]:
    there = [s["shard"] for s in manifest["shards"]]
    unknown = sorted(set(wanted or []) - set(there))
    if unknown:
        raise ParameterError(f"unknown shards {unknown}; available: {there}")
    return there if wanted is None else wanted


def read(spark: SparkSession, folder: str, manifest: dict[str, Any], shards: list[int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Index, blocks, contigs and files of these shards; the others are not read."""
    check_contigs(spark.read.parquet(f"{folder}/contigs"), manifest["shards"])
    chosen = f"shard IN ({','.join(map(str, shards))})"
    large = [_read_bucketed(spark, f"{folder}/{name}", keys, manifest["buckets"]).where(chosen) for name, keys in LARGE.items()]
    small = [spark.read.parquet(f"{folder}/{name}").where(chosen) for name in ("contigs", "files")]
    return (*large, *small)
