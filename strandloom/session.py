"""Session settings, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session on this machine, for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("strandloom").config(map=DEFAULTS)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if they can see that place."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that executors and driver share: the session's spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a cluster a missing setting is an error, as a
    machine-local folder would not survive an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strandloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage and go on from there, so that passes over it do not repeat its plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a dimension table of a few numbers up to which it is broadcast: some 20 MB.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, written once and counted; marked for broadcast if it has no more rows than that, else left to a
    shuffle join. For narrow tables."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= rows else df


def slices_of(spark: SparkSession) -> int:
    """Number of slices for exact numbering: as many as the session shuffles into, so they grow with the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
