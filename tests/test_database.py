from pyspark.sql import functions as F

from strandloom.sources.database import _read_bucketed, _write_bucketed


def test_shards_are_written_by_several_tasks_a_bucket_by_one(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 16).cast("int").alias("shard"), F.col("id").alias("key"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        for buckets in (1, 3):
            path = str(tmp_path / f"index{buckets}")
            _write_bucketed(rows, path, ("key",), buckets, "snappy")
            files = [p for p in (tmp_path / f"index{buckets}").rglob("part-*.parquet")]
            assert len(files) == 16 * buckets  # one for every bucket of a shard
            assert len({p.name.split("-")[1] for p in files}) > buckets  # tasks
            read = _read_bucketed(spark, path, ("key",), buckets)
            assert sorted(map(tuple, read.select("shard", "key").collect())) == sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.unset(name)
