import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators.skew import heavy_keys, number_rows, per_key_totals, running_totals

SCHEMA = "record_id long, k long, hits long, slice string, ordinal int, _n int"


def totals(df, **options):
    return per_key_totals(df, F.col("record_id"), F.col("k"), F.col("hits"), **options)


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(i, 7 if rng.random() < 0.4 else rng.randrange(30), rng.choice([None, 0, rng.randrange(50)]), "x", 1, 2) for i in range(n)]
    return rows + rng.choices(rows, k=n // 4)  # repeated rows


@pytest.mark.parametrize("chunk_rows,slices", [(1, 3), (10, 4), (65_536, 1)])
def test_totals_match_a_plain_count(spark, chunk_rows, slices):
    rows = rows_of(500, 1)
    expected = {}
    for _, key, hits in {r[0]: r[:3] for r in rows}.values():
        n, total = expected.get(key, (0, 0))
        expected[key] = n + 1, total + (hits or 0)
    found = totals(spark.createDataFrame(rows, SCHEMA), chunk_rows=chunk_rows, slices=slices).collect()
    assert {r.key: (r.records, r.total) for r in found} == expected
    assert all(r.chunks == -(-r.records // chunk_rows) for r in found)


def test_nulls_and_repeated_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (2, 3, None), (None, 3, 4), (None, 3, 4), (9, None, 1)]
    found = totals(spark.createDataFrame(rows, "record_id long, k long, hits long")).collect()
    assert {(r.key, r.records, r.total) for r in found} == {(None, 2, 6), (3, 3, 8)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert totals(empty).collect() == []
    assert heavy_keys(totals(empty), 0.01).collect() == []
    assert running_totals(empty, F.col("record_id"), F.col("k"), F.col("hits"), F.col("record_id"), 10).collect() == []


def test_heavy_keys_include_the_bound(spark):
    rows = [(i, i, 1) for i in range(99)] + [(200, 500, 1)]
    found = heavy_keys(totals(spark.createDataFrame(rows, "record_id long, k long, hits long")), 0.01)
    assert found.count() == 100


def test_numbers_are_dense_and_stable(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, k long")
    first = sorted(tuple(r) for r in number_rows(df, "k", ["id"], 5).collect())
    again = sorted(tuple(r) for r in number_rows(df.repartition(7), "k", ["id"], 5).collect())
    assert first == again
    for key in range(3):
        at = number_rows(df, "k", ["id"], 5).filter(F.col("k") == key).select("ordinal").toPandas().ordinal
        assert sorted(at) == list(range(len(at)))


def test_running_totals(spark):
    rows = [r[:3] for r in rows_of(300, 2)]
    found = running_totals(spark.createDataFrame(rows, "record_id long, k long, hits long"), F.col("record_id"), F.col("k"), F.col("hits"), F.col("record_id"), 16)
    expected, sums = {}, {}
    for record, key, hits in sorted({r[0]: r for r in rows}.values()):
        sums[key] = sums.get(key, 0) + (hits or 0)
        expected[record] = sums[key]
    assert {r.record: r.running for r in found.collect()} == expected
