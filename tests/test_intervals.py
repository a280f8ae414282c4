import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators.intervals import periods_and_gaps

SCHEMA = "entity_id long, s long, e long, bucket string, pos int, k int"


def plain(rows):
    out, by = set(), {}
    for entity, s, e in rows:
        if None not in (entity, s, e) and s != e:
            by.setdefault(entity, []).append((min(s, e), max(s, e)))
    for entity, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(entity, "merged", s, e) for s, e in merged}
        out |= {(entity, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def found(spark, rows, bits):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, F.col("entity_id"), F.col("s"), F.col("e"), bits).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed,reach,bits", [(1, 60, 3), (2, 400, 4), (3, 5000, 16), (4, 30, 0)])
def test_against_a_plain_merge(spark, seed, reach, bits):
    rng = random.Random(seed)
    rows = []
    for _ in range(200):
        s = rng.randrange(-reach, reach)
        e = s + rng.choice([0, 1, rng.randrange(12), -rng.randrange(12)])
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), rng.choice([s, s, s, s, None]), e))
    rows += rng.choices(rows, k=50)
    assert found(spark, rows, bits) == plain(rows)


def test_touching_nested_and_exchanged(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 5, 7), (1, 40, 30), (1, 25, 25), (2, 3, 3)]
    assert found(spark, rows, 2) == {(1, "merged", 0, 20), (1, "gap", 20, 30), (1, "merged", 30, 40)}


def test_empty_and_very_long(spark):
    assert found(spark, [], 16) == set()
    assert found(spark, [(1, -(2**40), 2**40), (1, 2**41, 2**41 + 1)], 16) == {
        (1, "merged", -(2**40), 2**40), (1, "gap", 2**40, 2**41), (1, "merged", 2**41, 2**41 + 1),
    }
