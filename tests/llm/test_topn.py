import random

import pytest

from strandloom.llm import topn
from strandloom.llm.topn import BoundedHeap, top_n

SCHEMA = "g long, s double, f int, p long, id long, score string, `group` int, tie_0 int"


def plain(rows, n):
    big = float("inf")
    by = {}
    for g, s, f, p, i in set(rows):
        if g is not None and s is not None and s == s:
            by.setdefault(g, []).append((-s, *(big if x is None else x for x in (f, p, i)), (g, i)))
    return {x[-1] for items in by.values() for x in sorted(items)[:n]}


def found(spark, rows, n, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    got = [(r.g, r.id) for r in top_n(df, "g", "s", ["f", "p", "id"], n).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed,n,held", [(1, 5, 200_000), (2, 1, 20), (3, 50, 10), (4, 3, 1)])
def test_against_sorting(spark, monkeypatch, seed, n, held):
    monkeypatch.setattr(topn, "HELD_ITEMS", held)
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        g = 1 if rng.random() < 0.4 else rng.choice([None, *range(-3, 40)])
        s = rng.choice([0.0, -0.0, 1.5, 99.0, 99.0, float("nan"), float("inf"), None, rng.random()])
        rows.append((g, s, rng.choice([None, 1, 2]), rng.randrange(3), i))
    rows += rng.choices(rows, k=200)
    expected = plain([(g, s if s is None or s else 0.0, *rest) for g, s, *rest in rows if not (s is not None and s != s)], n)
    assert found(spark, rows, n) == expected


def test_ties_go_to_the_smaller_id(spark):
    rows = [(1, 5.0, 1, 1, i) for i in range(100)]
    assert found(spark, rows, 5, parts=7) == {(1, i) for i in range(5)}


def test_empty_and_wrong(spark):
    assert found(spark, [], 5) == set()
    assert found(spark, [(None, 1.0, 1, 1, 1), (1, None, 1, 1, 1)], 5) == set()
    with pytest.raises(ValueError):
        found(spark, [], 0)


def test_heap_is_bounded_and_distinct():
    heap = BoundedHeap(3)
    for x in [5, 1, 5, 9, 9, 7, 2]:
        heap.push((x,))
    assert sorted(heap.items) == [(5,), (7,), (9,)]


def test_ties_of_the_largest_and_the_smallest_integers(spark):
    ends = [2**63 - 1, -(2**63), 0, None]
    rows = [(1, 5.0, a, b) for a in ends for b in ends]
    df = spark.createDataFrame(rows, "g long, s double, a long, b long").repartition(3)
    got = [(r.a, r.b) for r in top_n(df, "g", "s", ["a", "b"], 7).collect()]
    last = lambda x: (x is None, x or 0)
    assert sorted(got, key=lambda t: tuple(map(last, t))) == sorted([r[2:] for r in rows], key=lambda t: tuple(map(last, t)))[:7]
