import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import setjoin
from strandloom.llm.setjoin import similar_classes, similar_pairs

SCHEMA = "id long, items array<long>, set_id string, tokens int, key int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def plain(rows, threshold):
    sets = {i: {x for x in items if x is not None} for i, items in rows if i is not None and items is not None}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared / len(sets[a] | sets[b]) >= threshold:
                    out[a, b] = shared
    return out


def made_up(seed, n=120, hot=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and rows:
            items = [x for x in (rng.choice(rows)[1] or []) if rng.random() < 0.85] + rng.choices(range(1000), k=rng.randrange(3))
        elif kind < 0.5 and hot:
            items = rng.sample(range(8), rng.randrange(1, 6))
        else:
            items = rng.choices(range(2000), k=rng.randrange(25)) + [0] * rng.randrange(2)
        items = items + [None] * rng.randrange(2)
        rng.shuffle(items)
        rows.append((i, rng.choice([items, items, items, None]) if rng.random() < 0.1 else items))
    rows += rng.choices(rows, k=20)
    return rows + [(None, [1, 2, 3])]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("hot_rows, gain", [(1, 0), (6, 1), (500, 8)])  # gain 0 splits down to the deepest lists
def test_all_pairs(spark, monkeypatch, threshold, hot_rows, gain):
    monkeypatch.setattr(setjoin.similar_sets, "__defaults__", (50, hot_rows))
    monkeypatch.setattr(setjoin, "SPLIT_GAIN", gain)
    rows = made_up(int(threshold * 10) + hot_rows)
    got = similar_pairs(frame(spark, rows), F.col("id"), F.col("items"), threshold).collect()
    found = {(r.record_a, r.record_b): r.shared for r in got}
    assert len(found) == len(got)
    assert found == plain(rows, threshold)


def test_classes(spark):
    rows = made_up(9)
    expected = {}
    for a, b in plain(rows, 0.6):
        expected[a] = expected.get(a, 0) + 1
        expected[b] = expected.get(b, 0) + 1
    sets = {i: frozenset(x for x in s if x is not None) for i, s in rows if i is not None and s is not None}
    got = similar_classes(frame(spark, rows), F.col("id"), F.col("items"), 0.6).collect()
    assert {r.record: r.links for r in got} == {i: expected.get(i, 0) for i, s in sets.items() if s}
    assert all(r.class_id == min(i for i, s in sets.items() if s == sets[r.record]) for r in got)


def test_group_of_copies(spark):
    rows = [(i, [3, 1, 2] if i % 3 else [5, i + 100]) for i in range(60)]
    got = similar_pairs(frame(spark, rows), F.col("id"), F.col("items"), 0.6).count()
    assert got == len(plain(rows, 0.6)) == 40 * 39 // 2


def test_empty_tables_and_sets(spark):
    for rows in ([], [(1, []), (2, None), (3, [None])]):
        assert similar_pairs(frame(spark, rows), F.col("id"), F.col("items"), 0.6).collect() == []
        assert similar_classes(frame(spark, rows), F.col("id"), F.col("items"), 0.6).collect() == []


def test_very_long_set(spark):
    rows = [(1, list(range(50_000))), (2, list(range(10_000, 50_000))), (3, list(range(25_000)))]
    assert {(r.record_a, r.record_b) for r in similar_pairs(frame(spark, rows), F.col("id"), F.col("items"), 0.6).collect()} == {(1, 2)}


def third_hot(n, seed=3):
    """A third of the sets hold one token, and all of them tokens of which each is in more sets yet."""
    rng = random.Random(seed)
    return [(i, [-5, *rng.sample(range(14), 5)] if i % 3 == 0 else rng.sample(range(14), 7)) for i in range(n)]


def test_a_token_in_a_third_of_the_sets(spark):
    candidates = {}
    for n in (600, 1200):
        rows = third_hot(n)
        sets, _ = setjoin.set_classes(frame(spark, rows), F.col("id"), F.col("items"))
        rarity = setjoin.rarity_of(sets, 2)  # a token of half of all occurrences would be frequent: there is none
        assert not len(rarity.frequent)
        index = setjoin.index_of(sets, 0.6, 2, 40)
        whole = setjoin.index_of(sets, 0.6, 2, 10**6)
        longest = [d.groupBy("key").count().agg(F.max("count")).first()[0] for d in (whole, index)]
        assert longest[0] > n // 4 and longest[1] < n // 12
        found = {(r.a, r.b) for r in setjoin.similar_sets(sets, 0.6, 2, 40).select("a", "b").collect()}
        assert found == {(r.a, r.b) for r in setjoin.similar_sets(sets, 0.6, 2, 10**6).select("a", "b").collect()}
        assert len(found) > 20
        candidates[n] = setjoin.candidate_pairs(index, 0.6).count() / len(found)
        assert candidates[n] < setjoin.candidate_pairs(whole, 0.6).count() / len(found) / 2
        # what a split adds is bounded by the pairs it saves, and for a set by its prefix, once for each token of it
        assert index.count() < whole.count() + longest[0] ** 2 / setjoin.SPLIT_GAIN * n / 40
    assert candidates[1200] < 2 * candidates[600]


def test_tiny_sets_under_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(setjoin.similar_sets, "__defaults__", (50, 2))
    monkeypatch.setattr(setjoin, "SPLIT_GAIN", 0)
    rows = [(i, [1, 2, 100 + i]) for i in range(40)] + [(40, [1, 2]), (41, [1]), (42, [2, 1, 3, 4])] + [(50 + i, [1, 2, 3, 100 + i]) for i in range(40)]
    for partitions in (1, 7):
        df = frame(spark, rows).repartition(partitions)
        got = similar_pairs(df, F.col("id"), F.col("items"), 0.6).collect()
        assert {(r.record_a, r.record_b): r.shared for r in got} == plain(rows, 0.6)
