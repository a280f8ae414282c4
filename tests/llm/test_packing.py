import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm.packing import LARGEST_CAPACITY, faults_of, combinations, fill_greedily, fill_of, nonnegative_least_squares, pack, pack_documents, plan
from strandloom.llm.tokenizer import count_tokens

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def check_plan(histogram, capacity, **options):
    patterns = plan(histogram, capacity, **options)
    held = Counter()
    for p in patterns:
        assert sum(a * k for a, k in p.lengths) <= capacity and p.repeat > 0
        for a, k in p.lengths:
            held[a] += k * p.repeat
    assert held == Counter({a: n for a, n in histogram.items() if n})
    return sum(p.repeat for p in patterns)


@pytest.mark.parametrize("capacity,grid,depth", [(512, 256, 3), (2048, 256, 3), (1000, 64, 2), (7, 256, 3), (1, 256, 3), (300, 256, 1)])
def test_plan_holds_everything(capacity, grid, depth):
    rng = random.Random(capacity)
    for shape in (lambda: rng.randrange(1, capacity + 1), lambda: min(capacity, 1 + int(rng.expovariate(8 / capacity))), lambda: capacity):
        histogram = Counter(shape() for _ in range(3000))
        used = check_plan(histogram, capacity, grid=grid, depth=depth)
        need = -(-sum(a * n for a, n in histogram.items()) // capacity)
        big = sum(n for a, n in histogram.items() if 2 * a > capacity)
        if grid == 256 and capacity > 256:
            assert used <= 1.025 * max(need, big) + 2
    assert check_plan({}, capacity) == 0


def test_combinations_fill_exactly():
    rows = combinations(20, 3, np.array([0, 1] + [1] * 19) > 0)
    assert (rows.sum(axis=1) == 20).all() and len({tuple(sorted(r)) for r in rows.tolist()}) == len(rows)
    assert len(rows) == 1 + 10 + 33  # partitions of 20 into one, two and three parts


def test_least_squares():
    rows = np.array([[0, 0, 4], [0, 1, 3], [0, 2, 2], [1, 1, 2]])
    target = np.array([0, 5.0, 8, 3, 2])
    x = nonnegative_least_squares(rows, target)
    assert (x >= 0).all()
    held = np.zeros(5)
    for r, times in zip(rows, x):
        for length in r:
            held[length] += times
    assert np.allclose(held[1:], target[1:], atol=1e-6)
    assert not nonnegative_least_squares(rows, np.zeros(5)).any()


def test_greedy_uses_open_space():
    from strandloom.llm.packing import LARGEST_CAPACITY, faults_of, Pattern

    patterns = fill_greedily({3: 2, 2: 1}, [Pattern([(7, 1)], 2)], 10)
    assert sorted((sorted(p.lengths), p.repeat) for p in patterns) == [([(2, 1)], 1), ([(3, 1), (7, 1)], 2)]


def check_packed(rows, sizes, capacities):
    space, held = defaultdict(list), defaultdict(list)
    for t, container, place, item, start, length in rows:
        space[t, container].append((place, place + length))
        held[t, item].append((start, start + length))
    for (t, _), spans in space.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert spans[-1][1] <= capacities[t]
    for t, capacity in capacities.items():
        assert sorted(c for u, c in space if u == t) == list(range(sum(u == t for u, _ in space)))
        for item, size in sizes.items():
            spans = sorted(held.pop((t, item), []))
            assert len(spans) == (-(-size // capacity) if size else 0)
            if size:
                assert spans[0][0] == 0 and spans[-1][1] == size and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert not held


def test_pack(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, 1, 5, 100, 101, 250, rng.randrange(80), rng.randrange(300)]) for i in range(400)}
    df = spark.createDataFrame([*sizes.items(), (None, 5), (1000, None), (1001, -3)], "item long, size long")
    capacities = {1: 100, 2: 7, 9: 1000}
    check_packed([tuple(r) for r in pack(df, list(capacities.items())).collect()], sizes, capacities)
    assert pack(df.limit(0), [(1, 5)]).collect() == [] == pack(df, []).collect()
    with pytest.raises(ValueError):
        pack(df, [(1, 0)])


def test_documents(spark):
    documents = spark.read.parquet(DOCUMENTS)
    targets = spark.createDataFrame([(1, "byte_bpe_50k", 512), (2, "byte_bpe_multi_50k", 2048), (3, None, 5), (1, "byte_bpe_50k", 512)], "target_id int, tokenizer string, capacity_tokens int")
    packed = pack_documents(documents.union(documents.limit(30)), targets)
    rows = packed.collect()
    for target, tokenizer, capacity in ((1, "byte_bpe_50k", 512), (2, "byte_bpe_multi_50k", 2048)):
        sizes = {r.doc_id: r.n_tokens for r in count_tokens(documents, "doc_id", "text", tokenizer).collect()}
        own = [(r.target_id, r.container_id, r.container_start, r.doc_id, r.token_start, r.token_end - r.token_start) for r in rows if r.target_id == target]
        check_packed(own, sizes, {target: capacity})
    fill = {r.target_id: r.fill for r in fill_of(packed, targets).collect()}
    assert fill[1] > 0.98
    assert pack_documents(documents.limit(0), targets).collect() == []
    assert pack_documents(documents, targets.limit(0)).collect() == []


def test_many_targets(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 7), (3, 12), (4, LARGEST_CAPACITY), (5, LARGEST_CAPACITY - 40)], "item long, size long")
    capacities = [(n, 10 + n) if n % 3 == 0 else (n, LARGEST_CAPACITY - n) for n in range(30)]
    large = pack(sizes, capacities[1::3] + capacities[2::3]).collect()
    small = pack(sizes.filter("item < 4"), capacities[0::3]).collect()
    held = defaultdict(int)
    for r in large + small:
        held[r.target_id] += r.length
    assert held == {n: 24 if n % 3 == 0 else 24 + 2 * LARGEST_CAPACITY - 40 for n in range(30)}
    assert max(r.length for r in large) == LARGEST_CAPACITY - 1


def test_faults_are_found(spark):
    targets = spark.createDataFrame([(1, 10), (2, 10)], "target_id int, capacity_tokens int")
    sizes = spark.createDataFrame([(1, 6), (2, 4), (3, 14), (4, 0)], "doc_id long, n_tokens long")
    good = [(0, 0, 1, 0, 6), (0, 6, 2, 0, 4), (1, 0, 3, 0, 10), (2, 0, 3, 10, 14)]
    bad = [(0, 0, 1, 0, 6), (0, 5, 2, 0, 2), (1, 0, 2, 2, 4), (1, 2, 3, 0, 10)]
    packed = spark.createDataFrame([(1, *r) for r in good] + [(2, *r) for r in bad], "target_id int, container_id long, container_start long, doc_id long, token_start long, token_end long")
    found = {r.target_id: tuple(r)[1:] for r in faults_of(packed, sizes, targets).collect()}
    assert found == {1: (0, 0, 0, 0), 2: (1, 1, 1, 1)}
