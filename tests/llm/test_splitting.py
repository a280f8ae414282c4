import random

import pytest

from strandloom.llm import splitting
from strandloom.llm.splitting import BOUNDARIES, letter_runs, merge_atoms, split_fragments, split_oversized, split_range, split_text, split_texts


def plain(seq, a, b, limit, stride, least, n_run):
    part, stretches, i = seq[a:b], [], 0
    run = 0
    begin = 0
    for i in range(len(part) + 1):
        if i < len(part) and part[i] in "Nn":
            run += 1
            continue
        if n_run and run >= n_run:
            stretches.append((begin, i - run))
            begin = i
        run = 0
    if n_run and len(part) and part[-1] in "Nn":
        tail = len(part) - len(part.rstrip("Nn"))
        stretches.append((begin, len(part) - tail if tail >= n_run else len(part)))
    else:
        stretches.append((begin, len(part)))
    out = []
    for s, e in stretches:
        n = e - s
        if n < least or n <= 0:
            continue
        if n <= limit:
            out.append((a + s, a + e))
            continue
        k = 0
        while k + limit <= n:
            out.append((a + s + k, a + s + k + limit))
            k += stride
        if n - k >= least:
            out.append((a + s + k, a + e))
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(4))
def test_pieces_against_the_definition(seed):
    import re

    rng = random.Random(seed)
    for _ in range(400):
        seq = "".join(rng.choice(["A", "N", "n", "C" * rng.randrange(20), "N" * rng.randrange(6)]) for _ in range(rng.randrange(30)))
        a = rng.randrange(len(seq) + 1)
        b = rng.randrange(a, len(seq) + 1)
        limit = rng.randrange(1, 30)
        stride, least, n_run = rng.randrange(1, limit + 1), rng.randrange(1, limit + 1), rng.randrange(5)
        breaks = [m.span() for m in re.finditer("[Nn]+", seq)]
        got = split_range(a, b, breaks, limit, stride, least, n_run)
        assert sorted(got) == plain(seq, a, b, limit, stride, least, n_run)
        assert all(e - s <= limit for s, e in got)


def test_weakest_boundaries_merge_first():
    edges, strengths = [0, 4, 8, 12, 16], [3.0, 1.0, 2.0]
    assert merge_atoms(edges, strengths, lambda a, b: b - a <= 8) == [(0, 4), (4, 12), (12, 16)]
    assert merge_atoms(edges, [float("inf")] * 3, lambda a, b: True) == [(0, 4), (4, 8), (8, 12), (12, 16)]
    assert merge_atoms([0, 5], [], lambda a, b: True) == [(0, 5)]


def test_runs_of_letters(spark):
    df = spark.createDataFrame([(1, "ANNnC"), (2, None), (3, ""), (4, "NN"), (5, "éNü")], "id int, seq string")
    got = {r.id: (r.letters, r.part, r.run_starts, r.run_ends) for r in letter_runs(df, ["id"], "seq", "Nn").collect()}
    assert got == {1: (5, 0, [1], [4]), 4: (2, 0, [0], [2]), 5: (3, 0, [1], [2])}


def test_runs_over_the_parts_of_a_long_contig(spark):
    part, at = splitting.PART, 2 * splitting.PART
    seq = "A" * (at - 3) + "N" * 7 + "C" * (part - 9) + "N" * (part + 5) + "G" * 100
    params = spark.createDataFrame([(1, 50_000, 50_000, 1, 4)], "params_id int, fragment_length int, fragment_stride int, min_fragment_length int, split_n_run int")
    genomes = spark.createDataFrame([("query", 5, 1, "L")], "side string, file_id int, params_id int, label string")
    contigs = spark.createDataFrame([("query", 5, 1, seq)], "side string, file_id int, contig_id int, seq string")
    spans = [(1, 0, len(seq)), (2, at - 40_000, at + 40_000), (3, at - 2, at + 60_000), (4, len(seq) - 60_000, len(seq) + 9)]
    fragments = spark.createDataFrame([(5, i, 1, a, b) for i, a, b in spans], "query_id int, fragment_id long, contig_id int, frag_start long, frag_end long")
    got = {}
    for r in split_fragments(fragments, contigs, genomes, params).collect():
        got.setdefault(r.fragment_id, []).append((r.piece_start, r.piece_end))
    assert {i: sorted(p) for i, p in got.items()} == {i: plain(seq, a, min(b, len(seq)), 50_000, 50_000, 1, 4) for i, a, b in spans}


def all_atoms(text, most, strengths):
    """Every letter an atom: what merging gives without any shortcut."""
    edges = list(range(len(text) + 1))
    at = [splitting.INSIDE] * (len(text) - 1)
    for strength, pattern in reversed(strengths):
        for found in pattern.finditer(text):
            if 0 < found.end() < len(text):
                at[found.end() - 1] = strength
    return edges, at


WORDS = ["one", "two.", "Three!", "four\n", "five\n\n", "six  ", "seventeen", "e" * 30]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_texts(seed):
    rng = random.Random(seed)
    for _ in range(300):
        text = " ".join(rng.choices(WORDS, k=rng.randrange(60)))
        limit = rng.randrange(2, 60)
        overlap = rng.randrange(limit // 2)
        pieces = split_text(text, limit, overlap)
        assert all(0 < b - a <= limit for a, b in pieces)
        if len(text) <= limit:
            assert pieces == ([(0, len(text))] if text else [])
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(b == min(c + overlap, len(text)) for (_, b), (c, _) in zip(pieces, pieces[1:]))


def test_refining_gives_what_merging_letters_gives():
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choices(WORDS[:7], k=rng.randrange(60)))
        edges, strengths = all_atoms(text, 40, BOUNDARIES)
        if len(text) > 40:
            runs = merge_atoms(edges, strengths, lambda a, b: min(b + 5, len(text)) - a <= 40)
            assert [a for a, _ in split_text(text, 40, 5)] == [a for a, _ in runs]


def test_other_strengths_cut_elsewhere():
    text = "aa bb. cc dd\n\nee ff. gg hh. ii jj\n\nkk"
    swapped = ((splitting.PARAGRAPH, BOUNDARIES[2][1]), (splitting.LINE, BOUNDARIES[0][1]), BOUNDARIES[3])
    cuts = [[text[a:b] for a, b in split_text(text, 22, 0, kinds)] for kinds in (BOUNDARIES, swapped)]
    assert cuts[0] == ["aa bb. cc dd\n\n", "ee ff. gg hh. ii jj\n\n", "kk"]
    assert cuts[1] != cuts[0] and all("".join(c) == text for c in cuts)


def test_texts_with_nulls_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (None, "ab cd"), (3, "ab cd"), (3, "ab cd"), (4, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, piece string")
    got = split_texts(df, "doc_id", "text", 4, 1)
    assert got.columns == ["doc_id", "piece", "piece_start", "piece_end"]
    found = sorted((r.doc_id or 0, r.piece, r.piece_start, r.piece_end) for r in got.collect() if r.doc_id != 4)
    assert found == [(0, 0, 0, 4), (0, 1, 3, 5), (3, 0, 0, 4), (3, 0, 0, 4), (3, 1, 3, 5), (3, 1, 3, 5)]
    assert got.filter("doc_id = 4").count() == 33_333
    assert split_texts(df.limit(0), "doc_id", "text", 4, 1).collect() == []
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "text", 4, 4)


ITEM = "item long, start long, `end` long, limit int, stride int, least int, least_break int, run_starts array<long>, run_ends array<long>, piece_start string"


def test_items_with_nulls_and_odd_settings(spark):
    whole = (0, 10, 4, 4, 1, 1, [4], [6], "x")
    rows = [(1, *whole), (None, *whole)]
    for column in range(1, 9):
        values = [column + 1, *whole]
        values[column] = None
        rows.append(tuple(values))
    rows += [(20, 5, 5, 4, 4, 1, 1, [], [], "x"), (21, 0, 9, 0, 0, 1, 1, [], [], "x"), (22, 0, 9, 3, 4, 1, 1, [], [], "x"), (23, 0, 10**6, 400, 300, 1, 0, [], [], "x")]
    got = {}
    for r in split_oversized(spark.createDataFrame(rows, ITEM)).collect():
        got.setdefault(r.item, []).append((r.piece_start, r.piece_end))
    assert got[1] == [(0, 4), (6, 10)]
    assert got[7] == got[8] == got[9] == [(0, 4), (4, 8), (8, 10)]  # no break length or no runs: nothing parts
    assert set(got) == {1, 7, 8, 9, 23}
    assert len(got[23]) == 3334 and got[23][-1][1] == 10**6


def test_fragments(spark):
    params = spark.createDataFrame([(1, 10, 8, 4, 3)], "params_id int, fragment_length int, fragment_stride int, min_fragment_length int, split_n_run int")
    genomes = spark.createDataFrame([("query", 5, 1, "L"), ("query", 5, 1, "L"), ("reference", 6, None, None), ("query", 7, None, None)], "side string, file_id int, params_id int, label string")
    seq = "A" * 12 + "NNN" + "C" * 3 + "nnnn" + "G" * 12
    contigs = spark.createDataFrame([("query", 5, 1, seq), ("query", 5, 1, seq), ("query", 5, 2, None), ("query", 5, 3, "")], "side string, file_id int, contig_id int, seq string")
    rows = [
        (5, 1, 1, 0, 34), (5, 1, 1, 0, 34), (5, 2, 1, 0, 10), (5, 3, 1, None, 34), (5, 4, 1, 0, None), (5, 5, 2, 0, 34), (5, 6, 3, 0, 34),
        (5, 7, 9, 0, 34), (7, 8, 1, 0, 34), (5, 9, 1, 20, 90), (None, 10, 1, 0, 34), (5, None, 1, 0, 34), (5, 11, None, 0, 34),
    ]
    fragments = spark.createDataFrame(rows, "query_id int, fragment_id long, contig_id int, frag_start long, frag_end long")
    got = sorted(tuple(r) for r in split_fragments(fragments, contigs, genomes, params).collect())
    assert got == [(1, 0, 10), (1, 8, 12), (1, 22, 32), (1, 30, 34), (9, 20, 30), (9, 28, 34)]  # of the run before 22, fragment 9 has two letters only
    empty = split_fragments(fragments.limit(0), contigs, genomes, params)
    assert empty.collect() == []
