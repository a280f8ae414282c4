import io
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from genomes import plain_fragments, plain_minimizers, plain_score, random_dna
from pyspark.sql import functions as F

from strandloom.functions import dna, mash
from strandloom.functions.dna import minimizers_of_all
from strandloom.operators.index import frequency_threshold, partition_count, partition_of, plan_shards, shard_of
from strandloom.operators.scoring import best_window, best_windows
from strandloom.operators.segments import fragment_ranges, fragment_starts, mapped_length, n_free_ranges, window_count
from strandloom.operators.summary import distribution, hidden_support
from strandloom.params import ParameterError, parse, parse_shards
from strandloom.sources.database import checksum
from strandloom.sources.fasta import parse_fasta


@pytest.mark.parametrize("k,w", [(3, 3), (12, 10), (16, 24), (5, 1), (1, 4)])
def test_minimizers_match_the_plain_form(k, w):
    rng = random.Random(k * w)
    seqs = [random_dna(n, n) for n in (0, 1, k + w - 2, k + w - 1, 60, 400)]
    seqs += ["A" * 80, "ACGT" * 20, "N" * 50, "AAAAAANNNNAAAAAA", random_dna(30, 5) + "N" * 10 + random_dna(28, 6), random_dna(90, 7).lower()]
    seqs += ["".join(rng.choices("ACGTNRYacgt-", weights=[9, 9, 9, 9, 1, 1, 1, 3, 3, 3, 3, 1], k=300)), None]
    owner, pos, key = minimizers_of_all(seqs, k, w, 42)
    for n, seq in enumerate(seqs):
        got = list(zip(pos[owner == n].tolist(), key[owner == n].tolist()))
        assert got == plain_minimizers(seq or "", k, w, 42)


@pytest.mark.parametrize("part", [1, 7, 50])
def test_long_sequences_in_parts(monkeypatch, part):
    monkeypatch.setattr(dna, "PART", part)
    rng = random.Random(part)
    for k, w in ((3, 4), (5, 1), (8, 6)):
        seq = "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=400)) + "ACGT" * 10
        pos, key = dna.minimizers(dna.base_codes(seq), k, w, 42)
        assert list(zip(pos.tolist(), key.tolist())) == plain_minimizers(seq, k, w, 42)
        ranges = plain_fragments(len(seq), 60, rng.choice([60, 25]), 20)
        owner, key = dna.sketches_of_ranges(dna.base_codes(seq), *(np.array(x) for x in zip(*ranges)), k, w, 42)
        for n, (a, b) in enumerate(ranges):
            assert key[owner == n].tolist() == sorted({x for _, x in plain_minimizers(seq[a:b], k, w, 42)})


def test_no_minimizer_covers_an_n():
    seq = random_dna(29, 1) + "N" * 10 + random_dna(29, 2)
    _, pos, _ = minimizers_of_all([seq], 10, 16, 42)
    assert all(p + 10 <= 29 or p >= 39 for p in pos)


@pytest.mark.parametrize(
    "n,length,stride,least",
    [(7500, 3000, 3000, 3000), (8999, 3000, 3000, 3000), (7500, 3000, 1000, 1000), (1500, 3000, 1000, 1000), (7500, 3000, 3000, 1000), (0, 3, 1, 1), (3100, 3000, 1000, 3000), (4000, 3000, 1000, 3000), (2999, 3000, 500, 3000)],
)
def test_fragment_ranges(spark, n, length, stride, least):
    row = spark.range(1).select(fragment_starts(F.lit(n), length, stride, least).alias("f")).first()
    assert [tuple(f) for f in row.f] == fragment_ranges(n, length, stride, least) == plain_fragments(n, length, stride, least)


def test_lengths_and_windows(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert [value(mapped_length(F.lit(n), 3000, least)) for n, least in ((7500, 3000), (7500, 1000), (3500, 1000), (4000, 1000))] == [6000, 7500, 3000, 4000]
    assert [value(window_count(F.lit(n), 16, 24)) for n in (3000, 38, 39)] == [2962, 0, 1]
    assert value(F.size(fragment_starts(F.lit(None).cast("long"), 3, 3, 3))) == 0


def test_split_at_n():
    assert n_free_ranges("ACGTNNNNACGT", 0) == [(0, 12)]
    assert n_free_ranges("ACGTNNACGT", 3) == [(0, 10)]
    assert n_free_ranges("NNNACGTNNnNNACGTNNN", 3) == [(3, 7), (12, 16)]
    assert n_free_ranges("", 3) == n_free_ranges("NNNN", 3) == []


def test_mash_values():
    assert [mash.relaxed_minimum_shared(s, 16, 80, 0.9) for s in (1, 50, 100, 144, 145, 200, 237, 300, 1000)] == [1, 1, 1, 1, 2, 2, 2, 4, 15]
    assert [mash.strict_minimum_shared(s, 16, 80) for s in (1, 50, 100, 144, 145, 200, 237, 300, 1000)] == [1, 2, 3, 3, 4, 5, 5, 7, 21]
    assert mash.distance_lower_bound(0.1, 1000, 16, 0) == 0.1
    assert 0 <= mash.distance_lower_bound(0.1, 1000, 16, 1) <= 0.1
    assert abs(mash.t_cdf(2.262, 9) - 0.975) < 0.01
    assert mash.jaccard_to_distance(0, 16) == 1 and mash.jaccard_to_distance(1, 16) == 0
    exact = sum(Fraction(math.comb(20, i)) * Fraction(3, 10) ** i * Fraction(7, 10) ** (20 - i) for i in range(8, 21))
    assert abs(mash.binomial_survival(8, 20, 0.3) - float(exact)) < 1e-12


def test_best_window_matches_the_plain_form(monkeypatch):
    rng = random.Random(5)
    for cells in (10, 4_000_000):
        monkeypatch.setattr("strandloom.operators.scoring.CELLS", cells)
        for _ in range(150):
            query = sorted(rng.sample(range(40), rng.randrange(1, 15)))
            reference = [(p, rng.randrange(40)) for p in sorted(rng.sample(range(200), 40))]
            start = rng.randrange(150)
            end, length = start + rng.randrange(60), rng.choice([5, 30, 60])
            expected = plain_score(query, reference, start, end, length, 3, 4)
            reach = [(p, k) for p, k in reference if start <= p < end + length]
            at, keys = (np.array([x[i] for x in reach], np.int64) for i in (0, 1))
            got = best_window(np.array(query), at, keys, start, end, max(0, length - 3 - 2))
            assert (None if got is None else list(got)) == expected


@pytest.mark.parametrize("large", [0, 20, 512])
def test_many_regions_at_once(monkeypatch, large):
    monkeypatch.setattr("strandloom.operators.scoring.LARGE", large)
    rng = random.Random(large)
    cases = []
    for _ in range(300):
        query = sorted(rng.sample(range(40), rng.randrange(0, 15)))
        start = rng.randrange(150)
        end, length = start + rng.randrange(60), rng.choice([5, 30, 60])
        reference = [(p, rng.randrange(60)) for p in sorted(rng.sample(range(250), rng.randrange(120)))]
        cases.append((query, [(p, k) for p, k in reference if start <= p < end + length], start, end, length))
    flat = lambda rows: np.array(list(rows), np.int64)
    found = best_windows(
        flat(i for i, c in enumerate(cases) for _ in c[0]), flat(q for c in cases for q in c[0]),
        flat(i for i, c in enumerate(cases) for _ in c[1]), flat(p for c in cases for p, _ in c[1]), flat(k for c in cases for _, k in c[1]),
        flat(c[2] for c in cases), flat(c[3] for c in cases), flat(max(0, c[4] - 5) for c in cases),
    )
    expected = {i: plain_score(*c, 3, 4) for i, c in enumerate(cases)}
    assert {r[0]: r[1:] for r in found.tolist()} == {i: b for i, b in expected.items() if b is not None}


def test_frequency_threshold(spark):
    def threshold(counts, percent):
        df = spark.createDataFrame([(1, i, h) for i, h in enumerate(counts)], "shard int, key long, hits long")
        return [r.threshold for r in frequency_threshold(df, percent).collect()]

    assert threshold([2, 1, 1], 50) == [2]
    assert threshold([5, 5, 1, 1], 25) == []  # the most frequent alone are too many
    assert threshold([9, 5, 5, 1], 50) == [9]
    assert threshold([9, 5, 1, 1], 50) == [5]
    assert threshold([9, 5, 1, 1], 100) == [1]
    assert threshold([9], 0) == []


def test_shards_and_partitions(spark):
    assert plan_shards([200, 250, 100, 400], 500) == [(0, 2, 450), (2, 2, 500)]
    assert plan_shards([600], 500) == [(0, 1, 600)]
    assert plan_shards([], 500) == []
    assert [partition_count(n) for n in (0, 10**9, 10**12)] == [16, 32, 4096]
    row = spark.range(1).select(*[partition_of(F.lit(k), 16).alias(str(i)) for i, k in enumerate((0, 0x10000000, 0xF0000000))]).first()
    assert list(row) == [0, 1, 15]
    assert [r.s for r in spark.range(4).select(shard_of(F.col("id"), [(0, 2, 1), (2, 2, 1)]).alias("s")).collect()] == [1, 1, 2, 2]
    assert parse_shards("1,10-11,12") == [1, 10, 11, 12]
    for bad in ("8-5", "", "1,foo,3"):
        with pytest.raises(ParameterError):
            parse_shards(bad)
    assert checksum([]) == 0xCBF29CE484222325


def test_distribution(spark):
    def stats(values):
        df = spark.createDataFrame([(1, 1, float(v), 100) for v in values], "query_id int, file_id int, identity double, fragment_length long")
        return hidden_support(distribution(df, ["query_id", "file_id"])).first()

    row = stats([2, 4, 4, 4, 5, 5, 7, 9])
    assert abs(row.stddev - 2.138089935299395) < 1e-12 and row.mad == 0.5
    assert stats([1, 2, 3, 4, 5]).median == 3 and stats([1, 2, 3, 4]).median == 2.5
    one = stats([97])
    assert one.stddev is None and one.ci_95_upper == one.ci_95_lower == 97 and math.isnan(one.p99)
    high = stats([97] * 400 + [98] * 400 + [99] * 200)
    assert high.mad == 1 and high.p99 < 0.05
    low = stats([80] * 200 + [81] * 400 + [82] * 400)
    assert low.mad == 1 and low.p80 < 0.05


def test_fasta_records():
    assert list(parse_fasta(io.BytesIO(b">a first\r\nAC GT\r\n\r\nacgt\n>b\n>c\xff x\nNN"))) == [("a", "ACGTacgt"), ("b", ""), ("c�", "NN")]
    assert list(parse_fasta(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(parse_fasta(io.BytesIO(b"ACGT\n")))


@pytest.mark.parametrize(
    "text,message",
    [("kmer_size = ", "parse"), ("kmer = 3", "unknown key"), ("kmer_size = '3'", "type int"), ("kmer_size = 17", "--kmer-size"), ("reference_files = 'a'", "list"), ("mash_confidence = nan", "--mash-confidence")],
)
def test_params_files_are_checked(tmp_path, text, message):
    file = tmp_path / "p.toml"
    file.write_text(text)
    with pytest.raises(ParameterError, match=message):
        parse(["--params-file", str(file), "--reference-sketch", "s"])


@pytest.mark.parametrize(
    "arguments,message",
    [
        ([], "required"),
        (["--reference", "-", "--query", "q", "--skip-validation"], "standard input"),
        (["--query", "-", "--query", "-", "--reference-sketch", "s"], "only one"),
        (["--query-name", "x", "--reference-sketch", "s"], "--query-name"),
        (["--shards", "1", "--reference", "r", "--query", "q", "--skip-validation"], "--shards"),
        (["--fragment-stride", "4000", "--reference-sketch", "s"], "--fragment-stride"),
        (["--mphf-gamma", "1.01", "--reference-sketch", "s"], "--mphf-gamma"),
        (["--params-file", "/nowhere.toml"], "params file"),
        (["--reference", "/nowhere.fa", "--query", "q"], "Cannot access reference file"),
        (["--nonsense"], "unrecognized"),
    ],
)
def test_arguments_are_checked(arguments, message):
    with pytest.raises(ParameterError, match=message):
        parse(arguments)


def test_inputs_are_checked(tmp_path):
    small, folder = tmp_path / "small.fa", tmp_path
    small.write_text(">a\nA\n")
    (tmp_path / "list.txt").write_text("small.fa\n")
    for given, message in ((small, "too small"), (folder, "not a file")):
        with pytest.raises(ParameterError, match=message):
            parse(["--reference", str(given), "--reference-sketch", "s"])
    with pytest.raises(ParameterError, match="from list|in list"):
        parse(["--reference-list", str(tmp_path / "list.txt"), "--reference-sketch", "s"])
    assert parse(["--reference", "gone.fa", "--query", "q.fa", "--skip-validation"]).references[0].label == "gone.fa"
