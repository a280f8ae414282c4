import gzip
import io
import math
from dataclasses import replace

import pytest
from genomes import fasta, mutated, plain_mappings, random_dna, reverse_complement

from pyspark.sql import functions as F

from strandloom.cli import main
from strandloom.params import Genome, Parameters, parse
from strandloom.plans import pipeline

BASE = Parameters(kmer_size=12, window_size=10, fragment_length=300)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("genomes")
    one, two = random_dna(4000, 1), random_dna(2500, 2)
    repeat = random_dna(400, 9)
    sequences = {
        "a": [one, two, "ACGT" * 10],
        "b": [mutated(one, 0.02, 3), repeat + random_dna(600, 5) + repeat],
        "c": [reverse_complement(mutated(two, 0.05, 4)), random_dna(1500, 6)],
        "n": [one[:1000] + "N" * 30 + one[1000:2500] + "NNN" + one[2500:]],
    }
    for name, seqs in sequences.items():
        text = fasta({f"{name}{i}": s for i, s in enumerate(seqs)})
        (at / f"{name}.fa").write_text(text)
        (at / f"{name}.fa.gz").write_bytes(gzip.compress(text[: len(text) // 2].encode()) + gzip.compress(text[len(text) // 2 :].encode()))
    return at, sequences


def settings(at, queries, references, **changes) -> Parameters:
    named = lambda names: tuple(Genome(str(at / f"{n}.fa"), n) for n in names)
    return replace(BASE, queries=named(queries), references=named(references), quiet=True, **changes)


def outcome(spark, p):
    out = io.StringIO()
    pipeline.run(p, spark, out, io.StringIO())
    return [line.split("\t") for line in out.getvalue().splitlines()]


@pytest.mark.parametrize(
    "changes",
    [
        {},
        {"fragment_stride": 150, "min_fragment_length": 100},
        {"minmer_count": 20},
        {"mash_threshold": 0.0},
        {"mash_confidence": 0.0, "mash_threshold": 95.0},
    ],
)
def test_mappings_match_the_plain_model(spark, folder, changes):
    at, sequences = folder
    p = settings(at, "ab", "abc", **changes)
    files = spark.createDataFrame([(i, g.label) for i, g in enumerate(p.references)], "file_id int, label string")
    reference, _ = pipeline.build_reference(pipeline.read_contigs(spark, p.references, "reference"), files, p)
    result = pipeline.compare(pipeline.read_contigs(spark, p.queries, "query"), reference, p)
    found = sorted(
        (r.query_id, r.file_id, r.contig_id, r.fragment_id, r.reference_start, r.shared, r.query_minimizers, round(r.identity, 9))
        for r in result.mappings.collect()
    )
    numbered = lambda names: {i: sequences[n] for i, n in enumerate(names)}
    assert found == plain_mappings(numbered("ab"), numbered("abc"), p)
    assert found


def test_identities(spark, folder):
    at, _ = folder
    rows = outcome(spark, settings(at, "a", "abc"))
    ani = {r[1]: float(r[2]) for r in rows}
    assert ani["a"] > 99.5 and 97 < ani["b"] < 99 and 93 < ani["c"] < 97
    assert all(len(r) == 12 for r in rows)
    assert float(next(r for r in rows if r[1] == "a")[3]) > 0.95


def test_shards_and_database_do_not_change_results(spark, folder, tmp_path):
    at, _ = folder
    plain = outcome(spark, settings(at, "ab", "abc"))
    for name, budget in (("one", 10**9), ("many", 500)):
        stored = settings(at, "ab", "abc", reference_sketch=str(tmp_path / name), max_shard_minimizers=budget)
        assert outcome(spark, stored) == plain  # built
        assert outcome(spark, replace(stored, references=())) == plain  # reused
    part = replace(stored, references=(), shards="2")
    assert {r[1] for r in outcome(spark, part)} == {"b"}
    with pytest.raises(ValueError, match="available"):
        outcome(spark, replace(part, shards="9"))
    with pytest.raises(ValueError, match="other parameters"):
        outcome(spark, replace(stored, window_size=11))
    with pytest.raises(ValueError, match="--force"):
        outcome(spark, replace(stored, queries=()))


def test_building_alone_and_overwriting(spark, folder, tmp_path):
    at, _ = folder
    built = replace(settings(at, "", "ab"), reference_sketch=str(tmp_path / "db"), bgzip=True)
    assert outcome(spark, built) == []
    assert {r[1] for r in outcome(spark, replace(settings(at, "a", ""), reference_sketch=built.reference_sketch))} == {"a", "b"}
    with pytest.raises(ValueError, match="--force"):
        outcome(spark, built)
    assert outcome(spark, replace(settings(at, "", "c"), reference_sketch=built.reference_sketch, force=True)) == []
    assert {r[1] for r in outcome(spark, replace(settings(at, "a", ""), reference_sketch=built.reference_sketch))} == {"c"}
    with pytest.raises(ValueError, match="no reference"):
        outcome(spark, replace(settings(at, "a", ""), reference_sketch=str(tmp_path / "none")))


def test_more_minmers_than_there_are_change_nothing(spark, folder):
    at, _ = folder
    assert outcome(spark, settings(at, "a", "b", minmer_count=10_000)) == outcome(spark, settings(at, "a", "b"))


def test_a_stored_index_is_not_shuffled(spark, folder, tmp_path, monkeypatch):
    at, _ = folder
    monkeypatch.setattr("strandloom.sources.database.BUCKET_MINIMIZERS", 300)
    p = settings(at, "a", "abc", reference_sketch=str(tmp_path / "db"))
    plain = outcome(spark, settings(at, "a", "abc"))
    assert outcome(spark, p) == plain == outcome(spark, replace(p, references=()))
    reference = pipeline.load_reference(spark, replace(p, references=()), io.StringIO())
    keys = spark.range(100).select(F.col("id").alias("key"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = keys.join(reference.index, "key")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_split_at_n_and_segment_offsets(spark, folder, tmp_path):
    at, _ = folder
    stats = tmp_path / "stats.tsv"
    rows = outcome(spark, settings(at, "a", "n", split_n_run=10, mapping_stats=str(stats), header=True))
    assert rows[0][0] == "query_file" and float(rows[1][2]) > 99
    lines = [line.split("\t") for line in stats.read_text().splitlines()]
    assert len(lines[0]) == 17 and all(len(x) == 17 for x in lines)
    starts = {int(x[5]): int(x[7]) for x in lines[1:] if x[2] == "a0" and x[16] == "true"}
    assert abs(starts[2100] - 2130) < 60  # behind the run of N


def test_per_contig_has_every_contig(spark, folder):
    at, _ = folder
    rows = outcome(spark, settings(at, "a", "ac", per_contig=True, header=True))
    comments = [r for r in rows if r[0].startswith("#")]
    assert [c[0] for c in comments] == ["# aggregate_summary_header", "# aggregate_summary", "# aggregate_summary"]
    table = rows[len(comments) + 1 :]
    assert len(table) == 2 * 3
    assert {r[2]: r[6] for r in table if r[1] == "a"}["a2"] == "NaN"
    assert all(len(r) == 14 for r in table)


def test_command_line(spark, folder, tmp_path, capsys):
    at, _ = folder
    (tmp_path / "refs.txt").write_text(f"# references\n\n{at / 'b.fa.gz'}\n")
    (tmp_path / "p.toml").write_text('kmer_size = 12\nwindow_size = 9\nfragment_length = 300\nreference_lists = ["refs.txt"]\n')
    arguments = ["--params-file", str(tmp_path / "p.toml"), "--query", str(at / "a.fa"), "--window-size", "10", "--reference", str(at / "a.fa")]
    p = parse(arguments)
    assert (p.window_size, p.kmer_size) == (10, 12)
    assert [g.label for g in p.references] == [str(at / "b.fa.gz"), str(at / "a.fa")]
    rows = outcome(spark, replace(p, quiet=True))
    assert [r[1] for r in rows] == [g.label for g in p.references]
    assert main(["--query", str(at / "a.fa")]) == 1
    assert "error:" in capsys.readouterr().err


def test_standard_input(spark, folder, monkeypatch):
    at, _ = folder

    class Pipe:
        buffer = io.BytesIO((at / "a.fa.gz").read_bytes())

    expected = outcome(spark, settings(at, "a", "b"))
    monkeypatch.setattr("sys.stdin", Pipe)
    p = replace(settings(at, "a", "b"), queries=(Genome("-", "piped"),))
    assert [r[1:] for r in outcome(spark, p)] == [r[1:] for r in expected]


def test_log_lines(spark, folder):
    at, _ = folder
    log = io.StringIO()
    pipeline.run(replace(settings(at, "a", "b"), quiet=False, verbose=True), spark, io.StringIO(), log)
    lines = log.getvalue().splitlines()
    told = [tuple(x.split("=")[1] for x in line.split("\t")[1:3]) for line in lines if line.startswith("PROGRESS")]
    assert told[:2] == [("reference", "start"), ("reference", "ready")] and told[-1] == ("output", "written") and len(told) == 10
    counters = dict(x.split("=") for line in lines if line.startswith("METRICS") for x in line.split("\t")[1:])
    assert counters["index_shards"] == "1" and int(counters["index_hits"]) >= int(counters["index_keys"]) > 0
    binned = [dict(x.split("=") for x in line.split("\t")[1:]) for line in lines if line.startswith("SEED_HIT_BIN")]
    assert sum(int(b["hits"]) for b in binned) == int(counters["index_hits"])
    facts = dict(x.split("=") for x in lines[-1].split("\t")[1:])
    assert int(facts["candidate_regions"]) > 0 and facts["emitted_pairs"] == "1"
    assert all(float(facts[f"{f}_s"]) > 0 for f in ("reference_build", "mapping", "query_collect", "candidate_discovery"))


def test_frequent_keys_are_ignored(spark, folder):
    at, _ = folder
    all_keys = outcome(spark, settings(at, "b", "b"))
    fewer = outcome(spark, settings(at, "b", "b", max_reference_frequency=20.0))
    assert float(fewer[0][2]) > 90 and not math.isnan(float(all_keys[0][2]))


def test_no_usable_fragment(spark, folder):
    at, _ = folder
    with pytest.raises(ValueError, match="no usable"):
        outcome(spark, settings(at, "a", "b", fragment_length=5000, min_fragment_length=5000))


def test_tables_in_files_are_those_of_standard_output(spark, folder, tmp_path):
    at, _ = folder
    for changes in ({"header": True}, {"per_contig": True, "header": True}):
        p = settings(at, "ab", "abc", **changes)
        assert outcome(spark, replace(p, out=str(tmp_path / "out.tsv"))) == []
        assert [line.split("\t") for line in (tmp_path / "out.tsv").read_text().splitlines()] == outcome(spark, p)


def test_database_names_and_contig_numbers(spark, folder, tmp_path):
    at, _ = folder
    built = replace(settings(at, "", "ab"), reference_sketch=str(tmp_path / "db.sketch"))
    outcome(spark, built)
    named = replace(settings(at, "a", ""), reference_sketch=str(tmp_path / "db"))
    assert {r[1] for r in outcome(spark, named)} == {"a", "b"}
    contigs = spark.read.parquet(str(tmp_path / "db.sketch" / "contigs"))
    contigs.filter("contig_id <> 1").write.parquet(str(tmp_path / "fewer"))
    (tmp_path / "db.sketch" / "contigs").rename(tmp_path / "before")
    (tmp_path / "fewer").rename(tmp_path / "db.sketch" / "contigs")
    with pytest.raises(ValueError, match="numbered"):
        outcome(spark, named)
