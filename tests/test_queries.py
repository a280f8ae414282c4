import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandloom.plans.engine_queries import ORACLE, QUERIES

SITES = {"GAT": "GAC", "CCA": "CTA"}


def letters(n, seed):
    rng, text = random.Random(seed), ""
    while len(text) < n:
        text += rng.choice("ACGT")
        for old, new in SITES.items():  # none of the replaced triples
            text = text.replace(old, new)
    return text[:n]


def diverging(seed, clean):
    """300 letters of which only `clean` in the middle have no replaced triple near them."""
    edge = "".join(letters(7, seed * 100 + k) + "GAT" for k in range(15))
    return (edge[: (300 - clean) // 2] + letters(clean, seed) + edge)[:300]


def write_contigs(folder, seqs):
    rows = [{"file_id": n, "contig_id": n + 1, "side": "query", "seq": seq} for n, seq in enumerate(seqs)]
    schema = pa.schema([("file_id", pa.int32()), ("contig_id", pa.int32()), ("side", pa.string()), ("seq", pa.string())])
    pq.write_table(pa.Table.from_pylist(rows, schema), folder / "contigs.parquet")


def sql_rows(name, folder):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW contigs AS SELECT * FROM '{folder}/contigs.parquet'")
        return db.execute(ORACLE[name]).fetchall()


def test_regions_of_few_shared_seeds_are_scored(spark, tmp_path):
    write_contigs(tmp_path, ["".join(diverging(n, 20 + n % 10) for n in range(60))])
    key = ["query_id", "fragment_id", "file_id", "contig_id"]
    hits = QUERIES["seed_hits"](spark, str(tmp_path)).groupBy(*key).count().collect()
    few = {tuple(r[:4]) for r in hits if r["count"] < 3}
    scored = QUERIES["window_scores"](spark, str(tmp_path))
    assert few & {tuple(r) for r in scored.select(*key).collect()}
    assert sorted(map(tuple, scored.collect())) == sorted(sql_rows("window_scores", tmp_path))


def test_genomes_of_diverged_fragments_have_rows(spark, tmp_path):
    write_contigs(tmp_path, ["".join(diverging(n, 20 + n % 10) for n in range(30)), "".join(diverging(n, 30) for n in range(30, 60))])
    rows = QUERIES["genome_ani"](spark, str(tmp_path)).select("query_id", "file_id", "shared_fragments", "ani").collect()
    shared = {tuple(r[:2]): r.shared_fragments for r in rows}
    assert shared[0, 0] > 0 and shared[1, 1] > 10
    assert min(r.ani for r in rows) < 90
    with_sql = sorted(sql_rows("genome_ani", tmp_path))
    assert [r[:2] for r in with_sql] == sorted(shared)
    assert [r[2] for r in with_sql] == pytest.approx([r.ani for r in sorted(rows)], abs=1e-5)
