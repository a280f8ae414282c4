import re

import duckdb
import pyarrow as pa
import pytest

from strandloom.plans import report
from strandloom.plans.run_queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wanted():
    with duckdb.connect() as db:
        for name in ("fragments", "mappings", "ref_contigs"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
        rows = [r[0] for r in db.execute(ORACLE["contig_lines"]).fetchall()]
    return sorted(rows, key=lambda line: [int(x[1:]) for x in line.split("\t")[:3]])


def test_lines_of_contigs_are_neither_sorted_nor_shuffled(spark, wanted):
    made = QUERIES["contig_lines"](spark, DATA)
    assert [r.line for r in made.collect()] == wanted
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"rangepartitioning|Generate", plan)


def test_lines_are_the_same_in_tasks_of_any_size(spark, monkeypatch, wanted):
    monkeypatch.setattr(report, "TASK_LINES", 7)
    monkeypatch.setattr(report, "BATCH_LINES", 3)  # the driver's; the workers' is as it is
    made = QUERIES["contig_lines"](spark, DATA)
    assert made.rdd.getNumPartitions() > 10
    assert [r.line for r in made.collect()] == wanted


@pytest.mark.parametrize("batch", [1, 2, 3, 50])
def test_lines_are_the_same_in_batches_of_any_size(monkeypatch, batch):
    monkeypatch.setattr(report, "BATCH_LINES", batch)
    names = ["query_id", "first", "end", "kind", "place", "line", "query_contig", "name", "eligible_fragments", "shared_fragments", "shared_bases", *report._FIGURES]
    nothing = [None] * 10
    rows = [[1, 0, 5, report._SUMMARY, n, f"h{n}", None, *nothing, None, None] for n in range(3)]
    rows += [[1, 0, 5, report._CONTIG, None, None, n, f"c{n}", n + 1, *nothing] for n in range(4)]
    found = {(f, c) for f, c in ((0, 0), (0, 3), (3, 2), (4, 0), (4, 1), (4, 2), (4, 3))}
    rows += [[1, 0, 5, report._FOUND, f, None, c, None, None, 1, 300, *[90.0 + c] * 8] for f, c in sorted(found)]
    columns = [*zip(*rows, strict=True)]
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    pieces = [table.slice(n, 3) for n in range(0, len(rows), 3)]
    lines = [line for b in report._table_lines(iter(pieces), {1: "q"}, list("abcde")) for line in b.column(0).to_pylist()]
    numbers = lambda f, c: ["1", "300", *[f"{90 + c}.000"] * 8] if (f, c) in found else ["0", "0", *["NaN"] * 8]
    assert lines == ["h0", "h1", "h2", *["\t".join(["q", "abcde"[f], f"c{c}", str(c + 1), *numbers(f, c)]) for f in range(5) for c in range(4)]]


def test_parts_cover_every_file_once_in_order():
    for most in (1, 5, 6, 17, 1000):
        parts = report.plan_lines([(3, 4), (5, 0), (9, 20)], 7, most)
        assert [(q, f) for q, a, b, _ in parts for f in range(a, b)] == [(q, f) for q in (3, 5, 9) for f in range(7)]
        tasks = [t for *_, t in parts]
        assert tasks == sorted(tasks) and set(tasks) == set(range(tasks[-1] + 1))
    assert report.plan_lines([(0, 2), (1, 0)], 0, 10) == [(0, 0, 0, 0), (1, 0, 0, 0)]


def test_heads_missing_contigs_and_files_of_no_use(spark):
    contigs = spark.createDataFrame([(1, 0, "a", 2), (1, 1, None, 0), (2, 0, "z", 1)], "query_id int, query_contig int, name string, eligible_fragments long")
    figures = ", ".join(f"{c} double" for c in report._FIGURES)
    one = [99.12345] * 8
    found = spark.createDataFrame([(1, 5, 0, 2, 600, *one), (1, 6, 0, 1, 300, *one), (1, 5, 7, 1, 300, *one)], f"query_id int, file_id int, query_contig int, shared_fragments long, shared_bases long, {figures}")
    heads = spark.createDataFrame([(0, 1, 5, "h0"), (1, 0, None, "h1"), (1, 1, 5, "h15")], "query_id int, kind int, file_id int, line string")
    lines = [r.line for r in report.contig_table({0: "x", 1: "y", 2: "w"}, [(4, "r4"), (5, "r5")], contigs, found, heads).collect()]
    no, yes = "\t".join(["0", "0", *["NaN"] * 8]), "\t".join(["2", "600", *["99.123"] * 8])
    assert lines == ["h0", "h1", "h15", f"y\tr4\ta\t2\t{no}", f"y\tr4\t\t0\t{no}", f"y\tr5\ta\t2\t{yes}", f"y\tr5\t\t0\t{no}", f"w\tr4\tz\t1\t{no}", f"w\tr5\tz\t1\t{no}"]
