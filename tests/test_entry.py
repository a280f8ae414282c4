import re

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_and_sql_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values())
    assert not any(re.search(r"\blimit\b", text, re.IGNORECASE) for text in sql.values())


def test_flagship_query(spark):
    found = entry.entry(spark)
    assert found.columns[:3] == ["query_id", "file_id", "ani"]
    assert found.count() > 0


def test_core_queries_run_on_the_smallest_tables(spark):
    for name in ("p4_found", "p5_found", "split_n_segments", "pair_ani", "shard_plan", "mapping_stats"):
        assert entry.queries()[name](spark, DATA).count() > 0
