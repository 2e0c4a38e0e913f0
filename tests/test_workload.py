"""A few registered queries against DuckDB on the smallest tables; tools/check_oracle.py runs all of them."""

import collections
import os

import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
KEYS = ["q_top_projects", "q_dept_by_employee", "job_extract", "job_match", "answer_question_log", "ema_success_rate"]


def test_keys():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 130


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
@pytest.mark.parametrize("key", KEYS)
def test_same_rows(spark, key):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for name in os.listdir(BASE):
        duck.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{BASE}/{name}')")
    frame = entry.queries()[key](spark, BASE)
    columns = sorted(frame.columns)
    result = duck.execute(entry.oracle_sql()[key])
    names = [c[0] for c in result.description]
    want = collections.Counter(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    assert collections.Counter(tuple(r[c] for c in columns) for r in frame.collect()) == want


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
