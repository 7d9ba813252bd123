"""The registry: every query runs on the small tables; those with SQL agree with DuckDB on a few of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("CORPUSLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 24 and len({r.position for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["q_snippet_score", "q_chunk_pack", "q_heading_ancestry", "q_extract_dedupe_run", "q_timing_compare", "q_concurrency_gauge", "q_verify_drop_reasons", "q_glob", "q_attr_map", "q_contracts", "q_snippet_pack", "q_token_chunks", "q_plan_chunks", "q_reduce_batches"])
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    got = entry.queries()[name](spark, FOLDER)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({entry.oracle_sql()[name]})").limit(10**7).fetchall()
    show = lambda v: "" if v is None else f"{float(v):.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(show, r)) for r in got.select(*names).collect()) == sorted(tuple(map(show, r)) for r in want)
