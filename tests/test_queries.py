"""Registered queries against DuckDB on the small tables, plan shapes, and the driver's contract."""

from __future__ import annotations

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.5f}"
    if isinstance(v, int):
        return f"{float(v):.5f}"
    return str(v).replace("+00:00", "")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    r = con.execute(SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(cols, row))) for row in r.fetchall())
    got = sorted(tuple(plain(row[c]) for c in sorted(df.columns)) for row in df.collect())
    assert got == want


def test_names():
    assert set(SQL) <= set(QUERIES) and "p1_found" in QUERIES


def test_entry(spark, sf):
    assert entry.entry(spark).limit(1).count() == 1


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(QUERIES["fresh_files"](spark, sf))
    assert "EqualTo(provenance,source)" in p and "Not(EqualTo(stale,true))" in p
    assert "text" not in p.split("ReadSchema")[1].split("\n")[0]
    assert "text" not in plan(QUERIES["default_ignored_paths"](spark, sf)).split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["p1_found", "hybrid_search", "dependency_neighbors", "symbol_match", "bm25_topk", "module_edges"])
def test_no_nested_loops(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES["largest_files"](spark, sf))
