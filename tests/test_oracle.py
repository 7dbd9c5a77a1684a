"""Every query that SQL can express gives what the SQL gives; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from litloom.plans import catalogue


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=key)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_run(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    assert df.columns and (df.count() > 0 or name == "future_work_clusters")  # few statements here, none alike


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"id", "score"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pool_is_limited_before_the_window(spark, data, capsys):
    catalogue.text_topk_bm25(spark, data).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan
