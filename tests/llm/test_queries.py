"""The pN_ queries run on given tables, with the columns asked for."""

import duckdb
import pytest

from litloom.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": "src string, row_id bigint, kind string, fixed string", "p2_found": "chunk_id bigint, boundary int, break_kind string", "p3_found": "chunk_a bigint, chunk_b bigint",
    "p4_found": "extraction_id bigint, field string, pos int, term_id bigint", "p6_found": "first_id bigint, copy_id bigint", "p8_found": "item_id bigint, doc_id bigint", "p9_found": "doc_id bigint, kind string",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows and (name not in COLUMNS or len(set(rows)) == len(rows))


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "paper"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, data).select(*columns).collect())
