import os

import pytest

from narrata import further_queries, more_queries, queries  # noqa: F401  the first two register with the last

FOLDER = os.environ.get("NARRATA_TABLES", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = queries.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in queries.SQL:
        assert df.columns
        return
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    out = con.sql(queries.SQL[name])
    at = [out.columns.index(c) for c in sorted(df.columns)]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall())
