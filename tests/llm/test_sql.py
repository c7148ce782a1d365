import duckdb
import pytest

from planforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = db.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = rel.select(", ".join(columns)).fetchall()
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(want)
