"""Queries that SQL can express against DuckDB."""

import duckdb
import pytest

from latticemix.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = queries.queries()[name](spark, sf_dir).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
