"""Every registered query against its SQL counterpart, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from fixtures import SF_DIR
from workload.queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES = {k: v for k, v in entry_module.queries().items() if k in all_queries()}
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    have = rows(got.columns, [tuple(r) for r in got.collect()])
    want = rows(columns, cursor.fetchall())
    assert len(have) == len(want) > 0
    assert have == want


def test_entry(spark):
    if not SF_DIR.endswith("sf0.001"):
        pytest.skip("the entry query reads the smallest scale")
    assert entry_module.entry(spark).count() == 1
