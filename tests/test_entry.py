"""The driver's contract, held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rollweave.plans import oracles, queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(oracles.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = [tuple(r[names.index(c)] for c in order) for r in found.fetchall()]
    got = [tuple(r[c] for c in order) for r in df.collect()]
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLES)
    assert set(queries.QUERIES) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_library_never_imports_the_training_operators():
    from pathlib import Path

    for p in Path(queries.__file__).resolve().parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
