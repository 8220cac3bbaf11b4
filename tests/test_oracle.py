"""Every registered query against its SQL twin."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from pagelake.plans import oracles, registered

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES = registered.registered()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = db.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    actual = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, actual)) == sorted(map(repr, expected))


def test_entry_registers_the_library():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
