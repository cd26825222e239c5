"""Every query with a DuckDB check agrees with it, in values and types."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from kadence.plans.queries import ORACLES, QUERIES

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for file in os.listdir(sf_dir):
        table = file.removesuffix(".parquet")
        con.execute(f"create view {table} as select * from '{sf_dir}/{file}'")
    return con


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    result = duck.execute(ORACLES[name])
    theirs_types = {d[0]: str(d[1]) for d in result.description}
    order = [d[0] for d in result.description]
    theirs = sorted(repr(tuple(r[order.index(n)] for n in names)) for r in result.fetchall())
    assert sorted(order) == names
    assert {n: TYPES[t] for n, t in df.dtypes} == theirs_types
    assert mine == theirs
    assert mine


def test_entry(spark):
    assert entry(spark).columns == [
        "salarie_id", "annee", "nb_activites", "est_eligible", "nb_jour_bien_etre"
    ]
