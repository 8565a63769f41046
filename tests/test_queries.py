"""Every registered query that has an oracle gives the oracle's rows on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from plinth.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return plain(list(value.values()))
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, database, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    asked = database.execute(catalog.ORACLES[name])
    names = [x[0] for x in asked.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in asked.fetchall())
    got = sorted(tuple(map(plain, row)) for row in found.select(*[f"`{c}`" for c in columns]).collect())
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_oracle(spark, name):
    found = catalog.QUERIES[name](spark, DATA)
    assert len(set(found.columns)) == len(found.columns) and found.count() > 0
