"""Every registered query of the library gives the rows of its SQL."""

import os

import duckdb
import pytest

from rillgrid.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        at = f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    return repr(float(x)) if isinstance(x, float) else str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, db, name):
    made = QUERIES[name](spark, SF)
    got = made.collect()
    if name not in ORACLES:
        assert got
        return
    want = db.sql(ORACLES[name])
    described = [r[:2] for r in db.sql(f"DESCRIBE {ORACLES[name]}").fetchall()]
    assert sorted((c, TYPES[t]) for c, t in made.dtypes) == sorted(described)
    assert rows(made.columns, got) == rows([c for c, _ in described], want.fetchall())
