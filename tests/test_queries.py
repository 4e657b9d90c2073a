"""Every query against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from veracity.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that are not run here.
SPARED: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SPARED))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    got = rows(found.columns, found.collect())
    assert got
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(found.columns) == sorted(names)
        assert got == rows(names, want.fetchall())
