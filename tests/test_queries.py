"""Every query with SQL gives the SQL's rows; every other one runs."""

import math
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans import queries as ledger_queries

QUERIES, ORACLES = ledger_queries.queries(), ledger_queries.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        return
    wanted = duck.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in wanted.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == expected
