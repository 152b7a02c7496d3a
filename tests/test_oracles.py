"""Every plan against its SQL on the smallest driver tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

from rimflow.config import TRACE
from rimflow.plans import core, registry

DATA = Path("/root/testdata/sf0.001")
PLANS = registry.plans(TRACE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    return round(x, 9) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan_equals_sql(spark, duck, name):
    df = core.query(PLANS[name])(spark, str(DATA))
    found = duck.sql(core.oracle(PLANS[name]))
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    ours = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert ours == theirs
