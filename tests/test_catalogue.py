"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidegrid.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    return c


def plain(frame):
    cols = sorted(frame.columns)
    value = lambda v: None if str(v) in ("nan", "<NA>", "None") else float(v) if not isinstance(v, str) else v
    return cols, sorted((tuple(map(value, row)) for row in frame[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, db, name):
    got, want = plain(catalogue.QUERIES[name](spark, D).toPandas()), plain(db.sql(catalogue.ORACLES[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, abs=2e-6, rel=1e-6) for x, y in zip(a, b))
