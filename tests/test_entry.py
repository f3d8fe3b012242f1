"""Every query against its SQL on the smallest tables, as far as they are there."""

import glob
import os

import pytest

from quillstream import plans

D = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in plans.oracles():
        assert got
        return
    r = con.execute(plans.oracles()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want


def test_entry(spark, con):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_names_are_columns_of_plain_types(spark, con):
    for name in ("p2_found", "journal_match"):
        assert all(t in ("string", "bigint", "int", "boolean", "double") for _, t in plans.queries()[name](spark, D).dtypes)
