"""Every query of the menu against its SQL twin on the smallest tables."""

import os

import pytest

from weft.plans import menu

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "documents pages benchmark labels conversations embeddings events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_its_twin():
    assert menu.queries().keys() == menu.oracle_sql().keys()


@pytest.mark.parametrize("name", menu.queries())
def test_same_rows(spark, duck, name):
    df = menu.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    found = duck.execute(menu.oracle_sql()[name])
    at = [c[0] for c in found.description]
    assert sorted(at) == names
    assert got == sorted(repr(tuple(r[at.index(c)] for c in names)) for r in found.fetchall())
