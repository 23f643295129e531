import os

import duckdb
import pytest

import __spark_entry__ as entry
from stammwerk.plans import problems, reference

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="the provided tables are not here")
CORE = reference.Q | problems.queries()
SQL = reference.SQL | problems.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{ROOT}/{name}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, ROOT)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        expected = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
        assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(SQL) <= set(entry.oracle_sql()) and set(CORE) <= set(entry.queries())
