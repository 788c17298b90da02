"""Every registered query against its SQL on the smallest tables."""

import os
from pathlib import Path

import pytest

from leafspan.plans.registry import QUERIES, SQL

DATA = os.environ.get("LEAFSPAN_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")[:19]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    result = duck.execute(SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())


def test_names_are_paired():
    assert set(SQL) <= set(QUERIES)
