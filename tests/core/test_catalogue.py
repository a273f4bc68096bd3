"""Every catalogue query with SQL equals DuckDB on the small tables."""

import os

import pytest

from driftwell.plans import all_queries, all_sql
from driftwell.sources.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return int(v) if isinstance(v, bool) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_equals_sql(spark, duck, name):
    got = all_queries()[name](spark, SF)
    want = duck.execute(all_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-6, abs=2e-6) if all(isinstance(v, int | float) for v in x) else repr(x) == repr(y)


def test_queries_without_sql_run(spark):
    for name in sorted(set(all_queries()) - set(all_sql())):
        all_queries()[name](spark, SF).collect()
