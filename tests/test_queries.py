"""Every registered query against its SQL twin on the same tables."""

import math

import duckdb
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.4f}"
        return str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert rows and plain(rows) == plain(want)
