"""Registered queries against their SQL on the same tables."""

import duckdb
import pytest

from gridloom.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ALL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(oracles.ALL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in got.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want
