"""Queries with SQL against DuckDB on whole tables."""

from collections import Counter

import duckdb
import pytest

from rootloom.llm import queries

SIZES = ("sf0.001", "sf0.01")


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name, size):
    sf = f"/root/testdata/{size}"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    want = Counter(found.fetchall())
    out = queries.queries()[name](spark, sf)
    assert sorted(out.columns) == sorted(cols) and want
    assert Counter(tuple(r) for r in out.select(*cols).collect()) == want
