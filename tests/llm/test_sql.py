"""The corpus queries that have SQL against DuckDB on the same tables."""

import duckdb
import pytest

from veriscope.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    got, wanted = queries()[name](spark, sf), con.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert len(set(rows)) > 1 and rows == sorted(map(repr, wanted.select(*[f'"{c}"' for c in columns]).fetchall()))
