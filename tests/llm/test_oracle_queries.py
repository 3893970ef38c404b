"""Queries that SQL can state agree with DuckDB, value by value."""

import duckdb
import pytest

from repsight.llm.queries import ORACLE_SQL, QUERIES
from llm.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(llm, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](llm, SF)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    order = [want.columns.index(c) for c in names]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
