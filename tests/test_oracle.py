"""Every registered query against its independent DuckDB statement at sf0.01:
same rows, same column names, same values (exact, order-insensitive)."""

import pytest

import __spark_entry__ as entry
from compare import diff, digest, duck_rows, spark_rows
from conftest import SF001
from repsight.plans.catalog import INVENTORY_NUMBER

QUERIES = {n: q for n, q in entry.queries().items() if n in INVENTORY_NUMBER}
ORACLE = {n: s for n, s in entry.oracle_sql().items() if n in INVENTORY_NUMBER}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) == 57


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck001, name):
    sc, sd = spark_rows(QUERIES[name](spark, SF001))
    dc, dd = duck_rows(duck001, ORACLE[name])
    assert digest(sc, sd) == digest(dc, dd), diff(sc, sd, dc, dd)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 25
    assert {"whitespace_quadrant", "opportunity_gap_usd", "med_mpi", "med_revenue"} <= set(df.columns)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN"}


def test_column_types_match_oracle(spark, duck001):
    bad = {}
    for name, q in QUERIES.items():
        st = {c: SPARK_TO_DUCK.get(t, t) for c, t in q(spark, SF001).dtypes}
        rel = duck001.sql(ORACLE[name])
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        if st != dt:
            bad[name] = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
    assert not bad, bad


def test_inventory_numbers():
    assert sorted(set(INVENTORY_NUMBER.values())) == [i for i in range(1, 49) if i != 45]
    assert [INVENTORY_NUMBER[n] for n in ("whitespace_analysis", "sfe_metrics", "hcp_coverage_gap",
                                          "promotional_response", "kpi_summary", "state_map",
                                          "call_plan_weights", "dataset_summary")] == [8, 14, 17, 27, 29, 30, 44, 48]


def test_facts_are_whole_and_labels_all_occur(spark, star001, fp):
    one = QUERIES["dataset_summary"](spark, SF001).first()
    assert one.sales == one.call_logs == 60_000 and (one.last_month.year, one.first_month.year) == (2001, 1995)
    whole = QUERIES["kpi_sales"](spark, SF001).first()
    assert whole.total_revenue_all_years > 2 * (whole.total_revenue_1999 + whole.total_revenue_2000)
    assert {r.whitespace_quadrant for r in QUERIES["quadrant_counts"](spark, SF001).collect()} == {"Star", "Whitespace", "Saturated", "Abandon"}
    assert {r.bcg_quadrant for r in QUERIES["bcg_quadrant"](spark, SF001).collect()} == {"Star", "Cash Cow", "Question Mark", "Dog"}
    # every customer of the test tables has orders, so nobody is "Not Reached" (test_edges has such HCPs)
    assert {r.coverage_status for r in QUERIES["coverage_status_counts"](spark, SF001).collect()} == {"Critical Gap", "Undercovered", "Adequately Covered"}
