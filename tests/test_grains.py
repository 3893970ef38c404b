"""Grains from one pass over the facts give what the operators give over the facts."""

import pytest
from pyspark.sql import functions as F

from compare import diff, digest, spark_rows
from conftest import SF001
from repsight.grains import CALL_SETS, SALES_SETS, fact_grains
from repsight.plans.analysis import RESULTS, run_analysis
from repsight.plans.catalog import QUERIES
from repsight.plans.inspect import plan_text
from repsight.sources.fixtures import fixture_star
from test_edges import P, star  # noqa: F401  (module fixture reused)

#: Queries over grains: all but those that need single sales, or the fact's rows one by one.
OVER_GRAINS = ("territory_year_rollup", "sales_performance", "whitespace_analysis", "rep_sales_totals", "sfe_metrics", "hcp_coverage_gap", "product_month_rollup",
               "product_portfolio", "product_monthly_trend", "channel_product_territory_perf", "promotional_response", "promotional_response_weighted", "kpi_summary",
               "state_map", "dataset_summary", "state_revenue_spread")


@pytest.fixture(scope="module")
def grains(star001):
    return fact_grains(star001)


def compare(a, b, p, names):
    for name in names:
        x, y = spark_rows(QUERIES[name](a, p)), spark_rows(QUERIES[name](b, p))
        assert digest(*x) == digest(*y), (name, diff(*x, *y))


def test_grains_equal_facts(star001, grains, fp):
    compare(star001, grains, fp, OVER_GRAINS)


def test_grains_equal_facts_on_edges(spark, star):  # noqa: F811
    null_keys = star.sales.withColumn("rep_id", F.when(F.col("rep_id") != "R1", F.col("rep_id"))).withColumn("product_id", F.when(F.col("product_id") != "P2", F.col("product_id")))
    calls = star.call_logs.withColumn("month", F.when(F.col("hcp_id") != "H1", F.col("month")))
    odd = type(star)(star.territories, star.products, star.reps, star.physicians, null_keys, calls)
    for s in (star, odd, type(star)(star.territories, star.products, star.reps, star.physicians, star.sales.limit(0), star.call_logs.limit(0))):
        compare(s, fact_grains(s), P, [n for n in OVER_GRAINS if n not in ("rep_sales_totals",)])


def test_the_run_reads_each_fact_once(spark, fp, tmp_path, monkeypatch):
    facts = fixture_star(spark, SF001, fp)
    seen = []
    import repsight.plans.analysis as analysis
    real = analysis.write_result
    monkeypatch.setattr(analysis, "write_result", lambda df, *a: (seen.append(plan_text(df)), real(df, *a))[1])
    run_analysis(facts, fp, str(tmp_path / "out"), fmt="parquet")
    assert len(seen) == len(RESULTS) + 1
    assert not [t for t in seen if "lineitem.parquet" in t]      # every result comes from the grains


def test_one_aggregation_builds_all_sets(star001):
    for fact, sets in ((star001.sales, SALES_SETS), (star001.call_logs, CALL_SETS)):
        columns = list(dict.fromkeys(c for s in sets.values() for c in s))
        text = plan_text(fact.groupingSets([[F.col(c) for c in s] for s in sets.values()], *map(F.col, columns)).count())
        assert text.count("Scan parquet") == 2 and text.count("Arguments: hashpartitioning") == 1   # in the tree and in the details
