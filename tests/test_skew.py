"""A third of the rows on one key: the operators still give whole, consistent answers.

Frames are generated by Spark (``range``), with one rep holding a third of
all sales, one HCP a third of all calls and one territory a third of all HCPs.
"""

import pytest
from pyspark.sql import functions as F

from repsight.operators import coverage, effectiveness, whitespace
from repsight.params import Params
from repsight.sources.schema import Star

P = Params()


@pytest.fixture(scope="module")
def hot(spark):
    n_sales, n_calls, n_hcp = 90_000, 60_000, 3_000
    terr = spark.range(10).select(
        F.col("id").alias("territory_id"), F.concat(F.lit("R"), (F.col("id") % 3).cast("string")).alias("region"),
        F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("state"),
        (F.lit(20.0) + F.col("id") * 7).alias("market_potential_index"), F.lit(0.5).alias("urban_index"),
        F.lit(0.5).alias("competitor_intensity"), F.lit(100).cast("bigint").alias("num_target_hcps"),
        F.lit(500).cast("bigint").alias("population_000s"))
    reps = spark.range(100).select(
        F.col("id").alias("rep_id"), F.concat(F.lit("Rep "), F.col("id").cast("string")).alias("rep_name"),
        (F.col("id") % 10).alias("territory_id"), F.lit("R0").alias("region"), F.lit(3).alias("experience_years"),
        F.lit("MBA").alias("education"), (F.lit(0.3) + (F.col("id") % 7) / 10).alias("productivity_score"))
    # territory 0 holds a third of the HCPs
    phys = spark.range(n_hcp).select(
        F.col("id").alias("hcp_id"), F.lit("Dr").alias("hcp_name"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 10).cast("bigint").alias("territory_id"),
        F.lit("GP").alias("specialty"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int"))
        .alias("prescriber_tier"),
        (F.col("id") % 90 + 2).alias("monthly_rx_volume"), F.lit("Academic").alias("hospital_affiliation"),
        F.lit("High").alias("digital_engagement"))
    # rep 0 holds a third of the sales
    rep = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100).cast("bigint")
    month_idx = (F.col("id") % 24).cast("int")
    month = F.add_months(F.lit("2023-01-01").cast("date"), month_idx)
    sales = spark.range(n_sales).select(
        rep.alias("rep_id"), (rep % 10).alias("territory_id"),
        F.concat(F.lit("P"), (F.col("id") % 4).cast("string")).alias("product_id"), month.alias("month"),
        F.year(month).alias("year"), F.month(month).alias("month_num"), (F.col("id") % 9 + 1).alias("units_sold"),
        ((F.col("id") % 1000 + 1) / 10).cast("decimal(18,2)").alias("revenue_usd"),
        F.lit(0.1).cast("decimal(5,3)").alias("discount_pct"),
        ((F.col("id") % 1000 + 1) / 10 * 0.9).cast("decimal(18,2)").alias("net_revenue_usd"))
    # HCP 0 receives a third of the calls
    hcp = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % n_hcp).cast("bigint")
    calls = spark.range(n_calls).select(
        (F.col("id") % 100).alias("rep_id"), hcp.alias("hcp_id"), (F.col("id") % 10).alias("territory_id"),
        F.lit("P1").alias("product_promoted"), month.alias("call_date"), month.alias("month"),
        F.year(month).alias("year"), F.month(month).alias("month_num"),
        F.when(F.col("id") % 7 == 0, "Conference").otherwise("In-Person Visit").alias("channel"),
        F.lit("x").alias("call_outcome"), (F.col("id") % 5 == 0).alias("converted"),
        (F.col("id") % 40 + 5).alias("call_duration_min"), (F.col("id") % 2 == 0).alias("samples_dropped"))
    products = spark.range(4).select(
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("product_id"), F.lit("n").alias("name"),
        F.lit("a").alias("therapeutic_area"), F.lit(2020).alias("launch_year"), F.lit(100).cast("bigint")
        .alias("list_price"), F.lit(0.2).alias("market_share_pct"), F.lit(0.2).alias("market_growth_rate"),
        F.lit("Star").alias("bcg_quadrant"))
    return Star(territories=terr, products=products, reps=reps, physicians=phys, sales=sales, call_logs=calls)


def test_skew_join_splitting_is_on(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_hot_rep_sfe_is_whole(hot):
    sfe = effectiveness.sfe_metrics(hot.reps, hot.sales, hot.call_logs, hot.physicians, P)
    rows = {r.rep_id: r for r in sfe.collect()}
    assert len(rows) == 100
    want = hot.sales.agg(F.sum(F.col("revenue_usd").cast("double"))).first()[0]
    assert abs(sum(r.total_revenue for r in rows.values()) - want) < 0.01
    assert rows[0].total_revenue > sum(r.total_revenue for k, r in rows.items() if k != 0) / 3
    assert rows[0].performance_quartile == 4
    assert sum(r.total_calls for r in rows.values()) == hot.call_logs.count()


def test_hot_hcp_coverage_is_whole(hot):
    cov = {r.hcp_id: r for r in coverage.hcp_coverage_gap(hot.physicians, hot.call_logs, P).collect()}
    assert len(cov) == 3_000
    assert cov[0].total_calls_received == 20_000
    assert sum(r.total_calls_received for r in cov.values()) == 60_000


def test_hot_territory_whitespace(hot):
    ws = whitespace.whitespace_analysis(hot.territories, hot.sales, hot.call_logs, P).collect()
    assert len(ws) == 10 and len({r.med_revenue for r in ws}) == 1
