"""Data preparation steps, re-aimed from row loops to table jobs (operators 40-48).

The original generator walks reps, months and HCPs in nested Python loops.
Here its deterministic parts are joins, generators (``explode(sequence(..))``)
and aggregates; its random draw (#45) is no query and isn't rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import (bcg_label, deployment_label, lookup, money_sum, round_half_away, safe_div,
                                      to_money, wide_sum)
from repsight.functions.ranking import over_all, scalar
from repsight.grains import SalesGrains
from repsight.params import Params
from repsight.sources.schema import Star

def bcg_quadrant(products: DataFrame, p: Params) -> DataFrame:
    """#40 Star / Cash Cow / Question Mark / Dog from market share and market growth."""
    return (products.drop("bcg_quadrant")
            .withColumn("bcg_quadrant", bcg_label("market_share_pct", "market_growth_rate", p)))


def net_revenue(sales: DataFrame) -> DataFrame:
    """#41 revenue × (1 − discount), rounded to cents, exact decimal arithmetic."""
    rev, disc = F.col("revenue_usd").cast("decimal(18,2)"), F.col("discount_pct").cast("decimal(5,3)")
    return sales.withColumn("net_revenue_usd", F.round(rev * (F.lit(1) - disc), 2).cast("decimal(18,2)"))


def rep_region_enrichment(reps: DataFrame, territories: DataFrame) -> DataFrame:
    """#42 region of each rep, looked up through the rep's territory."""
    return (reps.select("rep_id", "territory_id")
            .join(territories.select("territory_id", "region"), "territory_id", "left")
            .select("rep_id", "territory_id", "region"))


def territory_hcp_share(territories: DataFrame) -> DataFrame:
    """#43 each territory's share of all target HCPs."""
    total = over_all(F.sum("num_target_hcps"))   # territories: a bounded dimension
    return territories.select("territory_id", "num_target_hcps",
                              safe_div("num_target_hcps", total).alias("hcp_share"))


def _tier_weight(p: Params) -> F.Column:
    return lookup("prescriber_tier", p.tier_weights_tenths, 0).cast("bigint")


def call_plan_weights(physicians: DataFrame, p: Params) -> DataFrame:
    """#44 call weight of each HCP by tier, normalised within its territory.

    The per-territory total is an aggregate (one row per territory) joined
    back, not a partitioned window, so a territory holding a third of all
    HCPs is not sorted in one task.
    """
    w = physicians.select("territory_id", "hcp_id", _tier_weight(p).alias("_w"))
    totals = w.groupBy("territory_id").agg(F.sum("_w").alias("_tot"))
    return (w.join(totals, "territory_id")
            .select("territory_id", "hcp_id", safe_div("_w", "_tot").alias("weight")))


def rep_month_spine(reps: DataFrame, sales: DataFrame, p: Params) -> DataFrame:
    """#46 every rep × every month of the period, with revenue and a silent-month flag."""
    start = F.lit(p.period_start)
    months = F.sequence(start, F.add_months(start, p.period_months - 1), F.expr("INTERVAL 1 MONTH"))
    spine = reps.select("rep_id", F.explode(months).alias("month"))
    monthly = sales.groupBy("rep_id", "month").agg(money_sum("revenue_usd").alias("_rev"))
    return (spine.join(monthly, ["rep_id", "month"], "left")
            .select("rep_id", "month", F.coalesce(to_money("_rev"), F.lit(0.0)).alias("revenue"),
                    F.col("_rev").isNull().alias("is_silent")))


def deployment_segment(reps: DataFrame, territories: DataFrame, p: Params) -> DataFrame:
    """#47 Underperforming / Oversaturated / Normal from territory MPI and rep productivity."""
    return (reps.select("rep_id", "territory_id", "productivity_score")
            .join(territories.select("territory_id", "market_potential_index"), "territory_id")
            .select("rep_id", "territory_id",
                    deployment_label("market_potential_index", "productivity_score", p).alias("deployment_segment")))


def dataset_summary(star: Star) -> DataFrame:
    """#48 row count per table, total revenue, first and last month (one row)."""
    if isinstance(star.sales, SalesGrains):
        monthly, calls = star.sales.month(), star.call_logs.total()
    else:
        monthly = star.sales.groupBy("month").agg(F.count(F.lit(1)).alias("_n"), money_sum("revenue_usd").alias("_rev"))
        calls = star.call_logs.agg(F.count(F.lit(1)).alias("n"))
    s = monthly.agg(F.sum("_n").cast("bigint").alias("sales"),
                    round_half_away(to_money(wide_sum("_rev")), 2).alias("total_revenue_usd"),
                    F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    n = lambda df: scalar(df.agg(F.count(F.lit(1)).alias("n")), "n")
    return s.select(n(star.territories).alias("territories"), n(star.products).alias("products"),
                    n(star.reps).alias("reps"), n(star.physicians).alias("physicians"), "sales",
                    scalar(calls, "n").alias("call_logs"), "total_revenue_usd", "first_month", "last_month")
