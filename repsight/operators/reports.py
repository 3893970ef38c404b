"""Dashboard datasets and findings (operators 30-39).

All are aggregates or filters over the module results; none sorts except
``top_territories``, whose limit is the feature (a top-n table).
``max_by`` / ``min_by`` over a (value, key) struct pick an extreme row per
group in one partial aggregation, with ties broken by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import (cents, exact_mean, money_sum, pct_change, round_half_away, safe_div, to_money,
                                      wide_sum)
from repsight.operators.performance import _performance_base
from repsight.params import Params


def state_map(sales: DataFrame, territories: DataFrame, ws: DataFrame, p: Params) -> DataFrame:
    """#30 per state: revenue, territory count and YoY from territories with sales; gap and
    whitespace count from all territories of the state; states without sales drop out."""
    y0, y1 = p.prior_year, p.current_year
    perf = (_performance_base(sales, territories, p).groupBy("state")
            .agg(to_money(wide_sum(f"rev_{y1}")).alias("_cur"),
                 to_money(wide_sum(f"rev_{y0}")).alias("_prior"),
                 F.count(F.lit(1)).alias("territory_count")))
    gaps = (ws.join(territories.select("territory_id", "state"), "territory_id")
            .groupBy("state")
            .agg(to_money(money_sum("opportunity_gap_usd")).alias("_gap"),
                 F.count(F.when(F.col("whitespace_quadrant") == "Whitespace", F.lit(1))).alias("whitespace_count")))
    return (perf.join(gaps, "state", "left")      # one row per state: bounded
            .select("state", round_half_away("_cur", 0).alias(f"rev_{y1}"), F.col("_prior").alias(f"rev_{y0}"),
                    "territory_count", round_half_away(pct_change("_cur", "_prior"), 1).alias("yoy_growth_pct"),
                    round_half_away("_gap", 0).alias("opportunity_gap"), "whitespace_count"))


def revenue_by_region(sales: DataFrame, territories: DataFrame, p: Params) -> DataFrame:
    """#31 current-year revenue per region (territories with sales)."""
    return (_performance_base(sales, territories, p).groupBy("region")
            .agg(to_money(wide_sum(f"rev_{p.current_year}")).alias("revenue")))


def top_territories(sales: DataFrame, territories: DataFrame, p: Params, n: int | None = None) -> DataFrame:
    """#32 the ``n`` territories with the highest current-year revenue (ties by id)."""
    return (_performance_base(sales, territories, p)
            .select("territory_id", "region", "state", to_money(f"rev_{p.current_year}").alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_last(), F.col("territory_id").asc())
            .limit(n or p.top_n))


def whitespace_kpis(ws: DataFrame) -> DataFrame:
    """#33 whitespace count, whitespace gap, star count, mean realization %."""
    q = F.col("whitespace_quadrant")
    return ws.agg(
        F.count(F.when(q == "Whitespace", F.lit(1))).alias("whitespace_territories"),
        F.coalesce(to_money(F.sum(F.when(q == "Whitespace", cents("opportunity_gap_usd")))), F.lit(0.0))
        .alias("total_gap"),
        F.count(F.when(q == "Star", F.lit(1))).alias("star_territories"),
        round_half_away(exact_mean("realization_pct", 1), 1).alias("avg_realization_pct"))


def quadrant_scatter(ws: DataFrame) -> DataFrame:
    """#34 MPI against revenue per territory, with the medians and the quadrant."""
    return ws.select("territory_id", "region", "mpi", "actual_revenue", "med_mpi", "med_revenue",
                     "whitespace_quadrant")


def filter_scope(df: DataFrame, region: str | None = None, territory_id=None) -> DataFrame:
    """#35 page-wide region / territory filter, applied to finished results (after medians and ranks)."""
    if region is not None:
        df = df.where(F.col("region") == region)
    if territory_id is not None:
        df = df.where(F.col("territory_id") == territory_id)
    return df


def high_potential_low_realization(ws: DataFrame, p: Params) -> DataFrame:
    """#36 territories with MPI above the cut and realization below the cut."""
    return ws.where((F.col("mpi") > p.high_potential_mpi) & (F.col("realization_pct") < p.low_realization_pct))


def coverage_mandate_list(coverage: DataFrame, p: Params) -> DataFrame:
    """#37 HCPs prescribing above the mandate volume and visited less than the mandate rate,
    with their annual revenue potential."""
    return (coverage.where((F.col("monthly_rx_volume") > p.mandate_rx)
                           & (F.col("avg_monthly_calls") < p.mandate_visits))
            .withColumn("annual_revenue_potential",
                        F.col("estimated_monthly_revenue_potential") * F.lit(float(p.months_per_year))))


def coverage_mandate_tier(coverage: DataFrame, p: Params) -> DataFrame:
    """#37, second list: HCPs of the mandate tier visited less than the mandate rate, with their annual revenue potential."""
    return (coverage.where((F.col("prescriber_tier") == p.mandate_tier) & (F.col("avg_monthly_calls") < p.mandate_visits))
            .withColumn("annual_revenue_potential",
                        F.col("estimated_monthly_revenue_potential") * F.lit(float(p.months_per_year))))


def channel_cost_ratio(promo: DataFrame) -> DataFrame:
    """#38 dearest and cheapest channel by cost per conversion, and their ratio."""
    cpc, ch = F.col("cost_per_conversion"), F.col("channel")
    return (promo.where(cpc.isNotNull())
            .agg(F.min_by(ch, F.struct(-cpc, ch)).alias("dearest_channel"),
                 F.min_by(ch, F.struct(cpc, ch)).alias("cheapest_channel"),
                 round_half_away(safe_div(F.max(cpc), F.min(cpc)), 1).alias("cost_ratio")))


def state_revenue_spread(sales: DataFrame, territories: DataFrame, p: Params) -> DataFrame:
    """#39 per state: top and bottom territory by current-year revenue, and their ratio."""
    rev, tid = F.col(f"rev_{p.current_year}"), F.col("territory_id")
    return (_performance_base(sales, territories, p).where(rev.isNotNull())
            .groupBy("state")
            .agg(F.min_by(tid, F.struct(-rev, tid)).alias("top_territory"),
                 F.max(rev).alias("_top"),
                 F.min_by(tid, F.struct(rev, tid)).alias("bottom_territory"),
                 F.min(rev).alias("_bottom"))
            .select("state", "top_territory", to_money("_top").alias("top_revenue"),
                    "bottom_territory", to_money("_bottom").alias("bottom_revenue"),
                    round_half_away(safe_div(to_money("_top"), to_money("_bottom")), 1).alias("revenue_ratio")))
