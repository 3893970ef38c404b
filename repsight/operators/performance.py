"""M1 — sales performance per territory (operators 1-3).

Sales are reduced to one row per territory and year before the territory
dimension (bounded by geography; 25 nations on the fixtures) is joined to
them. Money stays an exact count of cents until the public output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import distinct_count, money_sum, pct_change, round_half_away, safe_div, to_money
from repsight.functions.ranking import ntile_window
from repsight.grains import SalesGrains
from repsight.params import Params

TERRITORY_ATTRS = ("market_potential_index", "competitor_intensity", "urban_index", "num_target_hcps")


def _yearly(sales: DataFrame | SalesGrains, rsd: float | None = None) -> DataFrame:
    if isinstance(sales, SalesGrains):
        return sales.territory_year()
    return (sales.groupBy("territory_id", "year")
            .agg(money_sum("revenue_usd").alias("revenue"),
                 money_sum("net_revenue_usd").alias("net_revenue"),
                 F.sum("units_sold").cast("bigint").alias("units"),
                 distinct_count("rep_id", rsd).alias("active_reps")))


def territory_year_rollup(sales: DataFrame, territories: DataFrame, p: Params | None = None) -> DataFrame:
    """#1 revenue, net revenue, units and distinct reps per territory, region and year."""
    return (_yearly(sales, p.approx_distinct_rsd if p else None).join(territories.select("territory_id", "region"), "territory_id")
            .select("territory_id", "region", "year", to_money("revenue").alias("revenue"),
                    to_money("net_revenue").alias("net_revenue"), "units", "active_reps"))


def _pivot(sales: DataFrame, p: Params) -> DataFrame:
    """Years to columns, money still in cents; ``active_reps`` is the max over the years."""
    y0, y1 = p.prior_year, p.current_year
    yr = F.col("year")
    return (_yearly(sales, p.approx_distinct_rsd).groupBy("territory_id")
            .agg(F.max(F.when(yr == y0, F.col("revenue"))).alias(f"rev_{y0}"),
                 F.max(F.when(yr == y1, F.col("revenue"))).alias(f"rev_{y1}"),
                 F.max(F.when(yr == y0, F.col("units"))).alias(f"units_{y0}"),
                 F.max(F.when(yr == y1, F.col("units"))).alias(f"units_{y1}"),
                 F.max("active_reps").alias("active_reps")))


def territory_year_pivot(sales: DataFrame, territories: DataFrame, p: Params) -> DataFrame:
    """#2 one row per territory with prior/current revenue and units."""
    y0, y1 = p.prior_year, p.current_year
    return (_pivot(sales, p).join(territories.select("territory_id", "region"), "territory_id")
            .select("territory_id", "region", to_money(f"rev_{y0}").alias(f"rev_{y0}"),
                    to_money(f"rev_{y1}").alias(f"rev_{y1}"), f"units_{y0}", f"units_{y1}", "active_reps"))


def _performance_base(sales: DataFrame, territories: DataFrame, p: Params) -> DataFrame:
    """Pivot joined to the territory attributes, money in cents (territories with sales only)."""
    dims = territories.select("territory_id", "region", "state", *TERRITORY_ATTRS)
    return _pivot(sales, p).join(dims, "territory_id")


def sales_performance(sales: DataFrame, territories: DataFrame, p: Params) -> DataFrame:
    """#3 pivot + territory attributes, YoY %, revenue per MPI point and revenue quintile."""
    y0, y1 = p.prior_year, p.current_year
    prev, cur = to_money(f"rev_{y0}"), to_money(f"rev_{y1}")
    out = _performance_base(sales, territories, p).select(
        "territory_id", "region", prev.alias(f"rev_{y0}"), cur.alias(f"rev_{y1}"),
        f"units_{y0}", f"units_{y1}", "active_reps", *TERRITORY_ATTRS,
        round_half_away(pct_change(cur, prev), 2).alias("yoy_growth_pct"),
        round_half_away(safe_div(cur, "market_potential_index"), 2).alias("revenue_per_mpi"),
        "state")
    # territories are a bounded dimension: the plain window is the right plan
    return ntile_window(out, p.revenue_tiles, [f"rev_{y1}", "territory_id"], "revenue_quintile")
