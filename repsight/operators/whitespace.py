"""M2 — whitespace: market potential against actual revenue (operators 4-10).

Facts are aggregated to one row per territory *before* the joins, so the
joins only ever see territory-sized inputs; territories with no activity are
kept by left joins and zero-filled, and they enter the medians.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import (money_sum, rate, round_half_away, safe_div, to_money,
                                      whitespace_quadrant)
from repsight.functions.ranking import over_all
from repsight.grains import CallGrains, SalesGrains
from repsight.params import Params


def territory_sales_for_year(sales: DataFrame | SalesGrains, year: int) -> DataFrame:
    """#4 revenue and units per territory in one year."""
    if isinstance(sales, SalesGrains):
        return (sales.territory_year().where(F.col("year") == year)
                .select("territory_id", to_money("revenue").alias("total_revenue"), F.col("units").alias("total_units")))
    return (sales.where(F.col("year") == year).groupBy("territory_id")
            .agg(to_money(money_sum("revenue_usd")).alias("total_revenue"),
                 F.sum("units_sold").cast("bigint").alias("total_units")))


def territory_call_stats(call_logs: DataFrame | CallGrains, year: int) -> DataFrame:
    """#5 calls and conversion rate per territory in one year."""
    if isinstance(call_logs, CallGrains):
        return (call_logs.territory_year().where(F.col("year") == year)
                .select("territory_id", F.col("n").alias("total_calls"), safe_div("conversions", "n").alias("conversion_rate")))
    return (call_logs.where(F.col("year") == year).groupBy("territory_id")
            .agg(F.count(F.lit(1)).alias("total_calls"), rate("converted").alias("conversion_rate")))


def territory_potential(territories: DataFrame, sales: DataFrame, call_logs: DataFrame,
                        p: Params) -> DataFrame:
    """#6 every territory with zero-filled activity, potential and realization."""
    ts = territory_sales_for_year(sales, p.current_year)
    tc = territory_call_stats(call_logs, p.current_year)
    mpi = F.col("market_potential_index")
    potential = mpi * F.lit(p.revenue_per_mpi_point)
    actual = F.coalesce(F.col("total_revenue"), F.lit(0.0))
    # both aggregates hold at most one row per territory; the measured size decides how they join
    return (territories.join(ts, "territory_id", "left").join(tc, "territory_id", "left")
            .select("territory_id", "region", mpi.alias("mpi"), "competitor_intensity", "urban_index",
                    "num_target_hcps",
                    actual.alias("actual_revenue"),
                    F.coalesce(F.col("total_calls"), F.lit(0)).cast("bigint").alias("call_volume"),
                    F.coalesce(F.col("conversion_rate"), F.lit(0.0)).alias("conversion_rate"),
                    round_half_away(potential, 2).alias("potential_revenue"),
                    round_half_away(safe_div(actual, potential) * 100.0, 1).alias("realization_pct")))


def territory_medians(potential: DataFrame) -> DataFrame:
    """#7 exact (interpolated) medians of MPI and revenue over all territories."""
    return potential.agg(F.percentile("mpi", 0.5).alias("med_mpi"),
                         F.percentile("actual_revenue", 0.5).alias("med_revenue"))


def whitespace_analysis(territories: DataFrame, sales: DataFrame, call_logs: DataFrame,
                        p: Params) -> DataFrame:
    """#8 potential, medians, opportunity gap and quadrant per territory."""
    # one row per territory (a bounded dimension): the medians are windows over the whole frame,
    # sharing one small exchange instead of re-running the fact aggregates in a subquery
    pot = territory_potential(territories, sales, call_logs, p)
    return (pot.withColumn("med_mpi", over_all(F.percentile("mpi", 0.5)))
            .withColumn("med_revenue", over_all(F.percentile("actual_revenue", 0.5)))
            .withColumn("opportunity_gap_usd",
                        round_half_away(F.col("potential_revenue") - F.col("actual_revenue"), 2))
            .withColumn("whitespace_quadrant",
                        whitespace_quadrant("mpi", "actual_revenue", "med_mpi", "med_revenue")))


def quadrant_counts(ws: DataFrame) -> DataFrame:
    """#9 territories per quadrant."""
    return ws.groupBy("whitespace_quadrant").agg(F.count(F.lit(1)).alias("n"))


def whitespace_total_gap(ws: DataFrame) -> DataFrame:
    """#10 summed opportunity gap of the Whitespace quadrant (exact sum in cents)."""
    return (ws.where(F.col("whitespace_quadrant") == "Whitespace")
            .agg(F.coalesce(to_money(money_sum("opportunity_gap_usd")), F.lit(0.0)).alias("total_gap")))
