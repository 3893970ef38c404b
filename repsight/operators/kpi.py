"""Executive KPIs (operators 28-29): one-row results.

The original labels the all-years revenue as the current year's; both are
emitted here under honest names (``total_revenue_all_years`` and
``total_revenue_<current year>``). Whitespace and coverage results come in
as DataFrames, so a caller that also writes them can cache them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import distinct_count, money_sum, pct_change, round_half_away, safe_div, to_money, wide_sum
from repsight.functions.ranking import scalars
from repsight.grains import SalesGrains
from repsight.params import Params


def kpi_sales(sales: DataFrame, p: Params) -> DataFrame:
    """#28 revenue (all years, current, prior), growth %, active territories and reps, revenue per rep."""
    y0, y1 = p.prior_year, p.current_year
    if isinstance(sales, SalesGrains):
        fine = sales.year_territory_rep()
    else:
        fine = sales.groupBy("year", "territory_id", "rep_id").agg(money_sum("revenue_usd").alias("_rev"))
    yr, rev = F.col("year"), F.col("_rev")
    agg = fine.agg(to_money(wide_sum(rev)).alias("_all"),
                   to_money(wide_sum(F.when(yr == y0, rev))).alias("_prior"),
                   to_money(wide_sum(F.when(yr == y1, rev))).alias("_cur"),
                   distinct_count(F.when(yr == y1, F.col("territory_id")), p.approx_distinct_rsd)
                   .alias("active_territories"),
                   distinct_count(F.when(yr == y1, F.col("rep_id")), p.approx_distinct_rsd).alias("active_reps"))
    return agg.select(
        round_half_away("_all", 0).alias("total_revenue_all_years"),
        round_half_away("_cur", 0).alias(f"total_revenue_{y1}"),
        round_half_away("_prior", 0).alias(f"total_revenue_{y0}"),
        round_half_away(pct_change("_cur", "_prior"), 1).alias("revenue_growth_pct"),
        "active_territories", "active_reps",
        round_half_away(safe_div("_cur", "active_reps"), 0).alias("revenue_per_rep"))


def kpi_summary(sales: DataFrame, ws: DataFrame, coverage: DataFrame, p: Params) -> DataFrame:
    """#29 sales KPIs + whitespace opportunity, annual revenue at risk and the two counts."""
    white = ws.where(F.col("whitespace_quadrant") == "Whitespace").agg(
        F.coalesce(to_money(money_sum("opportunity_gap_usd")), F.lit(0.0))
        .alias("gap"),
        F.count(F.lit(1)).alias("n"))
    crit = coverage.where(F.col("coverage_status") == "Critical Gap").agg(
        F.coalesce(F.sum("estimated_monthly_revenue_potential"), F.lit(0.0)).alias("monthly"),
        F.count(F.lit(1)).alias("n"))
    # bind each one-row frame once (a struct-valued scalar subquery), then derive from the
    # bound columns: a subquery referenced inside rounding would otherwise be copied per use
    bound = kpi_sales(sales, p).select("*", scalars(white).alias("_w"), scalars(crit).alias("_c"))
    return bound.select(
        *[c for c in bound.columns if c not in ("_w", "_c")],
        round_half_away(F.col("_w.gap"), 0).alias("total_whitespace_opportunity"),
        round_half_away(F.col("_c.monthly") * F.lit(float(p.months_per_year)), 0)
        .alias("annual_revenue_at_risk_critical_gaps"),
        F.col("_w.n").alias("whitespace_territories"),
        F.col("_c.n").alias("critical_gap_hcps"))
