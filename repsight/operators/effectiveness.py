"""M3 — sales-force effectiveness per rep (operators 11-15).

Counts, sums and distinct counts come straight from the facts, so their
partial aggregation runs before the only shuffle. The quartile of a rep is
numbered in parallel (``ranking.ntile_distributed``), whatever the number of
reps, and the best rep's revenue per call is a one-row scalar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import (as_int, distinct_count, distinct_months, exact_mean, money_sum, once, round_half_away, safe_div,
                                      to_money)
from repsight.functions.ranking import exact_medians, ntile_distributed, rank_distributed, scalar
from repsight.grains import CallGrains, SalesGrains
from repsight.params import Params
from repsight.plans.session import ensure_checkpoint_dir


def _rep_sales_cents(sales: DataFrame | SalesGrains, p: Params | None = None) -> DataFrame:
    if isinstance(sales, SalesGrains):
        return sales.rep()
    p = p or Params()
    return (sales.groupBy("rep_id")
            .agg(money_sum("revenue_usd").alias("total_revenue"),
                 F.sum("units_sold").cast("bigint").alias("total_units"),
                 distinct_count("product_id", p.approx_distinct_rsd).alias("products_sold"),
                 distinct_months("month", p.month_words, p.approx_distinct_rsd).alias("active_months")))


def rep_sales_totals(sales: DataFrame, p: Params | None = None) -> DataFrame:
    """#11 revenue, units, distinct products and distinct active months per rep."""
    return _rep_sales_cents(sales, p).withColumn("total_revenue", to_money("total_revenue"))


def _call_aggregates(rsd: float | None) -> list[F.Column]:
    # two COUNT(DISTINCT ..)s: with the months as bits (``distinct_months``) every (rep, HCP) row would
    # carry all sums through the shuffle, measured at twice the bytes for a tenth less CPU
    return [F.count(F.lit(1)).alias("total_calls"), F.sum(as_int("converted")).cast("bigint").alias("total_conversions"),
            distinct_count("hcp_id", rsd).alias("unique_hcps_visited"), distinct_count("month", rsd).alias("months_active"),
            F.sum("call_duration_min").alias("_dur")]


def _call_ratios() -> list[F.Column]:
    return [safe_div("total_conversions", "total_calls").alias("conversion_rate"),
            safe_div("_dur", "total_calls").alias("avg_call_duration_min")]


def _tier_aggregates() -> list[F.Column]:
    return [F.sum(F.when(F.col("prescriber_tier") == t, 1).otherwise(0)).cast("bigint").alias(f"tier_{t.lower()}_calls")
            for t in ("A", "B", "C")]


def rep_call_stats(call_logs: DataFrame, p: Params | None = None) -> DataFrame:
    """#12 calls, conversions, rate, distinct HCPs and months, mean duration per rep."""
    rate, duration = _call_ratios()
    return (call_logs.groupBy("rep_id").agg(*_call_aggregates(p.approx_distinct_rsd if p else None))
            .select("rep_id", "total_calls", "total_conversions", rate, "unique_hcps_visited", "months_active", duration))


def rep_tier_mix(call_logs: DataFrame, physicians: DataFrame) -> DataFrame:
    """#13 calls to tier A / B / C HCPs per rep (0 when none)."""
    return (call_logs.select("rep_id", "hcp_id").join(physicians.select("hcp_id", "prescriber_tier"), "hcp_id")
            .groupBy("rep_id").agg(*_tier_aggregates()))


def _rep_calls(call_logs: DataFrame | CallGrains, physicians: DataFrame, rsd: float | None) -> DataFrame:
    """#12 and #13 in one pass over the calls; a rep needs a call to a known HCP, as #13 does."""
    rate, duration = _call_ratios()
    shown = ["rep_id", "total_calls", "total_conversions", rate, "unique_hcps_visited", "months_active", duration, "tier_a_calls", "tier_b_calls", "tier_c_calls"]
    if isinstance(call_logs, CallGrains):
        return call_logs.rep(physicians).where(F.col("_matched") > 0).select(*shown)
    known = physicians.select("hcp_id", "prescriber_tier", F.lit(1).alias("_known"))
    return (call_logs.select("rep_id", "hcp_id", "month", "converted", "call_duration_min").join(known, "hcp_id", "left")
            .groupBy("rep_id").agg(*_call_aggregates(rsd), *_tier_aggregates(), F.sum("_known").alias("_matched"))
            .where(F.col("_matched") > 0).select(*shown))


def _rep_frame(reps: DataFrame, sales: DataFrame, call_logs: DataFrame, physicians: DataFrame, p: Params) -> DataFrame:
    """One row per rep with both sales and calls; ``_rpc`` is the unrounded revenue per call."""
    base = (reps.select("rep_id", "rep_name", "territory_id", "region", "experience_years", "education")
            .join(_rep_sales_cents(sales, p), "rep_id")
            .join(_rep_calls(call_logs, physicians, p.approx_distinct_rsd), "rep_id")
            .withColumn("total_revenue", to_money("total_revenue"))
            .withColumn("_rpc", safe_div("total_revenue", "total_calls")))
    return base.select(
        "rep_id", "rep_name", "territory_id", "region", "experience_years", "education",
        "total_revenue", "total_units", "products_sold", "total_calls", "total_conversions",
        round_half_away(F.col("conversion_rate") * 100.0, 1).alias("conversion_rate_pct"),
        "unique_hcps_visited", "avg_call_duration_min", "tier_a_calls", "tier_b_calls", "tier_c_calls",
        round_half_away(safe_div(F.col("tier_a_calls").cast("double") * 100.0, "total_calls"), 1)
        .alias("tier_a_call_pct"),
        round_half_away(safe_div("total_calls", "months_active"), 1).alias("avg_monthly_calls"),
        round_half_away(F.col("_rpc"), 2).alias("revenue_per_call"),
        round_half_away(safe_div("total_revenue", "unique_hcps_visited"), 2).alias("revenue_per_hcp"),
        "_rpc")


def _indexed(frame: DataFrame) -> DataFrame:
    """``frame`` (cut off from its lineage) with ``_pi``, revenue per call against the best rep's."""
    best = scalar(frame.agg(F.max("_rpc").alias("best")), "best")
    return once(frame, "_pi", F.col("_rpc") / F.nullif(best, F.lit(0.0)) * 100.0)


def sfe_metrics(reps: DataFrame, sales: DataFrame, call_logs: DataFrame, physicians: DataFrame,
                p: Params) -> DataFrame:
    """#14 one row per rep with both sales and calls: rates, per-call and per-HCP revenue,
    productivity index against the best rep (null when no rep has revenue), revenue quartile.

    The numbering checkpoints the rep frame once; the best rep is a scalar over
    that written frame.
    """
    frame = _rep_frame(reps, sales, call_logs, physicians, p)
    out = _indexed(ntile_distributed(frame, p.rep_tiles, ["total_revenue", "rep_id"], "performance_quartile"))
    return out.select(*[c for c in out.columns if c not in ("_rpc", "_pi", "performance_quartile")],
                      round_half_away("_pi", 1).alias("productivity_index"), "performance_quartile")


def sfe_averages(sfe: DataFrame) -> DataFrame:
    """#15 mean revenue per call and mean productivity index over reps (of the rounded columns)."""
    return sfe.agg(exact_mean("revenue_per_call", 2).alias("avg_revenue_per_call"),
                   exact_mean("productivity_index", 1).alias("avg_productivity_index"))


def rep_averages(reps: DataFrame, sales: DataFrame, call_logs: DataFrame, physicians: DataFrame, p: Params) -> DataFrame:
    """#15 straight from the facts, for callers without #14: no numbering, and only what the two means need."""
    ensure_checkpoint_dir(reps.sparkSession)
    frame = _rep_frame(reps, sales, call_logs, physicians, p).select("revenue_per_call", "_rpc").checkpoint(eager=True)
    return sfe_averages(_indexed(frame).select("revenue_per_call", round_half_away("_pi", 1).alias("productivity_index")))


def rep_ranking(sales: DataFrame, p: Params | None = None) -> DataFrame:
    """Reps by revenue and by units, largest first: two ``RANK``s over an entity that grows with the data, ties share a place."""
    totals = sales.groupBy("rep_id").agg(money_sum("revenue_usd").alias("_cents"), F.sum("units_sold").cast("bigint").alias("total_units"),
                                         F.count(F.lit(1)).alias("n_sales"))
    ranked = rank_distributed(totals, [("_cents", "desc")], "revenue_rank")
    ranked = rank_distributed(ranked, [("n_sales", "desc")], "sales_rank")
    return ranked.select("rep_id", to_money("_cents").alias("total_revenue"), "total_units", "n_sales", "revenue_rank", "sales_rank")


def rep_medians(sales: DataFrame) -> DataFrame:
    """Exact medians over reps of revenue, units and number of sales, by distributed selection."""
    totals = sales.groupBy("rep_id").agg(to_money(money_sum("revenue_usd")).alias("revenue"), F.sum("units_sold").cast("bigint").alias("units"),
                                         F.count(F.lit(1)).alias("n_sales"))
    return exact_medians(totals, ["revenue", "units", "n_sales"])
