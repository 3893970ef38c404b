"""M6 — promotional response by channel (operators 24-27).

Channels are few, so the channel × product × territory cells collapse in
the map-side partial aggregation; the channel-level re-aggregation and the
two ranks then run over a handful of rows. Channel summary rates are the
*unweighted* mean of cell rates (the published rule); ``weighted=True`` gives
conversions over interactions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import (as_int, fixed_ratio, lookup, rate, round_half_away, round_mean_of_fixed,
                                      safe_div)
from repsight.functions.ranking import rank_window
from repsight.grains import CallGrains
from repsight.params import Params


def _cells(call_logs: DataFrame | CallGrains) -> DataFrame:
    if isinstance(call_logs, CallGrains):
        return call_logs.cells()
    return (call_logs.groupBy("channel", "product_promoted", "territory_id")
            .agg(F.count(F.lit(1)).alias("total_interactions"),
                 F.sum(as_int("converted")).cast("bigint").alias("conversions"),
                 F.sum("call_duration_min").cast("bigint").alias("_duration"),
                 F.sum(as_int("samples_dropped")).cast("bigint").alias("samples_dropped")))


def channel_product_territory_perf(call_logs: DataFrame) -> DataFrame:
    """#24 interactions, conversions, rate, mean duration and samples per channel × product × territory."""
    return _cells(call_logs).select(
        "channel", "product_promoted", "territory_id", "total_interactions", "conversions",
        safe_div("conversions", "total_interactions").alias("conversion_rate"),
        safe_div("_duration", "total_interactions").alias("avg_duration_min"), "samples_dropped")


def channel_summary(call_logs: DataFrame, weighted: bool = False) -> DataFrame:
    """#25 per channel: totals, conversion % and mean duration.

    Unweighted (default): means of the cell means of operator 24, each cell
    counting once whatever its size. Weighted: straight over the calls.
    """
    if weighted and isinstance(call_logs, CallGrains):
        total = lambda c: F.sum(c).cast("bigint")
        return call_logs.cells().groupBy("channel").agg(
            total("total_interactions").alias("total_interactions"), total("conversions").alias("total_conversions"),
            round_half_away(safe_div(total("conversions"), total("total_interactions")) * 100.0, 1).alias("avg_conversion_rate_pct"),
            round_half_away(safe_div(total("_duration"), total("total_interactions")), 1).alias("avg_duration_min"), total("samples_dropped").alias("total_samples_dropped"))
    if weighted:
        return (call_logs.groupBy("channel")
                .agg(F.count(F.lit(1)).alias("total_interactions"),
                     F.sum(as_int("converted")).cast("bigint").alias("total_conversions"),
                     round_half_away(rate("converted") * 100.0, 1).alias("avg_conversion_rate_pct"),
                     round_half_away(F.avg("call_duration_min"), 1).alias("avg_duration_min"),
                     F.sum(as_int("samples_dropped")).cast("bigint").alias("total_samples_dropped")))
    # each cell counts once; its rate and mean duration enter as exact fixed-point ratios, so the
    # means do not depend on the order in which partial sums meet
    return (_cells(call_logs).groupBy("channel")
            .agg(F.sum("total_interactions").cast("bigint").alias("total_interactions"),
                 F.sum("conversions").cast("bigint").alias("total_conversions"),
                 F.sum(fixed_ratio("conversions", "total_interactions")).alias("_rate_fx"),
                 F.sum(fixed_ratio("_duration", "total_interactions")).alias("_dur_fx"),
                 F.count(F.lit(1)).alias("_cells"),
                 F.sum("samples_dropped").cast("bigint").alias("total_samples_dropped"))
            .select("channel", "total_interactions", "total_conversions",
                    round_mean_of_fixed("_rate_fx", "_cells", 100.0, 1).alias("avg_conversion_rate_pct"),
                    round_mean_of_fixed("_dur_fx", "_cells", 1.0, 1).alias("avg_duration_min"),
                    "total_samples_dropped"))


def channel_cost(call_logs: DataFrame, p: Params) -> DataFrame:
    """#26 cost per interaction of every channel present (null for an unknown channel)."""
    rows = call_logs.cells() if isinstance(call_logs, CallGrains) else call_logs
    return (rows.select("channel").distinct()
            .select("channel", lookup("channel", p.channel_costs).cast("bigint").alias("cost_per_interaction")))


def promotional_response(call_logs: DataFrame, p: Params, weighted: bool | None = None) -> DataFrame:
    """#27 channel summary + cost, cost per conversion (from the rounded rate) and two ranks.

    ``weighted`` defaults to ``p.weighted_channel_rates``.
    """
    summary = channel_summary(call_logs, p.weighted_channel_rates if weighted is None else weighted)
    cost = channel_cost(call_logs, p)
    cpi = F.col("cost_per_interaction").cast("double")
    cpc = safe_div(cpi, F.col("avg_conversion_rate_pct") / F.lit(100.0))
    out = (summary.join(cost, "channel")
           .withColumn("total_channel_cost",
                       round_half_away(F.col("total_interactions").cast("double") * cpi, 0))
           .withColumn("_cpc", cpc)
           .withColumn("cost_per_conversion", round_half_away(F.col("_cpc"), 0)))
    # a handful of channels: plain windows
    out = rank_window(out, [F.col("avg_conversion_rate_pct").desc_nulls_last()], "conversion_rank")
    out = rank_window(out, [F.col("_cpc").asc_nulls_last()], "roi_rank")
    return out.drop("_cpc")
