"""M4 — HCP coverage gap (operators 16-19).

Calls are reduced per HCP straight from the facts (counts and distinct counts
aggregate partially before the shuffle), then the HCP dimension is left-joined so that
unreached HCPs stay, zero-filled. At scale both sides are keyed by ``hcp_id``
and the aggregate's output partitioning feeds the join directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import as_int, coverage_status, distinct_count, distinct_months, lookup, round_half_away, safe_div
from repsight.functions.ranking import exact_medians, rank_distributed
from repsight.grains import CallGrains
from repsight.params import Params

PHYSICIAN_COLS = ("hcp_id", "hcp_name", "territory_id", "specialty", "prescriber_tier", "monthly_rx_volume",
                  "hospital_affiliation", "digital_engagement")


def hcp_call_stats(call_logs: DataFrame | CallGrains, p: Params) -> DataFrame:
    """#16 calls, distinct reps and months, conversion rate and calls per month of the fixed period."""
    if isinstance(call_logs, CallGrains):
        grouped = call_logs.hcp()
    else:
        grouped = call_logs.groupBy("hcp_id").agg(F.count(F.lit(1)).alias("total_calls_received"),
                                                  distinct_count("rep_id", p.approx_distinct_rsd).alias("unique_reps"),
                                                  distinct_months("month", p.month_words, p.approx_distinct_rsd).alias("months_contacted"),
                                                  F.sum(as_int("converted")).alias("_conv"))
    return (grouped.select("hcp_id", "total_calls_received", "unique_reps", "months_contacted",
                    safe_div("_conv", "total_calls_received").alias("conversion_rate"),
                    (F.col("total_calls_received").cast("double") / F.lit(float(p.period_months)))
                    .alias("avg_monthly_calls")))


def monthly_potential(rx, tier, p: Params) -> F.Column:
    """Rx per month × revenue per Rx × tier factor, rounded to whole dollars."""
    factor = lookup(tier, p.tier_factors, p.other_tier_factor).cast("double")
    return round_half_away(F.col(rx).cast("double") * F.lit(p.revenue_per_rx) * factor, 0)


def hcp_coverage_gap(physicians: DataFrame, call_logs: DataFrame, p: Params) -> DataFrame:
    """#17 every HCP with zero-filled call stats, coverage status and monthly revenue potential."""
    hc = hcp_call_stats(call_logs, p)
    z = lambda c, zero: F.coalesce(F.col(c), F.lit(zero))
    return (physicians.select(*PHYSICIAN_COLS).join(hc, "hcp_id", "left")
            .select(*PHYSICIAN_COLS,
                    z("total_calls_received", 0).cast("bigint").alias("total_calls_received"),
                    z("unique_reps", 0).cast("bigint").alias("unique_reps_visited"),
                    z("months_contacted", 0).cast("bigint").alias("months_contacted"),
                    z("avg_monthly_calls", 0.0).alias("avg_monthly_calls"),
                    z("conversion_rate", 0.0).alias("conversion_rate"),
                    coverage_status("prescriber_tier", z("avg_monthly_calls", 0.0),
                                    z("total_calls_received", 0), p).alias("coverage_status"),
                    monthly_potential("monthly_rx_volume", F.col("prescriber_tier"), p)
                    .alias("estimated_monthly_revenue_potential")))


def hcp_ranking(physicians: DataFrame, call_logs: DataFrame) -> DataFrame:
    """Every HCP by calls received, most first, and by Rx volume: ``RANK`` over all HCPs, most of them tied."""
    calls = call_logs.groupBy("hcp_id").agg(F.count(F.lit(1)).alias("_n"))
    frame = physicians.select("hcp_id", "monthly_rx_volume").join(calls, "hcp_id", "left").select(
        "hcp_id", "monthly_rx_volume", F.coalesce("_n", F.lit(0)).cast("bigint").alias("total_calls_received"))
    return rank_distributed(rank_distributed(frame, [("total_calls_received", "desc")], "call_rank"), [("monthly_rx_volume", "desc")], "rx_rank")


def hcp_medians(physicians: DataFrame, call_logs: DataFrame) -> DataFrame:
    """Exact medians over all HCPs of Rx volume and calls received (unreached HCPs count with 0)."""
    calls = call_logs.groupBy("hcp_id").agg(F.count(F.lit(1)).alias("_n"))
    frame = physicians.select("hcp_id", "monthly_rx_volume").join(calls, "hcp_id", "left")
    return exact_medians(frame.select("monthly_rx_volume", F.coalesce("_n", F.lit(0)).alias("calls")), ["monthly_rx_volume", "calls"])


def coverage_status_counts(coverage: DataFrame) -> DataFrame:
    """#18 HCPs per coverage status."""
    return coverage.groupBy("coverage_status").agg(F.count(F.lit(1)).alias("n"))


def critical_gap_revenue(coverage: DataFrame) -> DataFrame:
    """#19 monthly revenue potential of the Critical Gap HCPs."""
    return (coverage.where(F.col("coverage_status") == "Critical Gap")
            .agg(F.coalesce(F.sum("estimated_monthly_revenue_potential"), F.lit(0.0))
                 .alias("revenue_at_risk_monthly")))
