"""The whole analysis run: every module over one star schema, each result to a sink.

This is the original's end-to-end script re-expressed: the star tables are
the inputs; one pass over each fact table writes every grain the modules need
(``repsight.grains``), each module result is written by Spark (one folder per
result), and the four results that others read (whitespace, coverage, rep
metrics, channels) are persisted once and released at the end. Nothing is
collected to the driver.
"""

from __future__ import annotations

import os
from functools import cache
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repsight.grains import fact_grains
from repsight.operators import (coverage, effectiveness, kpi, performance, portfolio, prep, promotion, reports,
                                whitespace)
from repsight.params import Params
from repsight.sources.schema import Star
from repsight.sources.single_file import can_join, write_result_file
from repsight.sources.sinks import write_result


def _sink_order(p: Params) -> dict[str, list[Column]]:
    """Row order of each written result (the original orders only at the end; so do we).

    A global ``orderBy`` is a range-partitioned sort, so even the HCP-level
    result is sorted in parallel, never in one task.
    """
    y1 = f"rev_{p.current_year}"
    return {
        "m1_sales_performance": [F.col(y1).desc_nulls_last(), F.col("territory_id")],
        "m2_whitespace_analysis": [F.col("opportunity_gap_usd").desc_nulls_last(), F.col("territory_id")],
        "m3_sfe_metrics": [F.col("total_revenue").desc_nulls_last(), F.col("rep_id")],
        "m4_hcp_coverage_gap": [F.col("prescriber_tier").asc_nulls_last(), F.col("monthly_rx_volume").desc_nulls_last(),
                                F.col("hcp_id")],
        "m5_product_portfolio": [F.col("total_revenue").desc_nulls_last(), F.col("product_id")],
        "m5b_product_monthly_trend": [F.col("product_id"), F.col("month")],
        "m6_promotional_response": [F.col("roi_rank").asc_nulls_last(), F.col("channel")],
        "state_map_data": [F.col(y1).desc_nulls_last(), F.col("state")],
        "revenue_by_region": [F.col("revenue").desc_nulls_last(), F.col("region")],
        "top_territories": [F.col("revenue").desc_nulls_last(), F.col("territory_id")],
    }


# Results bounded by a dimension (territories, products, channels, states, one KPI row) are
# written as one file by one task; as CSV the larger ordered results become one file too, from
# part files joined in order (``sources.single_file``) where the file system can do that.
SINGLE_FILE = ("m1_sales_performance", "m2_whitespace_analysis", "m6_promotional_response", "kpi_summary",
               "state_map_data", "revenue_by_region", "top_territories", "whitespace_kpis", "dataset_summary",
               "quadrant_counts", "whitespace_total_gap", "sfe_averages", "coverage_status_counts",
               "critical_gap_revenue", "quadrant_scatter", "high_potential_low_realization", "channel_cost_ratio",
               "state_revenue_spread")

# Output names of the original run, plus the dashboard datasets.
RESULTS = ("m1_sales_performance", "m2_whitespace_analysis", "m3_sfe_metrics", "m4_hcp_coverage_gap",
           "m5_product_portfolio", "m5b_product_monthly_trend", "m6_promotional_response", "kpi_summary",
           "state_map_data", "revenue_by_region", "top_territories", "whitespace_kpis", "dataset_summary",
           "quadrant_counts", "whitespace_total_gap", "sfe_averages", "coverage_status_counts", "critical_gap_revenue",
           "quadrant_scatter", "high_potential_low_realization", "coverage_mandate_list", "coverage_mandate_tier",
           "channel_cost_ratio", "state_revenue_spread")


def analysis_results(star: Star, p: Params) -> tuple[dict[str, Callable[[], DataFrame]], list[DataFrame]]:
    """Builders of every result, and the frames that are persisted for reuse (filled as they are built)."""
    kept: list[DataFrame] = []

    def shared(build: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        def once() -> DataFrame:
            kept.append(build().persist(StorageLevel.MEMORY_AND_DISK))
            return kept[-1]
        return cache(once)

    sfe = shared(lambda: effectiveness.sfe_metrics(star.reps, star.sales, star.call_logs, star.physicians, p))
    promo = shared(lambda: promotion.promotional_response(star.call_logs, p))
    ws = whitespace.whitespace_analysis(star.territories, star.sales, star.call_logs, p) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    cov = coverage.hcp_coverage_gap(star.physicians, star.call_logs, p).persist(StorageLevel.MEMORY_AND_DISK)
    builders: dict[str, Callable[[], DataFrame]] = {
        "m1_sales_performance": lambda: performance.sales_performance(star.sales, star.territories, p),
        "m2_whitespace_analysis": lambda: ws,
        "m3_sfe_metrics": sfe,
        "m4_hcp_coverage_gap": lambda: cov,
        "m5_product_portfolio": lambda: portfolio.product_portfolio(star.sales, star.products, p),
        "m5b_product_monthly_trend": lambda: portfolio.product_monthly_trend(star.sales, star.products),
        "m6_promotional_response": promo,
        "kpi_summary": lambda: kpi.kpi_summary(star.sales, ws, cov, p),
        "state_map_data": lambda: reports.state_map(star.sales, star.territories, ws, p),
        "revenue_by_region": lambda: reports.revenue_by_region(star.sales, star.territories, p),
        "top_territories": lambda: reports.top_territories(star.sales, star.territories, p),
        "whitespace_kpis": lambda: reports.whitespace_kpis(ws),
        "dataset_summary": lambda: prep.dataset_summary(star),
        "quadrant_counts": lambda: whitespace.quadrant_counts(ws),
        "whitespace_total_gap": lambda: whitespace.whitespace_total_gap(ws),
        "sfe_averages": lambda: effectiveness.sfe_averages(sfe()),
        "coverage_status_counts": lambda: coverage.coverage_status_counts(cov),
        "critical_gap_revenue": lambda: coverage.critical_gap_revenue(cov),
        "quadrant_scatter": lambda: reports.quadrant_scatter(ws),
        "high_potential_low_realization": lambda: reports.high_potential_low_realization(ws, p),
        "coverage_mandate_list": lambda: reports.coverage_mandate_list(cov, p),
        "coverage_mandate_tier": lambda: reports.coverage_mandate_tier(cov, p),
        "channel_cost_ratio": lambda: reports.channel_cost_ratio(promo()),
        "state_revenue_spread": lambda: reports.state_revenue_spread(star.sales, star.territories, p),
    }
    kept += [ws, cov]
    return builders, kept


def run_analysis(star: Star, p: Params, out_dir: str, fmt: str = "csv",
                 only: tuple[str, ...] | None = None, region: str | None = None, territory_id=None) -> list[str]:
    """Write every result under ``out_dir/<name>``; the dataset summary also as JSON.

    ``region`` and ``territory_id`` narrow the finished results that carry
    those columns (#35), after medians and ranks.
    """
    builders, cached = analysis_results(fact_grains(star), p)
    order = _sink_order(p)
    written = []
    try:
        for name in only or RESULTS:
            df = builders[name]()
            df = reports.filter_scope(df, region if "region" in df.columns else None,
                                      territory_id if "territory_id" in df.columns else None)
            path = os.path.join(out_dir, name)
            written.append(name)
            if fmt == "csv" and name in order and name not in SINGLE_FILE and can_join(df.sparkSession, path):
                write_result_file(df, path, order[name])
                continue
            if name in order:
                df = df.orderBy(*order[name])
            if name in SINGLE_FILE:
                df = df.coalesce(1)        # keeps the sorted order: partitions are concatenated in order
            write_result(df, path, fmt)
        if only is None or "dataset_summary" in only:
            write_result(builders["dataset_summary"]().coalesce(1), os.path.join(out_dir, "dataset_summary_json"),
                         "json")
    finally:
        for df in cached:
            df.unpersist()
    return written
