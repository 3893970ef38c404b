"""Every registered query: name -> function of (star tables, params) -> DataFrame.

One entry per operator of the inventory (SURVEY §2.1, #1-#48); the entry
point, the bench and the oracle tests all go through this table.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from repsight.operators import (coverage, effectiveness, kpi, performance, portfolio, prep, promotion, reach,
                                reports, whitespace)
from repsight.params import Params
from repsight.sources.fixtures import SCOPE_REGION, SCOPE_TERRITORY
from repsight.sources.schema import Star

Query = Callable[[Star, Params], DataFrame]


def _ws(s: Star, p: Params) -> DataFrame:
    return whitespace.whitespace_analysis(s.territories, s.sales, s.call_logs, p)


def _cov(s: Star, p: Params) -> DataFrame:
    return coverage.hcp_coverage_gap(s.physicians, s.call_logs, p)


def _promo(s: Star, p: Params) -> DataFrame:
    return promotion.promotional_response(s.call_logs, p)


def _sfe(s: Star, p: Params) -> DataFrame:
    return effectiveness.sfe_metrics(s.reps, s.sales, s.call_logs, s.physicians, p)


QUERIES: dict[str, Query] = {
    # M1 sales performance
    "territory_year_rollup": lambda s, p: performance.territory_year_rollup(s.sales, s.territories, p),
    "territory_year_pivot": lambda s, p: performance.territory_year_pivot(s.sales, s.territories, p),
    "sales_performance": lambda s, p: performance.sales_performance(s.sales, s.territories, p),
    # M2 whitespace
    "territory_sales_for_year": lambda s, p: whitespace.territory_sales_for_year(s.sales, p.current_year),
    "territory_call_stats": lambda s, p: whitespace.territory_call_stats(s.call_logs, p.current_year),
    "territory_potential": lambda s, p: whitespace.territory_potential(s.territories, s.sales, s.call_logs, p),
    "territory_medians": lambda s, p: whitespace.territory_medians(
        whitespace.territory_potential(s.territories, s.sales, s.call_logs, p)),
    "whitespace_analysis": _ws,
    "quadrant_counts": lambda s, p: whitespace.quadrant_counts(_ws(s, p)),
    "whitespace_total_gap": lambda s, p: whitespace.whitespace_total_gap(_ws(s, p)),
    # M3 effectiveness
    "rep_sales_totals": lambda s, p: effectiveness.rep_sales_totals(s.sales, p),
    "rep_call_stats": lambda s, p: effectiveness.rep_call_stats(s.call_logs, p),
    "rep_tier_mix": lambda s, p: effectiveness.rep_tier_mix(s.call_logs, s.physicians),
    "sfe_metrics": _sfe,
    "sfe_averages": lambda s, p: effectiveness.rep_averages(s.reps, s.sales, s.call_logs, s.physicians, p),
    # M4 coverage
    "hcp_call_stats": lambda s, p: coverage.hcp_call_stats(s.call_logs, p),
    "hcp_coverage_gap": _cov,
    "coverage_status_counts": lambda s, p: coverage.coverage_status_counts(_cov(s, p)),
    "critical_gap_revenue": lambda s, p: coverage.critical_gap_revenue(_cov(s, p)),
    # M5 portfolio
    "product_month_rollup": lambda s, p: portfolio.product_month_rollup(s.sales, s.products, p),
    "product_totals": lambda s, p: portfolio.product_totals(s.sales, s.products, p),
    "product_portfolio": lambda s, p: portfolio.product_portfolio(s.sales, s.products, p),
    "product_monthly_trend": lambda s, p: portfolio.product_monthly_trend(s.sales, s.products),
    # M6 promotion
    "channel_product_territory_perf": lambda s, p: promotion.channel_product_territory_perf(s.call_logs),
    "channel_summary": lambda s, p: promotion.channel_summary(s.call_logs),
    "channel_cost": lambda s, p: promotion.channel_cost(s.call_logs, p),
    "promotional_response": _promo,
    # KPI
    "kpi_sales": lambda s, p: kpi.kpi_sales(s.sales, p),
    "kpi_summary": lambda s, p: kpi.kpi_summary(s.sales, _ws(s, p), _cov(s, p), p),
    # reports and findings
    "state_map": lambda s, p: reports.state_map(s.sales, s.territories, _ws(s, p), p),
    "revenue_by_region": lambda s, p: reports.revenue_by_region(s.sales, s.territories, p),
    "top_territories": lambda s, p: reports.top_territories(s.sales, s.territories, p),
    "whitespace_kpis": lambda s, p: reports.whitespace_kpis(_ws(s, p)),
    "quadrant_scatter": lambda s, p: reports.quadrant_scatter(_ws(s, p)),
    "filter_scope": lambda s, p: reports.filter_scope(_ws(s, p), region=SCOPE_REGION),
    "high_potential_low_realization": lambda s, p: reports.high_potential_low_realization(_ws(s, p), p),
    "coverage_mandate_list": lambda s, p: reports.coverage_mandate_list(_cov(s, p), p),
    "channel_cost_ratio": lambda s, p: reports.channel_cost_ratio(_promo(s, p)),
    "state_revenue_spread": lambda s, p: reports.state_revenue_spread(s.sales, s.territories, p),
    # data preparation
    "bcg_quadrant": lambda s, p: prep.bcg_quadrant(s.products, p).select(
        "product_id", "name", "therapeutic_area", "list_price", "market_share_pct", "market_growth_rate",
        "bcg_quadrant"),
    "net_revenue": lambda s, p: prep.net_revenue(s.sales).selectExpr(
        "rep_id", "territory_id", "product_id", "month", "CAST(revenue_usd AS DOUBLE) AS revenue_usd",
        "CAST(discount_pct AS DOUBLE) AS discount_pct", "CAST(net_revenue_usd AS DOUBLE) AS net_revenue_usd"),
    "rep_region_enrichment": lambda s, p: prep.rep_region_enrichment(s.reps, s.territories),
    "territory_hcp_share": lambda s, p: prep.territory_hcp_share(s.territories),
    "call_plan_weights": lambda s, p: prep.call_plan_weights(s.physicians, p),
    "rep_month_spine": lambda s, p: prep.rep_month_spine(s.reps, s.sales, p),
    "deployment_segment": lambda s, p: prep.deployment_segment(s.reps, s.territories, p),
    "dataset_summary": lambda s, p: prep.dataset_summary(s),
}


# Operator number of each registered query in the inventory; #45, a random draw, is no query.
INVENTORY_NUMBER: dict[str, int] = dict(zip(QUERIES, [i for i in range(1, 49) if i != 45], strict=True))

# The checked options of some operators, registered beside them.
QUERIES |= {
    "filter_scope_territory": lambda s, p: reports.filter_scope(_ws(s, p), territory_id=SCOPE_TERRITORY),
    "coverage_mandate_tier": lambda s, p: reports.coverage_mandate_tier(_cov(s, p), p),
    "channel_summary_weighted": lambda s, p: promotion.channel_summary(s.call_logs, weighted=True),
    "promotional_response_weighted": lambda s, p: promotion.promotional_response(s.call_logs, p, weighted=True),
    # the original's RANK and median over entities that grow with the data
    "rep_ranking": lambda s, p: effectiveness.rep_ranking(s.sales, p),
    "hcp_ranking": lambda s, p: coverage.hcp_ranking(s.physicians, s.call_logs),
    "rep_medians": lambda s, p: effectiveness.rep_medians(s.sales),
    "hcp_medians": lambda s, p: coverage.hcp_medians(s.physicians, s.call_logs),
    # distinct counts merged from a finer rollup's sketches
    "region_year_reach": lambda s, p: reach.region_year_reach(s.call_logs, s.territories),
    "region_product_reach": lambda s, p: reach.region_product_reach(s.sales, s.territories),
}
INVENTORY_NUMBER |= {"filter_scope_territory": 35, "coverage_mandate_tier": 37, "channel_summary_weighted": 25, "promotional_response_weighted": 27,
                     "rep_ranking": 27, "hcp_ranking": 27, "rep_medians": 7, "hcp_medians": 7, "region_year_reach": 2, "region_product_reach": 21}
