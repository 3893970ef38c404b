"""Cross-operator invariants (the checks the original prints by eye), at sf0.01."""

from collections import Counter

from pyspark.sql import functions as F

from repsight.operators import effectiveness, performance, portfolio, promotion


def test_revenue_agrees_across_modules(star001, fp):
    m1 = performance.territory_year_rollup(star001.sales, star001.territories, fp).agg(F.sum("revenue")).first()[0]
    m3 = effectiveness.rep_sales_totals(star001.sales).agg(F.sum("total_revenue")).first()[0]
    m5 = portfolio.product_totals(star001.sales, star001.products, fp).agg(F.sum("total_revenue")).first()[0]
    assert abs(m1 - m3) < 0.01 and abs(m3 - m5) < 0.01
    u3 = effectiveness.rep_sales_totals(star001.sales).agg(F.sum("total_units")).first()[0]
    u5 = portfolio.product_totals(star001.sales, star001.products, fp).agg(F.sum("total_units")).first()[0]
    assert u3 == u5


def test_calls_agree_across_modules(star001):
    n = star001.call_logs.count()
    rc = effectiveness.rep_call_stats(star001.call_logs).agg(F.sum("total_calls"), F.sum("total_conversions")).first()
    cs = promotion.channel_summary(star001.call_logs).agg(F.sum("total_interactions"),
                                                         F.sum("total_conversions")).first()
    assert rc[0] == cs[0] == n and rc[1] == cs[1]


def test_sfe_tiles_tiers_and_index(star001, fp):
    sfe = effectiveness.sfe_metrics(star001.reps, star001.sales, star001.call_logs, star001.physicians, fp).collect()
    assert all(r.tier_a_calls + r.tier_b_calls + r.tier_c_calls == r.total_calls for r in sfe)
    assert max(r.productivity_index for r in sfe) == 100.0
    sizes = Counter(r.performance_quartile for r in sfe)
    q, rem = divmod(len(sfe), 4)
    assert [sizes[t] for t in (1, 2, 3, 4)] == [q + 1] * rem + [q] * (4 - rem)


def test_quintiles_and_shares(star001, fp):
    perf = performance.sales_performance(star001.sales, star001.territories, fp).collect()
    sizes = Counter(r.revenue_quintile for r in perf)
    q, rem = divmod(len(perf), 5)
    assert [sizes[t] for t in range(1, 6)] == [q + 1] * rem + [q] * (5 - rem)
    shares = portfolio.product_portfolio(star001.sales, star001.products, fp).agg(F.sum("portfolio_share_pct")).first()[0]
    assert abs(shares - 100.0) <= 0.3
