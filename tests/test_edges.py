"""Hand-made frames for the edges the test tables lack (FIXTURES.md §4), with the
original's string ids and default parameters."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from repsight.operators import coverage, effectiveness, performance, portfolio, promotion, reports, whitespace
from repsight.params import Params
from repsight.sources.schema import CALL_LOGS, PHYSICIANS, PRODUCTS, REPS, SALES, TERRITORIES, Star

P = Params()


def _d(y, m, d=1):
    return dt.date(y, m, d)


@pytest.fixture(scope="module")
def star(spark):
    terr = [("T1", "R1", "S1", 80.0, 0.5, 0.5, 100, 500), ("T2", "R1", "S1", 60.0, 0.5, 0.5, 100, 500),
            ("T3", "R2", "S2", 50.0, 0.5, 0.5, 100, 500), ("T4", "R2", "S2", 40.0, 0.5, 0.5, 100, 500),
            ("T5", "R3", "S3", 0.0, 0.5, 0.5, 100, 500), ("T6", "R3", "ZZ", 90.0, 0.5, 0.5, 100, 500)]
    prods = [("P1", "One", "A", 2020, 100, 0.28, 0.04, "Cash Cow"),
             ("P2", "Two", "B", 2020, 100, 0.12, 0.31, "Question Mark"),
             ("P3", "Three", "C", 2020, 100, 0.05, 0.06, "Dog")]
    reps = [(f"R{i}", f"Rep {i}", t, "R1", 3, _d(2020, 1), "MBA", 0.6)
            for i, t in [(1, "T1"), (2, "T2"), (3, "T4"), (4, "T3"), (5, "T5")]]
    phys = [("H1", "Dr A1", "T1", "GP", "A", 100, 10, "Academic", "High"),
            ("H2", "Dr B1", "T1", "GP", "B", 30, 10, "Academic", "High"),
            ("H3", "Dr A2", "T1", "GP", "A", 90, 10, "Academic", "High"),
            ("H4", "Dr B2", "T1", "GP", "B", 20, 10, "Academic", "High"),
            ("H5", "Dr C1", "T1", "GP", "C", 5, 10, "Academic", "High"),
            ("H6", "Dr C2", "T1", "GP", "C", 6, 10, "Academic", "High")]
    sale_rows = [("R1", "T1", "P1", 2023, 1, "100.00"), ("R1", "T1", "P1", 2024, 1, "150.00"),
                 ("R2", "T2", "P1", 2023, 2, "200.00"), ("R2", "T2", "P2", 2024, 2, "100.00"),
                 ("R4", "T3", "P1", 2023, 3, "50.00"),
                 ("R3", "T4", "P2", 2023, 4, "80.00"), ("R3", "T4", "P2", 2024, 4, "80.00"),
                 ("R5", "T5", "P1", 2023, 5, "10.00"), ("R5", "T5", "P1", 2024, 5, "30.00"),
                 ("R1", "T1", "P3", 2024, 6, "40.00")]
    sales = [(f"S{i}", r, t, pr, _d(y, m), y, m, 1, Decimal(v), Decimal("0.100"), Decimal(v) * Decimal("0.9"))
             for i, (r, t, pr, y, m, v) in enumerate(sale_rows)]
    calls = []

    def call(hcp, y, m, channel, conv):
        calls.append((f"C{len(calls)}", "R1", hcp, "T1", "P1", _d(y, m, 2), _d(y, m), y, m, channel, "x", conv, 20, True))

    for i in range(24):      # exactly 1.0 call a month for a tier-A HCP: Undercovered, not Critical
        call("H1", 2023 + i // 12, i % 12 + 1, "In-Person Visit", i % 2 == 0)
    for i in range(12):      # exactly 0.5 a month for tier B: Adequately Covered
        call("H2", 2023, i + 1, "Conference", False)
    call("H6", 2024, 3, "Mystery Channel", True)
    mk = spark.createDataFrame
    return Star(territories=mk(terr, TERRITORIES), products=mk(prods, PRODUCTS), reps=mk(reps, REPS), physicians=mk(phys, PHYSICIANS), sales=mk(sales, SALES),
                call_logs=mk(calls, CALL_LOGS))


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def test_prior_year_only_and_zero_mpi(star):
    perf = _by(performance.sales_performance(star.sales, star.territories, P), "territory_id")
    assert "T6" not in perf                        # no sales: dropped by the inner join
    assert perf["T3"].rev_2024 is None and perf["T3"].yoy_growth_pct is None
    assert perf["T3"].revenue_quintile == 5        # null current revenue sorts last -> top quintile
    assert perf["T5"].revenue_per_mpi is None      # MPI 0: null, no error under ANSI
    assert perf["T1"].yoy_growth_pct == 90.0       # 190 against 100
    assert perf["T2"].active_reps == 1


def test_inactive_territory_is_zero_filled_and_in_medians(star):
    pot = _by(whitespace.territory_potential(star.territories, star.sales, star.call_logs, P), "territory_id")
    assert pot["T6"].actual_revenue == 0.0 and pot["T6"].call_volume == 0 and pot["T6"].conversion_rate == 0.0
    assert pot["T5"].realization_pct is None
    ws = whitespace.whitespace_analysis(star.territories, star.sales, star.call_logs, P).collect()
    # current-year revenues 190, 100, 0, 80, 30, 0 -> median 55; MPIs 80, 60, 50, 40, 0, 90 -> 55
    assert {r.med_revenue for r in ws} == {55.0} and {r.med_mpi for r in ws} == {55.0}
    q = {r.territory_id: r.whitespace_quadrant for r in ws}
    assert q == {"T1": "Star", "T2": "Star", "T3": "Abandon", "T4": "Saturated", "T5": "Abandon",
                 "T6": "Whitespace"}


def test_state_without_sales_vanishes_from_state_map(star):
    ws = whitespace.whitespace_analysis(star.territories, star.sales, star.call_logs, P)
    sm = _by(reports.state_map(star.sales, star.territories, ws, P), "state")
    assert set(sm) == {"S1", "S2", "S3"}
    assert sm["S1"].rev_2024 == 290.0 and sm["S1"].territory_count == 2


def test_reps_without_calls_drop_out_of_sfe(star):
    sfe = effectiveness.sfe_metrics(star.reps, star.sales, star.call_logs, star.physicians, P).collect()
    assert [r.rep_id for r in sfe] == ["R1"]
    r = sfe[0]
    assert r.productivity_index == 100.0 and r.performance_quartile == 1
    assert r.tier_a_calls == 24 and r.tier_b_calls == 12 and r.tier_c_calls == 1
    assert r.total_calls == r.tier_a_calls + r.tier_b_calls + r.tier_c_calls
    assert r.avg_monthly_calls == round(37 / 24, 1)


def test_coverage_status_order_and_thresholds(star):
    cov = _by(coverage.hcp_coverage_gap(star.physicians, star.call_logs, P), "hcp_id")
    status = {k: v.coverage_status for k, v in cov.items()}
    assert status == {"H1": "Undercovered", "H2": "Adequately Covered", "H3": "Critical Gap",
                      "H4": "Undercovered", "H5": "Not Reached", "H6": "Adequately Covered"}
    assert cov["H3"].estimated_monthly_revenue_potential == 90 * 420.0
    assert cov["H4"].estimated_monthly_revenue_potential == round(20 * 420 * 0.6)
    assert cov["H5"].total_calls_received == 0 and cov["H5"].avg_monthly_calls == 0.0


def test_channel_without_conversions_and_unknown_channel_rank_last(star):
    pr = _by(promotion.promotional_response(star.call_logs, P), "channel")
    assert pr["Conference"].cost_per_conversion is None
    assert pr["Mystery Channel"].cost_per_interaction is None and pr["Mystery Channel"].cost_per_conversion is None
    assert pr["In-Person Visit"].roi_rank == 1
    assert pr["Conference"].roi_rank == 2 and pr["Mystery Channel"].roi_rank == 2
    assert pr["Mystery Channel"].conversion_rank == 1          # 100 % converted
    assert pr["Conference"].conversion_rank == 3


def test_weighted_and_unweighted_channel_rates(spark):
    rows = [("A", "P1", "T1", True), ("A", "P1", "T1", False), ("A", "P1", "T1", False), ("A", "P1", "T1", False),
            ("A", "P2", "T1", True)]
    calls = spark.createDataFrame(
        [(f"C{i}", "R1", "H1", t, pr, _d(2024, 1), _d(2024, 1), 2024, 1, ch, "x", cv, 10, False)
         for i, (ch, pr, t, cv) in enumerate(rows)], CALL_LOGS)
    un = promotion.channel_summary(calls).collect()[0]
    we = promotion.channel_summary(calls, weighted=True).collect()[0]
    assert un.avg_conversion_rate_pct == 62.5     # mean of 25 % and 100 %
    assert we.avg_conversion_rate_pct == 40.0     # 2 of 5


def test_product_sold_in_one_year_only(star):
    pf = _by(portfolio.product_portfolio(star.sales, star.products, P), "product_id")
    assert pf["P3"].rev_2023 is None and pf["P3"].revenue_growth_pct is None
    assert abs(sum(r.portfolio_share_pct for r in pf.values()) - 100.0) < 0.2


def test_empty_facts_keep_schema(spark, star):
    empty_sales = star.sales.limit(0)
    empty_calls = star.call_logs.limit(0)
    ws = whitespace.whitespace_analysis(star.territories, empty_sales, empty_calls, P)
    rows = ws.collect()
    assert len(rows) == 6 and all(r.actual_revenue == 0.0 for r in rows)
    assert performance.sales_performance(empty_sales, star.territories, P).count() == 0
    assert promotion.promotional_response(empty_calls, P).count() == 0


def test_unweighted_channel_mean_is_exact_on_a_tie(spark):
    # cell rates 3/10 and 1/200: the mean is exactly 15.25 %, which rounds half away to 15.3
    rows = [("T1", i < 3) for i in range(10)] + [("T2", i < 1) for i in range(200)]
    calls = spark.createDataFrame(
        [(f"C{i}", "R1", "H1", t, "P1", _d(2024, 1), _d(2024, 1), 2024, 1, "A", "x", cv, 10, False)
         for i, (t, cv) in enumerate(rows)], CALL_LOGS)
    assert promotion.channel_summary(calls).collect()[0].avg_conversion_rate_pct == 15.3


def test_unweighted_channel_mean_is_a_tie_of_endless_fractions(spark):
    # cell rates 1/3 and 503/3000: the mean is exactly 25.05 %, which rounds half away to 25.1
    rows = [("T1", i < 1) for i in range(3)] + [("T2", i < 503) for i in range(3000)]
    calls = spark.createDataFrame(
        [(f"C{i}", "R1", "H1", t, "P1", _d(2024, 1), _d(2024, 1), 2024, 1, "A", "x", cv, 10, False)
         for i, (t, cv) in enumerate(rows)], CALL_LOGS)
    assert promotion.channel_summary(calls).collect()[0].avg_conversion_rate_pct == 25.1


def test_no_revenue_at_all(star):
    from repsight.operators import effectiveness
    none = star.sales.withColumn("revenue_usd", F.lit(0).cast("decimal(18,2)"))
    rows = effectiveness.sfe_metrics(star.reps, none, star.call_logs, star.physicians, P).collect()
    assert rows and all(r.productivity_index is None and r.revenue_per_call == 0.0 for r in rows)


def test_weighted_rates_through_params(star):
    un = {r.channel: r.avg_conversion_rate_pct for r in promotion.promotional_response(star.call_logs, P).collect()}
    we = {r.channel: r.avg_conversion_rate_pct
          for r in promotion.promotional_response(star.call_logs, P.with_(weighted_channel_rates=True)).collect()}
    assert set(un) == set(we)
    assert we["In-Person Visit"] == 50.0          # 12 of 24 calls
