"""Distinct counts merged across grains from sketches."""

import datetime

import pytest
from pyspark.sql import functions as F

from repsight.operators import reach
from repsight.plans.inspect import plan_text

GRAINS = [("territory_id",), ("product_id", "year"), ("year",), ()]


def _calls(spark, n=200_000, hcps=60_000):
    at = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m))
    return spark.range(n).select(at(1, 12).alias("territory_id"), at(2, 5).alias("product_promoted"), (2000 + at(3, 3)).cast("int").alias("year"), F.make_date(F.lit(2000), (1 + at(4, 12)).cast("int"), F.lit(1)).alias("month"),
                                 at(5, hcps).alias("hcp_id"), F.when(at(6, 10) > 0, at(7, 900)).alias("rep_id"), (at(8, 2) == 0).alias("converted"))


@pytest.mark.parametrize("keys", GRAINS)
def test_merged_estimates_stay_within_the_error_bound(spark, keys):
    calls = _calls(spark)
    got = {tuple(r[:len(keys)]): r for r in reach.counted(reach.merge(reach.call_reach(calls), keys)).collect()}
    exact = calls.withColumnRenamed("product_promoted", "product_id").groupBy(*keys).agg(F.count("*").alias("calls"), F.countDistinct("hcp_id").alias("hcps"), F.countDistinct("rep_id").alias("reps")).collect()
    assert len(got) == len(exact)
    for e in exact:
        g = got[tuple(e[:len(keys)])]
        assert g.calls == e.calls and g.reps == e.reps                      # sums are exact; 900 reps fit the sketch itself
        assert abs(g.hcps - e.hcps) <= 4 * 1.04 / 2 ** 7 * e.hcps           # four standard errors at 14


def test_merging_in_steps_equals_merging_at_once(spark):
    fine = reach.call_reach(_calls(spark, 50_000))
    at_once = reach.counted(reach.merge(fine, ("year",))).orderBy("year").collect()
    steps = reach.counted(reach.merge(reach.merge(fine, ("product_id", "year")), ("year",))).orderBy("year").collect()
    assert [(r.year, r.calls, r.reps) for r in at_once] == [(r.year, r.calls, r.reps) for r in steps]
    assert all(abs(a.hcps - b.hcps) <= 0.02 * a.hcps for a, b in zip(at_once, steps, strict=True))


def test_no_row_is_copied_and_partial_sketches_come_first(spark):
    text = plan_text(reach.call_reach(_calls(spark, 100)), "simple")
    assert "Expand" not in text and text.count("Exchange") == 1 and "partial_hll_sketch_agg" in text


def test_nulls_and_empty_facts(spark):
    schema = "territory_id string, product_promoted string, year int, month date, hcp_id string, rep_id string, converted boolean"
    first = datetime.date(2000, 1, 1)
    rows = [("t", "p", 2000, first, None, "r", None), (None, "p", 2000, first, "h", "r", True), ("t", None, None, None, "h", None, False)]
    got = reach.counted(reach.merge(reach.call_reach(spark.createDataFrame(rows, schema)), ("territory_id",)))
    assert sorted((r.territory_id or "", r.calls, r.conversions or 0, r.hcps, r.reps) for r in got.collect()) == [("", 1, 1, 1, 1), ("t", 2, 0, 1, 1)]
    assert reach.call_reach(spark.createDataFrame([], schema)).collect() == []
