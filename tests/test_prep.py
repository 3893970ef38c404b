"""Properties of the data-preparation jobs on the test tables (beyond the oracle match)."""

from pyspark.sql import functions as F

from repsight.operators import prep


def test_call_plan_weights_sum_to_one(star001, fp):
    sums = prep.call_plan_weights(star001.physicians, fp).groupBy("territory_id").agg(F.sum("weight").alias("s"))
    assert all(abs(r.s - 1.0) < 1e-9 for r in sums.collect())


def test_rep_month_spine_is_complete(star001, fp):
    spine = prep.rep_month_spine(star001.reps, star001.sales, fp)
    n_reps = star001.reps.count()
    assert spine.count() == n_reps * fp.period_months
    silent = spine.where("is_silent").collect()
    assert all(r.revenue == 0.0 for r in silent)
