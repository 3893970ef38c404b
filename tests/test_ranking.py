"""Distributed NTILE / row numbers and bucketed running sums against the plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from repsight.functions.ranking import (exact_medians, exact_percentile, global_row_number, ntile_distributed, ntile_window,
                                        rank_distributed, tile_of)
from repsight.plans.inspect import plan_text


def _frame(spark, n, seed, nulls=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = None if nulls and rnd.random() < 0.05 else float(rnd.choice([1, 2, 2, 3, 5, 8, 8, 8, 13]))
        rows.append((i, v))
    return spark.createDataFrame(rows, "key long, v double")


@pytest.mark.parametrize("n,k", [(1000, 4), (997, 5), (3, 5), (1, 4), (50, 7)])
def test_distributed_ntile_equals_window(spark, n, k):
    df = _frame(spark, n, seed=n * 31 + k)
    want = {r.key: r.t for r in ntile_window(df, k, ["v", "key"], "t").collect()}
    got = {r.key: r.t for r in ntile_distributed(df, k, ["v", "key"], "t").collect()}
    assert got == want


def test_hot_value_is_split_across_partitions(spark):
    # a third of the rows share one value: the range bounds on (value, key) still split them
    rows = [(i, 7.0 if i % 3 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, v double")
    numbered = global_row_number(df, ["v", "key"], out="rn", num_partitions=6)
    got = {r.key: r.rn for r in numbered.collect()}
    want = {r.key: r.rn for r in df.select(
        "key", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_last(), "key")).alias("rn")).collect()}
    assert got == want


def test_tile_formula(spark):
    rows = [(rn, n) for n in range(1, 23) for rn in range(1, n + 1)]
    df = spark.createDataFrame(rows, "rn long, n long")
    for k in (1, 4, 5):
        got = df.select("rn", "n", tile_of(F.col("rn"), F.col("n"), k).alias("t")).collect()
        for r in got:
            q, rem = divmod(r.n, k)
            sizes = [q + 1] * rem + [q] * (k - rem)
            edge, tile = 0, 0
            for size in sizes:
                tile += 1
                edge += size
                if r.rn <= edge:
                    break
            assert r.t == tile, (r, k)


@pytest.mark.parametrize("n,parts", [(1000, 7), (5, 8), (1, 4), (0, 3)])
def test_distributed_rank_equals_window(spark, n, parts):
    df = _frame(spark, n, seed=n + 3).withColumn("w", F.col("key") % 3)
    for order, by in (([("v", "desc")], [F.col("v").desc_nulls_last()]), (["v", ("w", "desc")], [F.col("v").asc_nulls_last(), F.col("w").desc_nulls_last()])):
        got = rank_distributed(df, order, "r", num_partitions=parts)
        assert "SinglePartition" not in plan_text(got)
        want = df.withColumn("r", F.rank().over(Window.orderBy(*by)).cast("long"))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_run_of_ties_spans_partitions(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 9, 5).otherwise(F.col("id")).alias("v"), "id")
    got = rank_distributed(df, ["v"], "r", num_partitions=8)
    want = df.withColumn("r", F.rank().over(Window.orderBy("v")).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = rank_distributed(spark.range(500).select(F.lit(None).cast("int").alias("v")), ["v"], "r", num_partitions=6)
    assert {r.r for r in one.collect()} == {1}


def test_exact_percentile_by_selection(spark):
    rnd = random.Random(8)
    cases = [[rnd.gauss(0, 1) for _ in range(801)], [rnd.gauss(0, 1) ** 9 for _ in range(700)], [1.0] * 500 + [2.0] * 500, [1.0] * 499 + [2.0] * 501,
             [0.0] * 300 + [rnd.random() for _ in range(50)] + [9.0] * 350, [3.0], [1.0, 4.0], [float(k) for k in range(400)] + [5.0] * 400]
    for xs in cases:
        df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").repartition(3)
        for q in (0.5, 0.25, 0.99):
            want = df.agg(F.percentile("x", q)).first()[0]
            assert exact_percentile(df, "x", q, select_rows=20, accuracy=20) == pytest.approx(want, rel=1e-12, abs=1e-12), (len(xs), q)
    empty = spark.createDataFrame([(None,)], "x double")
    assert exact_percentile(empty, "x") is None and exact_medians(empty, ["x"]).first()[0] is None
