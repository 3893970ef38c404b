"""The shared expressions against DuckDB's behaviour."""

import random

import duckdb
from pyspark.sql import functions as F

from repsight.functions.exprs import cents, pct_change, round_half_away, safe_div, to_money


def test_round_half_away_known_values(spark):
    df = spark.createDataFrame([(1.005, 2), (11.25, 1), (-2.5, 0), (2.5, 0), (0.0, 1), (-0.04, 1)], "x double, n int")
    got = [r[0] for r in df.select(
        F.when(F.col("n") == 2, round_half_away("x", 2))
        .when(F.col("n") == 1, round_half_away("x", 1))
        .otherwise(round_half_away("x", 0))).collect()]
    # 1.005 is 1.00499999... in binary: half away from zero on the binary value gives 1.0
    assert got[:4] == [1.0, 11.3, -3.0, 3.0]
    assert got[4] == 0.0 and got[5] == 0.0


def test_round_half_away_matches_duckdb(spark):
    rnd = random.Random(7)
    vals = [rnd.uniform(-1e6, 1e6) for _ in range(3000)]
    vals += [k / 1000 for k in range(-3000, 3000, 5)] + [k / 100 + 0.005 for k in range(-500, 500)]
    vals += [k + 0.5 for k in range(-300, 300)] + [k / 10 + 0.05 for k in range(-300, 300)]
    vals += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-3, 12) for _ in range(2000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE v(i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(vals)))
    want = {i: (a, b, c) for i, a, b, c in con.execute("SELECT i, round(x, 0), round(x, 1), round(x, 2) FROM v").fetchall()}
    df = spark.createDataFrame(list(enumerate(vals)), "i int, x double")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select(
        "i", round_half_away("x", 0), round_half_away("x", 1), round_half_away("x", 2)).collect()}
    bad = [(i, vals[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not bad, bad[:5]


def test_guarded_division_never_raises_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (None, 1.0)], "a double, b double")
    got = [tuple(r) for r in df.select(safe_div("a", "b"), pct_change("a", "b")).collect()]
    assert got == [(None, None), (2.5, 150.0), (None, None)]


def test_cents_are_exact(spark):
    df = spark.createDataFrame([("0.07",), ("123456789.99",), ("-0.29",), ("1.10",)], "s string") \
        .select(F.col("s").cast("decimal(18,2)").alias("m"))
    got = [tuple(r) for r in df.select(cents("m"), to_money(cents("m"))).collect()]
    assert got == [(7, 0.07), (12345678999, 123456789.99), (-29, -0.29), (110, 1.1)]


def test_params_are_validated():
    import pytest
    from repsight.params import Params, fixture_params
    assert fixture_params().prior_year == 1999
    with pytest.raises(ValueError):
        Params(prior_year=2024, current_year=2024)
    with pytest.raises(ValueError):
        Params(rep_tiles=0)


def test_rules_are_data_and_their_order_counts(spark):
    import pytest

    from repsight.functions.exprs import coverage_status, deployment_label, first_match
    from repsight.params import Params
    p = Params()
    rows = spark.createDataFrame([("A", 0.5, 3), ("A", 1.5, 40), ("A", 0.0, 0), ("B", 0.1, 1), ("B", 0.0, 0), ("C", 0.0, 0), ("C", 0.1, 2), (None, None, None)], "t string, m double, n long")
    label = lambda q: [r[0] for r in rows.select(coverage_status("t", "m", "n", q)).collect()]
    assert label(p) == ["Critical Gap", "Undercovered", "Critical Gap", "Undercovered", "Undercovered", "Not Reached", "Adequately Covered", "Adequately Covered"]
    first = p.with_(coverage_rules=(p.coverage_table[3], *p.coverage_table[:3], p.coverage_table[4]))
    assert label(first) == ["Critical Gap", "Undercovered", "Not Reached", "Undercovered", "Not Reached", "Not Reached", "Adequately Covered", "Adequately Covered"]
    assert label(p.with_(coverage_rules=())) == [None] * 8
    both = spark.createDataFrame([(80.0, 0.4), (30.0, 0.9), (30.0, 0.2), (None, 0.1)], "mpi double, s double")
    where = lambda q: [r[0] for r in both.select(deployment_label("mpi", "s", q)).collect()]
    assert where(p) == ["Underperforming", "Oversaturated", "Normal", "Normal"]
    assert where(p.with_(deployment_rules=(("Low", (("potential", "<", 0.5),)), *p.deployment_table))) == ["Underperforming", "Low", "Low", "Normal"]
    with pytest.raises(ValueError, match="unknown bounds"):
        first_match([("x", (("nothing", "<", 1),))], {})


def test_distinct_months_equal_a_distinct_count(spark):
    import datetime
    import random

    from repsight.functions.exprs import distinct_months
    rnd = random.Random(5)
    rows = [(g, None if rnd.random() < 0.1 else datetime.date(rnd.randrange(2005, 2025), rnd.randrange(1, 13), 1)) for g in range(30) for _ in range(rnd.randrange(1, 300))]
    rows += [(99, None), (98, datetime.date(1969, 12, 1)), (98, datetime.date(1970, 1, 1)), (97, datetime.date(2003, 1, 31)), (97, datetime.date(2024, 4, 1))]
    df = spark.createDataFrame(rows, "g int, d date")
    want = {g: len({(d.year, d.month) for k, d in rows if k == g and d}) for g in {g for g, _ in rows}}
    for words in (4, 5, 0):
        assert {r.g: r.n for r in df.groupBy("g").agg(distinct_months("d", words).alias("n")).collect()} == want
    assert df.limit(0).agg(distinct_months("d", 1).alias("n")).first().n in (None, 0)


def test_distinct_months_refuse_a_longer_span(spark):
    import datetime

    import pytest

    from repsight.functions.exprs import distinct_months
    df = spark.createDataFrame([(datetime.date(2000, 1, 1),), (datetime.date(2005, 4, 1),)], "d date")
    assert df.agg(distinct_months("d", 1).alias("n")).first().n == 2          # 63 months apart
    wide = df.union(spark.createDataFrame([(datetime.date(2005, 5, 1),)], "d date"))
    with pytest.raises(Exception, match="month_words"):
        wide.agg(distinct_months("d", 1).alias("n")).collect()
    assert wide.agg(distinct_months("d", 2).alias("n")).first().n == 3
