"""The driver's TPC-H-shaped tables seen as the six star-schema tables.

Mapping (FIXTURES.md §2): a nation is a territory, a supplier a rep, a
customer an HCP, a part type a product; every line item is a sale and a call,
dated by its order. Every view is lazy: a query reads the given tables, and
Catalyst prunes their columns for it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repsight.functions.exprs import bcg_label
from repsight.params import Params
from repsight.sources.schema import Star
from repsight.sources.sinks import read_tables, write_tables

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_I, _L, _D, _S, _TS = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()
# Declared schemas of the test tables: no footer read for schema inference per query.
TPCH_SCHEMAS: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(c, t, True) for c, t in cols]) for name, cols in {
        "region": [("r_regionkey", _I), ("r_name", _S)],
        "nation": [("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)],
        "customer": [("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D), ("c_mktsegment", _S)],
        "supplier": [("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)],
        "part": [("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
                 ("p_retailprice", _D)],
        "orders": [("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
                   ("o_orderdate", _TS), ("o_orderpriority", _S)],
        "lineitem": [("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                     ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                     ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _TS)],
    }.items()}

# Own words for attributes that are only carried along.
EDUCATION = ("College", "Apprenticeship", "Evening School", "Self-taught")      # by s_suppkey % 4
# Region used by the registered page-scope query (#35) on these tables.
SCOPE_REGION = "AMERICA"
SCOPE_TERRITORY = 7
AFFILIATION = ("North Wing", "South Wing", "Harbour Clinic", "Hill Clinic")     # by c_custkey % 4
ENGAGEMENT = ("online", "mixed", "offline")                                    # by c_custkey % 3


def read_tpch(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.schema(TPCH_SCHEMAS[t]).parquet(os.path.join(sf_dir, f"{t}.parquet"))
            for t in TPCH_TABLES}


def _pick(idx, values) -> F.Column:
    e = None
    for i, v in enumerate(values):
        e = F.when(idx == i, F.lit(v)) if e is None else e.when(idx == i, F.lit(v))
    return e


def territories(t: dict[str, DataFrame]) -> DataFrame:
    hcps = t["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("num_target_hcps"))
    k = F.col("n_nationkey")
    return (t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
            .join(hcps, k == F.col("c_nationkey"), "left")
            .select(k.cast("bigint").alias("territory_id"),
                    F.col("r_name").alias("region"),
                    F.concat(F.lit("S"), (k % 12).cast("string")).alias("state"),
                    (F.lit(10) + (k * 37) % 90).cast("double").alias("market_potential_index"),
                    ((F.lit(20) + (k * 29) % 81).cast("double") / 100).alias("urban_index"),
                    ((F.lit(30) + (k * 17) % 61).cast("double") / 100).alias("competitor_intensity"),
                    F.coalesce(F.col("num_target_hcps"), F.lit(0)).cast("bigint").alias("num_target_hcps"),
                    (F.lit(150) + (k * 97) % 2350).cast("bigint").alias("population_000s")))


def products(t: dict[str, DataFrame], p: Params) -> DataFrame:
    """One product per part type: mean price, share of all parts, mean part size as growth."""
    per = t["part"].groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p_size").cast("bigint")).alias("size"),
                                          F.sum(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("cents"))
    every = t["part"].agg(F.count(F.lit(1))).scalar()
    ty, n = F.col("p_type"), F.col("n")
    base = per.select(ty.alias("product_id"), ty.alias("name"), ty.alias("therapeutic_area"),
                      F.expr("cents div (100 * n)").cast("bigint").alias("list_price"),
                      (n.cast("double") / every.cast("double")).alias("market_share_pct"),
                      (F.col("size").cast("double") / (n * 100).cast("double")).alias("market_growth_rate"))
    return base.withColumn("bcg_quadrant", bcg_label("market_share_pct", "market_growth_rate", p))


def reps(t: dict[str, DataFrame]) -> DataFrame:
    k = F.col("s_suppkey")
    geo = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return (t["supplier"].join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(k.alias("rep_id"), F.col("s_name").alias("rep_name"),
                    F.col("s_nationkey").cast("bigint").alias("territory_id"),
                    F.col("r_name").alias("region"),
                    (F.lit(1) + k % 17).alias("experience_years"),
                    _pick(k % 4, EDUCATION).alias("education"),
                    ((F.lit(20) + (k * 13) % 81).cast("double") / 100).alias("productivity_score")))


def physicians(t: dict[str, DataFrame]) -> DataFrame:
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    return t["customer"].select(
        k.alias("hcp_id"), F.col("c_name").alias("hcp_name"),
        F.col("c_nationkey").cast("bigint").alias("territory_id"),
        F.col("c_mktsegment").alias("specialty"),
        F.when(bal >= 7500, "A").when(bal >= 3500, "B").otherwise("C").alias("prescriber_tier"),
        F.greatest(F.lit(2).cast("bigint"), F.floor(bal / 90).cast("bigint")).alias("monthly_rx_volume"),
        _pick(k % 4, AFFILIATION).alias("hospital_affiliation"),
        _pick(k % 3, ENGAGEMENT).alias("digital_engagement"))


def _lines(t: dict[str, DataFrame]) -> DataFrame:
    """All line items with their order, rep territory and product."""
    return (t["lineitem"]
            .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")))


def order_lines(t: dict[str, DataFrame]) -> DataFrame:
    """Every line item with the columns of both facts, so one pass over the large join
    (line items × orders × suppliers × parts) feeds both."""
    od = F.col("o_orderdate")
    rev = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(5,3)")
    return _lines(t).select(
        F.col("l_suppkey").alias("rep_id"),
        F.col("s_nationkey").cast("bigint").alias("territory_id"),
        F.col("p_type").alias("product_id"),
        F.col("o_custkey").alias("hcp_id"),
        od.cast("date").alias("call_date"),
        F.trunc(od.cast("date"), "month").alias("month"),
        F.year(od).cast("int").alias("year"),
        F.month(od).cast("int").alias("month_num"),
        F.col("l_quantity").cast("bigint").alias("units_sold"),
        rev.alias("revenue_usd"),
        disc.alias("discount_pct"),
        F.round(rev * (F.lit(1) - disc), 2).cast("decimal(18,2)").alias("net_revenue_usd"),
        F.col("o_orderpriority").alias("channel"),
        ((F.col("o_orderstatus") == "F") & (F.col("l_returnflag") == "R")).alias("converted"),
        (F.col("l_linestatus") == "F").alias("samples_dropped"))


def sales_of(lines: DataFrame) -> DataFrame:
    return lines.select("rep_id", "territory_id", "product_id", "month", "year", "month_num", "units_sold",
                        "revenue_usd", "discount_pct", "net_revenue_usd")


def calls_of(lines: DataFrame) -> DataFrame:
    return lines.select(
        "rep_id", "hcp_id", "territory_id", F.col("product_id").alias("product_promoted"), "call_date", "month",
        "year", "channel", "converted", F.col("units_sold").alias("call_duration_min"), "samples_dropped")


def sales(t: dict[str, DataFrame]) -> DataFrame:
    return sales_of(order_lines(t))


def call_logs(t: dict[str, DataFrame]) -> DataFrame:
    return calls_of(order_lines(t))


def fixture_star(spark: SparkSession, sf_dir: str, p: Params) -> Star:
    """The star as lazy views of the tables in ``sf_dir``: nothing is written or kept."""
    t = read_tpch(spark, sf_dir)
    return Star(territories=territories(t), products=products(t, p), reps=reps(t),
                physicians=physicians(t), sales=sales(t), call_logs=call_logs(t))


def materialize_star(spark: SparkSession, sf_dir: str, p: Params, path: str) -> Star:
    """Derive the star from the test tables, write it under ``path``, which the caller names, and return it read back.

    The four dimensions and one fact table of order lines (partitioned by year)
    are written by concurrent jobs; sales and calls are projections of the
    order lines, so the large join runs once.
    """
    t = read_tpch(spark, sf_dir)
    lines = order_lines(t)
    tables = {"territories": territories(t), "products": products(t, p), "reps": reps(t),
              "physicians": physicians(t), "order_lines": lines}
    write_tables(tables, path, partition_by={"order_lines": "year"})
    back = read_tables(spark, path, tables)
    return Star(territories=back["territories"], products=back["products"], reps=back["reps"],
                physicians=back["physicians"], sales=sales_of(back["order_lines"]),
                call_logs=calls_of(back["order_lines"]))
