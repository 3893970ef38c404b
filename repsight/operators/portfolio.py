"""M5 — product portfolio (operators 20-23).

Sales are reduced to product × month straight from the facts, before the
product dimension is joined. The product dimension is not hinted: its size is
whatever the catalog holds, so the optimizer's size threshold (and AQE at
run time, on the measured size) decides whether to broadcast it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import (distinct_count, money_sum, pct_change, round_half_away, to_money,
                                      wide_sum)
from repsight.functions.ranking import over_all
from repsight.grains import SalesGrains
from repsight.params import Params

PRODUCT_ATTRS = ("product_id", "product_name", "therapeutic_area", "bcg_quadrant", "market_share_pct",
                 "market_growth_rate", "list_price")


def _products(products: DataFrame) -> DataFrame:
    return products.select("product_id", F.col("name").alias("product_name"), "therapeutic_area",
                           "bcg_quadrant", "market_share_pct", "market_growth_rate", "list_price")


def _product_month_cents(sales: DataFrame | SalesGrains, products: DataFrame, rsd: float | None = None) -> DataFrame:
    if isinstance(sales, SalesGrains):
        return sales.product_month().join(_products(products), "product_id")
    monthly = (sales.groupBy("product_id", "year", "month_num", "month")
               .agg(money_sum("revenue_usd").alias("monthly_revenue"),
                    F.sum("units_sold").cast("bigint").alias("monthly_units"),
                    distinct_count("rep_id", rsd).alias("reps_selling"),
                    distinct_count("territory_id", rsd).alias("territories_active")))
    return monthly.join(_products(products), "product_id")


def product_month_rollup(sales: DataFrame, products: DataFrame, p: Params | None = None) -> DataFrame:
    """#20 monthly revenue, units, distinct reps and territories per product."""
    return _product_month_cents(sales, products, p.approx_distinct_rsd if p else None).select(
        *PRODUCT_ATTRS, "year", "month_num", "month", to_money("monthly_revenue").alias("monthly_revenue"),
        "monthly_units", "reps_selling", "territories_active")


def _product_totals_cents(sales: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    yr, rev = F.col("year"), F.col("monthly_revenue")
    return (_product_month_cents(sales, products, p.approx_distinct_rsd).groupBy(*PRODUCT_ATTRS)
            .agg(F.sum(rev).alias("total_revenue"),
                 F.sum("monthly_units").cast("bigint").alias("total_units"),
                 F.sum(F.when(yr == p.prior_year, rev)).alias(f"rev_{p.prior_year}"),
                 F.sum(F.when(yr == p.current_year, rev)).alias(f"rev_{p.current_year}"),
                 F.max("reps_selling").alias("peak_reps_selling"),
                 F.max("territories_active").alias("peak_territories")))


def product_totals(sales: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    """#21 totals per product; a year without sales gives null revenue for that year."""
    y0, y1 = f"rev_{p.prior_year}", f"rev_{p.current_year}"
    return _product_totals_cents(sales, products, p).select(
        *PRODUCT_ATTRS, to_money("total_revenue").alias("total_revenue"), "total_units",
        to_money(y0).alias(y0), to_money(y1).alias(y1), "peak_reps_selling", "peak_territories")


def product_portfolio(sales: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    """#22 product totals + YoY growth % and share of all revenue %.

    The grand total is a window over the product rows (a dimension), so the facts are read once.
    """
    y0, y1 = f"rev_{p.prior_year}", f"rev_{p.current_year}"
    totals = _product_totals_cents(sales, products, p).withColumn("_grand", over_all(wide_sum("total_revenue")))
    return totals.withColumn("_share", to_money("total_revenue") / F.nullif(to_money("_grand"), F.lit(0.0)) * 100.0).select(
        *PRODUCT_ATTRS, to_money("total_revenue").alias("total_revenue"), "total_units",
        to_money(y0).alias(y0), to_money(y1).alias(y1), "peak_reps_selling", "peak_territories",
        round_half_away(pct_change(y1, y0), 1).alias("revenue_growth_pct"),
        round_half_away("_share", 1).alias("portfolio_share_pct"))


def product_monthly_trend(sales: DataFrame, products: DataFrame) -> DataFrame:
    """#23 monthly revenue per product (for sparklines)."""
    if isinstance(sales, SalesGrains):
        monthly = sales.product_month().withColumn("monthly_revenue", to_money("monthly_revenue"))
    else:
        monthly = sales.groupBy("product_id", "month", "year", "month_num").agg(to_money(money_sum("revenue_usd")).alias("monthly_revenue"))
    return (monthly.join(products.select("product_id", F.col("name").alias("product_name"), "bcg_quadrant"),
                         "product_id")
            .select("product_id", "product_name", "bcg_quadrant", "month", "year", "month_num",
                    "monthly_revenue"))
