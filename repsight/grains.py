"""Every fact grain of the analysis from one pass over each fact table.

The modules need sales by territory and year, by rep, by product and month,
and calls by territory and year, by rep, by HCP and by channel cell, with
distinct counts beside the sums. One ``GROUPING SETS`` aggregation over a fact
builds them all: each set also groups by what a grain counts distinctly, so
that afterwards a distinct count is a plain count of reduced rows. The partial
aggregation of all sets comes before the one shuffle of the pass; the result
is written once, split by set, to the shared folder, and operators that are
given grains instead of a fact read the sets they need.

Sums stay exact: money is a 64-bit count of cents.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import as_int, money_sum
from repsight.plans.session import ensure_checkpoint_dir
from repsight.sources.schema import Star

SALES_SETS: dict[str, tuple[str, ...]] = {
    "territory_year_rep": ("territory_id", "year", "rep_id"),
    "rep_product": ("rep_id", "product_id"),
    "rep_month": ("rep_id", "month"),
    "product_month_rep": ("product_id", "year", "month_num", "month", "rep_id"),
    "product_month_territory": ("product_id", "year", "month_num", "month", "territory_id"),
}
CALL_SETS: dict[str, tuple[str, ...]] = {
    "territory_year": ("territory_id", "year"),
    "rep_hcp": ("rep_id", "hcp_id"),
    "rep_month": ("rep_id", "month"),
    "hcp_month": ("hcp_id", "month"),
    "cell": ("channel", "product_promoted", "territory_id"),
}


def _reduced(fact: DataFrame, sets: dict[str, tuple[str, ...]], sums: list[Column], name: str) -> dict[str, DataFrame]:
    """The fact aggregated by every set in one pass, written once; one frame per set."""
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    # the bit of a column is set where a set leaves it out
    number = {n: sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in s) for n, s in sets.items()}
    groups = fact.groupingSets([[F.col(c) for c in s] for s in sets.values()], *[F.col(c) for c in columns])
    rows = groups.agg(F.grouping_id().cast("long").alias("set_id"), *sums)
    path = f"{ensure_checkpoint_dir(fact.sparkSession).rstrip('/')}/grains-{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy("set_id").parquet(path)
    back = fact.sparkSession.read.schema(rows.schema).parquet(path)
    kept = [c for c in rows.columns if c not in columns and c != "set_id"]
    return {n: back.filter(F.col("set_id") == number[n]).select(*s, *kept) for n, s in sets.items()}


def _count(flag: Column | str) -> Column:
    return F.sum(flag).cast("bigint")


@dataclass(frozen=True)
class SalesGrains:
    """The sets of ``SALES_SETS`` with cents ``revenue`` and ``net``, ``units`` and ``n``."""
    sets: dict[str, DataFrame]

    def territory_year(self) -> DataFrame:
        """#1's grain: cents, units and distinct reps."""
        return (self.sets["territory_year_rep"].groupBy("territory_id", "year")
                .agg(F.sum("revenue").alias("revenue"), F.sum("net").alias("net_revenue"), _count("units").alias("units"), F.count("rep_id").alias("active_reps")))

    def rep(self) -> DataFrame:
        """#11's grain: cents, units, distinct products and months."""
        by_product = self.sets["rep_product"].select("rep_id", "revenue", "units", F.col("product_id").isNotNull().cast("int").alias("p"), F.lit(0).alias("m"))
        by_month = self.sets["rep_month"].select("rep_id", F.lit(None).cast("bigint").alias("revenue"), F.lit(None).cast("bigint").alias("units"),
                                                 F.lit(0).alias("p"), F.col("month").isNotNull().cast("int").alias("m"))
        return by_product.unionByName(by_month).groupBy("rep_id").agg(
            F.sum("revenue").alias("total_revenue"), _count("units").alias("total_units"), _count("p").alias("products_sold"), _count("m").alias("active_months"))

    def product_month(self) -> DataFrame:
        """#20's grain: cents, units, distinct reps and territories."""
        keys = ["product_id", "year", "month_num", "month"]
        reps = self.sets["product_month_rep"].select(*keys, "revenue", "units", F.col("rep_id").isNotNull().cast("int").alias("r"), F.lit(0).alias("t"))
        places = self.sets["product_month_territory"].select(*keys, F.lit(None).cast("bigint").alias("revenue"), F.lit(None).cast("bigint").alias("units"),
                                                             F.lit(0).alias("r"), F.col("territory_id").isNotNull().cast("int").alias("t"))
        return reps.unionByName(places).groupBy(*keys).agg(
            F.sum("revenue").alias("monthly_revenue"), _count("units").alias("monthly_units"), _count("r").alias("reps_selling"), _count("t").alias("territories_active"))

    def year_territory_rep(self) -> DataFrame:
        """#28's grain: cents per year, territory and rep."""
        return self.sets["territory_year_rep"].select("year", "territory_id", "rep_id", F.col("revenue").alias("_rev"))

    def month(self) -> DataFrame:
        """#48's grain: rows and cents per month."""
        return self.sets["rep_month"].groupBy("month").agg(_count("n").alias("_n"), F.sum("revenue").alias("_rev"))


@dataclass(frozen=True)
class CallGrains:
    """The sets of ``CALL_SETS`` with calls ``n``, ``conversions``, ``duration`` and ``samples``."""
    sets: dict[str, DataFrame]

    def territory_year(self) -> DataFrame:
        return self.sets["territory_year"]

    def rep(self, physicians: DataFrame) -> DataFrame:
        """#12's and #13's grain: calls, conversions, duration, distinct HCPs and months, calls per tier, calls to known HCPs."""
        known = physicians.select("hcp_id", "prescriber_tier", F.lit(1).alias("_known"))
        met = self.sets["rep_hcp"].join(known, "hcp_id", "left")
        tiers = {f"tier_{t.lower()}_calls": F.when(F.col("prescriber_tier") == t, F.col("n")).otherwise(0) for t in ("A", "B", "C")}
        sums = {"total_calls": F.col("n"), "total_conversions": F.col("conversions"), "_dur": F.col("duration"),
                "unique_hcps_visited": F.col("hcp_id").isNotNull().cast("bigint"), "months_active": F.lit(0).cast("bigint"), **tiers, "_matched": F.col("_known") * F.col("n")}
        rows = met.select("rep_id", *[c.cast("bigint").alias(k) for k, c in sums.items()])
        months = self.sets["rep_month"].select("rep_id", *[(F.col("month").isNotNull().cast("bigint") if k == "months_active" else F.lit(None).cast("bigint")).alias(k) for k in sums])
        return rows.unionByName(months).groupBy("rep_id").agg(*[_count(k).alias(k) for k in sums])

    def hcp(self) -> DataFrame:
        """#16's grain: calls, distinct reps and months, conversions."""
        reps = self.sets["rep_hcp"].select("hcp_id", "n", F.col("rep_id").isNotNull().cast("int").alias("r"), F.lit(0).alias("m"), "conversions")
        months = self.sets["hcp_month"].select("hcp_id", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("r"), F.col("month").isNotNull().cast("int").alias("m"),
                                               F.lit(None).cast("bigint").alias("conversions"))
        return reps.unionByName(months).groupBy("hcp_id").agg(
            _count("n").alias("total_calls_received"), _count("r").alias("unique_reps"), _count("m").alias("months_contacted"), _count("conversions").alias("_conv"))

    def cells(self) -> DataFrame:
        """#24's grain."""
        return self.sets["cell"].select("channel", "product_promoted", "territory_id", F.col("n").alias("total_interactions"), "conversions",
                                        F.col("duration").alias("_duration"), F.col("samples").alias("samples_dropped"))

    def total(self) -> DataFrame:
        """One row: the number of calls."""
        return self.sets["territory_year"].agg(F.coalesce(_count("n"), F.lit(0).cast("bigint")).alias("n"))


def fact_grains(star: Star) -> Star:
    """The star with both facts replaced by their grains; reads each fact once, now."""
    sales = _reduced(star.sales, SALES_SETS, [money_sum("revenue_usd").alias("revenue"), money_sum("net_revenue_usd").alias("net"),
                                              _count("units_sold").alias("units"), F.count(F.lit(1)).alias("n")], "sales")
    calls = _reduced(star.call_logs, CALL_SETS, [F.count(F.lit(1)).alias("n"), _count(as_int("converted")).alias("conversions"),
                                                 _count("call_duration_min").alias("duration"), _count(as_int("samples_dropped")).alias("samples")], "calls")
    return Star(star.territories, star.products, star.reps, star.physicians, SalesGrains(sales), CallGrains(calls))
