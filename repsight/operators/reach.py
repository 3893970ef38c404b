"""Distinct counts that merge across grains (the opt-in beside the exact counts of #1, #12, #16 and #20).

A count of distinct reps or HCPs per territory and month says nothing about
the count per region or year: the same rep stands in several rows. A rollup
that keeps a HyperLogLog sketch of the entities instead of their number can be
merged to every coarser grain without reading the facts again. Each fact is
read once for the finest rollup; the sketches are partial aggregates before
the one shuffle, and no row is copied per distinct count.

Error: a sketch keeps the hashes of its values themselves while there are no
more than three quarters of ``2^(lg_k - 3)`` (1,536 at 14), and counts those without
error but for collisions of 26-bit hashes; beyond, the relative standard error is about
``1.04 / sqrt(2^lg_k)`` (0.8 % at 14). Merging adds no error: the merged sketch
is that of all rows. Sums and row counts beside them are exact.

Nulls are no entity and aren't counted; a null key is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repsight.functions.exprs import as_int, money_sum, to_money

LG_K = 14
#: Prefix of the sketch columns of a rollup.
SKETCH = "sketch_"


def _as_text(entity: str) -> Column:
    return F.col(entity).cast("string")


def call_reach(call_logs: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Calls per territory, product, year and month: calls, conversions, sketches of HCPs and reps."""
    return call_logs.groupBy("territory_id", F.col("product_promoted").alias("product_id"), "year", "month").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(as_int("converted")).cast("bigint").alias("conversions"),
        F.hll_sketch_agg(_as_text("hcp_id"), F.lit(lg_k)).alias(f"{SKETCH}hcps"), F.hll_sketch_agg(_as_text("rep_id"), F.lit(lg_k)).alias(f"{SKETCH}reps"))


def sales_reach(sales: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Sales per territory, product, year and month: cents, units, a sketch of reps."""
    return sales.groupBy("territory_id", "product_id", "year", "month").agg(
        money_sum("revenue_usd").alias("cents"), F.sum("units_sold").cast("bigint").alias("units"),
        F.hll_sketch_agg(_as_text("rep_id"), F.lit(lg_k)).alias(f"{SKETCH}reps"))


def merge(rollup: DataFrame, keys: Sequence[str], grain: Sequence[str] = ("territory_id", "product_id", "year", "month")) -> DataFrame:
    """A rollup at a coarser grain: sums added, sketches united; ``keys`` may be columns joined to the rollup.

    Columns that are neither keys nor of the rollup's ``grain`` are measures.
    Merging a merged rollup again equals merging the finest one.
    """
    measures = [c for c in rollup.columns if c not in keys and c not in grain]
    merged = [(F.hll_union_agg(c) if c.startswith(SKETCH) else F.sum(c).cast("bigint")).alias(c) for c in measures]
    return rollup.groupBy(*keys).agg(*merged)


def counted(rollup: DataFrame) -> DataFrame:
    """The rollup with each sketch replaced by its estimate (``sketch_reps`` becomes ``reps``)."""
    return rollup.select(*[F.hll_sketch_estimate(c).alias(c.removeprefix(SKETCH)) if c.startswith(SKETCH) else F.col(c) for c in rollup.columns])


def _placed(rollup: DataFrame, territories: DataFrame) -> DataFrame:
    return rollup.join(territories.select("territory_id", "region"), "territory_id").drop("territory_id")


def region_year_reach(call_logs: DataFrame, territories: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Calls, conversions and distinct HCPs and reps per region and year, from the territory rollup."""
    return counted(merge(_placed(call_reach(call_logs, lg_k), territories), ("region", "year")))


def region_product_reach(sales: DataFrame, territories: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Revenue, units and distinct reps per region and product, from the territory rollup."""
    rolled = counted(merge(_placed(sales_reach(sales, lg_k), territories), ("region", "product_id")))
    return rolled.select("region", "product_id", to_money("cents").alias("revenue"), "units", "reps")
