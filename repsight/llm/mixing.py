"""#1 Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule, a piecewise-linear multiplier of
that weight over training time 0..1. The schedule's integral times the weight
is the source's share; shares of the total become targets by water-filling (no
target above ``max_repeats`` times its source's size, the excess reshared by
weight). A source's documents follow one another in a fixed pseudo-random
order, again from the front when the target exceeds the source; a document's
stretch of that token line is inverted through the source's cumulative demand
to the training time at which it is due. The mix takes exactly the words up to
the target, so at most one document of a source is taken in part.

Running sums are two-level: within (source, bucket of the order hash) in
parallel, and over the buckets' totals, so a source with a third of all rows
is spread over ``buckets`` groups, also where its rows share a doc_id or have
none: the order hash is of doc_id and text.

Edge cases: a null text has size 0; null sources form one source, last in
order; a document without words is taken 0 words and has no position; null
doc_ids come first among equals; repeated rows are separate documents; sources
without any word get target 0; further columns are ignored, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words

Knots = tuple[tuple[float, float], ...]
#: Weights by the source's place in code point order, repeating, and the schedule of each.
WEIGHTS: tuple[int, ...] = (5, 2, 1)
SCHEDULES: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)), ((0.0, 0.5), (1.0, 1.5)))


def integral(knots: Knots) -> float:
    """Area under a piecewise-linear schedule."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def time_of(share: Column, knots: Knots) -> Column:
    """The time at which the schedule's running integral is ``share`` (0..1) of the whole.

    Each segment's running integral is quadratic; x words into it the time is
    2x / (m + sqrt(m^2 + 2 * slope * x)), which also holds for a flat segment.
    """
    whole, out, area = integral(knots), None, 0.0
    for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
        part = (t1 - t0) * (m0 + m1) / 2
        if part <= 0:
            continue
        slope = (m1 - m0) / (t1 - t0)
        x = F.greatest(share * F.lit(whole) - F.lit(area), F.lit(0.0))
        t = F.lit(t0) + F.lit(2.0) * x / (F.lit(m0) + F.sqrt(F.greatest(F.lit(m0 * m0) + F.lit(2.0 * slope) * x, F.lit(0.0))))
        t = F.when(x > 0, F.least(t, F.lit(t1))).otherwise(F.lit(t0))
        area += part
        out = t if out is None else F.when(share * F.lit(whole) <= F.lit(area - part), out).otherwise(t)
    return out


def order_hash(doc_id: Column, text: Column) -> Column:
    """A fixed pseudo-random place in 0..2^32-1 from doc_id and text, so that rows without id or sharing one spread."""
    low = F.pmod(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(1 << 31))
    of_text = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long")
    return F.pmod(low * F.lit(2654435761) + of_text, F.lit(1 << 32))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple[Knots, ...] = SCHEDULES, max_repeats: int = 3) -> DataFrame:
    """Per source of (source, size): source_size, rank, target; one row per source.

    A source is capped when at the level that just fills it all demands
    together don't exceed the total; the rest share what the capped leave.
    """
    k = len(weights)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    area = [weights[i] * integral(schedules[i % len(schedules)]) for i in range(k)]
    w = F.element_at(F.array(*[F.lit(float(a)) for a in area]), (F.pmod("rank", F.lit(k)) + 1).cast("int"))
    cap = (F.lit(max_repeats) * F.col("source_size")).cast("double")
    by_level = Window.orderBy("level")
    everything = by_level.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    return (ranked.withColumn("w", w).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("w"))
            .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
            .withColumn("filled", F.sum("cap").over(by_level)).withColumn("open_w", F.sum("w").over(everything) - F.sum("w").over(by_level))
            .withColumn("capped", F.col("filled") + F.col("level") * F.col("open_w") <= F.col("total"))
            .withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole))
            .withColumn("rest_w", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(whole))
            .select("source", "source_size", "rank", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("rest") / F.col("rest_w")).alias("target")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple[Knots, ...] = SCHEDULES, max_repeats: int = 3, buckets: int = 1024, key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions.

    ``positions`` holds the training time of each of the document's
    occurrences, in order; ``key`` is carried along as column ``row_key``.
    """
    sized = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("h"), (F.lit(0).cast("long") if key is None else key).alias("row_key"))
    shift = F.floor(F.col("h") / F.lit((1 << 32) // buckets))
    sized = sized.withColumn("bucket", shift.cast("int"))
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    # from the buckets' totals, which Spark reuses, so that the texts aren't counted once more
    goal = targets(totals.select("source", F.col("n").alias("size")), weights, schedules, max_repeats)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(F.col("o.source").alias("o_source"), F.col("o.bucket").alias("o_bucket"), "first", "source_size", "rank", "target")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
              .withColumn("begin", F.col("first") + F.col("inner")).withColumn("goal", F.round("target").cast("long")))
    starts = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda r: F.col("begin") + r * F.col("source_size"))
    due = F.when(F.col("size") > 0, F.filter(starts, lambda s: s < F.col("goal"))).otherwise(F.array().cast("array<long>"))
    taken = F.aggregate(F.col("due"), F.lit(0).cast("long"), lambda a, s: (a + F.least(F.col("size"), F.col("goal") - s)).cast("long"))
    kind = F.pmod("rank", F.lit(len(weights)))

    def when_due(s: Column) -> Column:
        share, out = s.cast("double") / F.col("goal").cast("double"), F.lit(None).cast("double")
        for i in range(len(weights)):
            out = F.when(kind == i, time_of(share, schedules[i % len(schedules)])).otherwise(out)
        return out

    return (placed.withColumn("due", due)
            .select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.transform("due", when_due).alias("positions"), "row_key"))


def training_order(mixed: DataFrame) -> DataFrame:
    """The occurrences of a mix, range-sorted by training time: one row per (document, occurrence)."""
    return (mixed.select("*", F.posexplode("positions").alias("occurrence", "position")).drop("positions")
            .repartitionByRange("position", "doc_id", "occurrence").sortWithinPartitions("position", "doc_id", "occurrence"))
