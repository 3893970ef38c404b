"""Global NTILE / RANK / ROW_NUMBER and one-row scalars.

An un-partitioned window (``ntile(k) OVER (ORDER BY x)``) moves every row to
one task. That is right for a bounded frame (territories, products, channels)
and wrong for entities that grow with the data (reps, HCPs). For the latter,
``global_row_number`` numbers rows in parallel:

1. range-partition on the full sort key (the sampled bounds split even a value
   held by a third of the rows, because the unique key is part of the sort
   key), sort within partitions;
2. write a reliable checkpoint, so the counting pass and the numbering pass
   see the very same partitions (re-sampling could move bounds); its files go
   with the frame (``spark.cleaner.referenceTracking.cleanCheckpoints``);
3. count rows per partition (one row per partition — bounded by the
   partition count, so broadcasting it is safe) and turn the counts into
   offsets;
4. row number = offset of the partition + position inside it.

NTILE follows from the row number and the row count N by the standard rule:
with ``q = N div k`` and ``r = N mod k`` the first ``r`` tiles hold ``q + 1`` rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repsight.functions.exprs import once
from repsight.plans.session import ensure_checkpoint_dir


def _order(cols: Sequence) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c).asc_nulls_last() for c in cols]


# ------------------------------------------------------------ window forms

def ntile_window(df: DataFrame, k: int, order: Sequence, out: str) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY order)`` as a plain window (bounded frames only)."""
    return df.withColumn(out, F.ntile(k).over(Window.orderBy(*_order(order))).cast("bigint"))


def rank_window(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """``RANK() OVER (ORDER BY order)`` as a plain window (bounded frames only)."""
    return df.withColumn(out, F.rank().over(Window.orderBy(*_order(order))).cast("bigint"))


# ------------------------------------------------------- distributed forms

def global_row_number(df: DataFrame, order: Sequence, out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)`` without a single-partition exchange.

    ``order`` must be a total order (end it with a unique key) for a
    deterministic answer, exactly as with the window form.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _order(order)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    idx = (ranged.withColumn("_mid", F.monotonically_increasing_id())
           .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
           .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)))
    counts = idx.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (idx.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_pos") + 1).cast("bigint"))
            .drop("_mid", "_pid", "_pos", "_off"))


def tile_of(row_number: Column, n_rows: Column, k: int) -> Column:
    """NTILE bucket of a 1-based row number among ``n_rows`` rows."""
    rn, n = row_number.cast("bigint"), n_rows.cast("bigint")
    q = F.floor(n / F.lit(k)).cast("bigint")
    r = n - q * F.lit(k)
    big = r * (q + 1)
    first = F.floor((rn + q) / (q + 1)).cast("bigint")                # ceil(rn / (q+1))
    second = r + F.floor((rn - big + q - 1) / F.when(q > 0, q)).cast("bigint")  # r + ceil((rn-big)/q)
    return F.when(rn <= big, first).otherwise(second)


def ntile_distributed(df: DataFrame, k: int, order: Sequence, out: str) -> DataFrame:
    numbered = global_row_number(df, order, out="_rn")
    numbered = once(numbered, "_n_rows", numbered.agg(F.count(F.lit(1))).scalar())
    return numbered.withColumn(out, tile_of(F.col("_rn"), F.col("_n_rows"), k)).drop("_rn", "_n_rows")


def rank_distributed(df: DataFrame, order: Sequence, out: str, num_partitions: int | None = None) -> DataFrame:
    """``RANK() OVER (ORDER BY order)`` without a single-partition exchange, whatever the ties.

    Rows are range-partitioned by the order and a tie-breaking row tag, so a
    value that a third of the rows share spreads over many partitions. Inside a
    partition a window over that partition ranks its rows. Only the first and
    the last run of equal values of a partition can reach into others: the
    rank of such a run is that of its first row anywhere, taken from a table of
    two rows per partition (bounded by the partition count, hence broadcast).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [k.alias(f"_k{i}") for i, k in enumerate(_values(order))]
    names = [f"_k{i}" for i in range(len(keys))]
    by = [_direction(o, name) for o, name in zip(order, names, strict=True)]
    tagged = df.select("*", *keys).withColumn("_tag", F.monotonically_increasing_id())
    ranged = tagged.repartitionByRange(n, *by, F.col("_tag")).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    inner = ranged.withColumn("_in", F.rank().over(Window.partitionBy("_pid").orderBy(*by)).cast("bigint"))
    run, last = F.struct(*names), F.max_by(F.struct(*names), F.col("_in"))
    parts = inner.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min_by(run, F.col("_in")).alias("_first"), last.alias("_last"), F.max("_in").alias("_last_in"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).checkpoint(eager=True)
    ends = parts.select(F.inline(F.array(F.struct(F.col("_first").alias("_run"), (F.col("_off") + 1).alias("_start")),
                                         F.struct(F.col("_last").alias("_run"), (F.col("_off") + F.col("_last_in")).alias("_start")))))
    starts = ends.groupBy("_run").agg(F.min("_start").alias("_start"))
    joined = inner.join(F.broadcast(parts.select("_pid", "_off")), "_pid").withColumn("_mine", run)
    joined = joined.join(F.broadcast(starts), F.col("_mine").eqNullSafe(F.col("_run")), "left")
    return joined.select(*df.columns, F.coalesce("_start", F.col("_off") + F.col("_in")).cast("bigint").alias(out))


def _values(order: Sequence) -> list[Column]:
    """The ordered values: of (column, "desc") or column."""
    return [F.col(o[0] if isinstance(o, tuple) else o) for o in order]


def _direction(o, name: str) -> Column:
    return F.col(name).desc_nulls_last() if isinstance(o, tuple) and o[1] == "desc" else F.col(name).asc_nulls_last()


# ------------------------------------------------------------ medians of large frames

#: Values left when a selection ends, which the driver sorts. Precision of the sketch that bounds each round's range.
SELECT_ROWS, SKETCH_ACCURACY = 20_000, 10_000


def exact_percentile(df: DataFrame, column: str, q: float = 0.5, select_rows: int | None = None, accuracy: int | None = None) -> float | None:
    """The interpolated percentile of a column (nulls left out; null without values), by distributed selection.

    ``percentile`` keeps every distinct value in one task's state. Here the two
    middle ranks are closed in: a mergeable quantile sketch proposes a range of
    values round them, one aggregation counts the values below and inside it,
    and the range shrinks about ``accuracy / 2``-fold a round until it holds one value
    or at most ``select_rows`` rows, which are then sorted. A proposal
    that misses a rank is widened to the last certain bound, so the answer is
    exact whatever the sketch says. A task's state is the sketch, never the values.
    """
    limit, accuracy = select_rows or SELECT_ROWS, accuracy or SKETCH_ACCURACY
    ensure_checkpoint_dir(df.sparkSession)
    x = F.col("_x")
    values = df.select(F.col(column).cast("double").alias("_x")).filter(x.isNotNull()).checkpoint(eager=True)
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return None
    place = q * (n - 1)
    first, last = int(place), min(int(place) + (place > int(place)), n - 1)
    below, inside = 0, n          # values under ``low``, and from ``low`` to ``high``
    while low < high and inside > limit:
        part = values.filter((x >= low) & (x <= high))
        step = 2.0 / accuracy
        share = [max(0.0, (first - below) / inside - step), min(1.0, (last - below) / inside + step)]
        a, b = part.agg(F.percentile_approx(x, share, accuracy)).first()[0]
        under, within = part.agg(F.count(F.when(x < a, 1)), F.count(F.when((x >= a) & (x <= b), 1))).first()
        # a bound that misses its rank stays where it was
        a, under = (a, under) if below + under <= first else (low, 0)
        if below + under + part.filter((x >= a) & (x <= b)).count() <= last:
            b = high
        if (a, b) == (low, high):   # ties fill both ends: step inside them
            edges = part.agg(F.count(F.when(x == low, 1)), F.min(F.when(x > low, x)), F.max(F.when(x < high, x)), F.count(F.when(x < high, 1))).first()
            at_low, up, down, to_high = edges
            if last < below + at_low:
                high = low
            elif first >= below + to_high:
                below, low = below + to_high, high
            elif first >= below + at_low:
                below, low = below + at_low, up
            elif last < below + to_high:
                high = down
            else:                   # the two ranks lie on the two ends or beside them
                return _between(low, high if last >= below + to_high else up, place)
            inside = values.filter((x >= low) & (x <= high)).count()
            continue
        below, low, high = below + under, a, b
        inside = values.filter((x >= low) & (x <= high)).count()
    if low == high:
        return low
    kept = sorted(r[0] for r in values.filter((x >= low) & (x <= high)).collect())
    return _between(kept[first - below], kept[last - below], place)


def _between(low: float, high: float, place: float) -> float:
    part = place - int(place)
    return low if low == high or not part else (1.0 - part) * low + part * high


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the exact median of each column, as ``med_<column>``. The frame's rows are read once, into a checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.select(*columns).checkpoint(eager=True)
    one = df.sparkSession.range(1)
    return one.select(*[F.lit(exact_percentile(kept, c)).cast("double").alias(f"med_{c}") for c in columns])


# ------------------------------------------------------------ scalars

def over_all(agg: Column) -> Column:
    """An aggregate over the whole frame, on every row (``agg OVER ()``).

    One task sees every row, so use it only on frames bounded by a dimension
    (territories, products, channels), never on facts or on entities that
    grow with the data. Several such columns share one exchange.
    """
    return agg.over(Window.partitionBy())


def scalar(one_row: DataFrame, column: str) -> Column:
    """A column of a one-row aggregate as a scalar subquery (no join, no window).

    Spark runs the subquery once and ships its value to the tasks; it fails
    loudly if the frame ever held more than one row.
    """
    return one_row.select(column).scalar()


def scalars(one_row: DataFrame) -> Column:
    """All columns of a one-row aggregate as one struct-valued scalar subquery.

    Take fields with ``.getField(name)``: the identical subquery is computed
    once (``spark.sql.execution.reuseSubquery``), however many fields are used.
    """
    return one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
