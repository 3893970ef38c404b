"""Column expressions shared by the operators.

All of these are built-in Catalyst expressions, so they stay inside
whole-stage codegen. Conventions enforced here:

* money (two decimals) is summed as an exact 64-bit count of cents
  (order-independent, and far cheaper than wide decimals, whose arithmetic
  falls back to BigDecimal); sums that may span the grand total add up the
  per-group counts as ``decimal(38,0)`` (``wide_sum``); money becomes a
  ``double`` of dollars only at the output (``to_money``);
* division is always guarded (``x / nullif(y, 0)``), so ANSI mode never raises;
* rounding is half away from zero on the binary double, the rule of the
  original SQL engine (``round_half_away``); Spark's ``round`` works on the
  decimal text of a double and differs on a few values.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def round_half_away(x, digits: int = 0) -> Column:
    """``round(x, digits)`` half away from zero, on the double ``y = x * 10^digits``.

    Spark's ``round(y, 0)`` rounds the shortest decimal text of ``y`` half-up;
    that text lies on the same side of ``k + 0.5`` as the binary ``y`` (``k + 0.5``
    is exact in binary), so the result equals C ``round(y)`` — the rule of the
    original engine — also for inputs such as 1.005 whose text rounds the
    other way. Negative inputs go through ``-round(-y)`` to keep ``-0.0``.
    """
    scale = float(10 ** digits)
    y = _c(x).cast("double") * scale
    return F.when(y < 0, -F.round(-y, 0)).otherwise(F.round(y, 0)) / scale


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, computed once per row however often later columns use it
    (a projection would be inlined into each of them, scalar subqueries and all)."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def safe_div(num, den) -> Column:
    """``num / nullif(den, 0)`` as a double; null when the denominator is 0 or null."""
    d = _c(den)
    return _c(num).cast("double") / F.when(d != 0, d.cast("double"))


def pct_change(current, prior) -> Column:
    """``(current - prior) / nullif(prior, 0) * 100``."""
    cur, pri = _c(current).cast("double"), _c(prior).cast("double")
    return (cur - pri) / F.when(pri != 0, pri) * 100.0


def as_int(flag) -> Column:
    """Boolean as 0/1 integer (``CAST(b AS INTEGER)``)."""
    return _c(flag).cast("int")


def rate(flag) -> Column:
    """Share of true values: ``avg(cast(flag as int))``."""
    return F.avg(as_int(flag))


def cents(x) -> Column:
    """A money value with two decimals as an exact bigint count of cents.

    The value's double is within an ulp of ``cents / 100``; ``rint`` of it
    times 100 recovers the cents exactly for any amount below 10^13 dollars.
    """
    return F.rint(_c(x).cast("double") * 100.0).cast("bigint")


def money_sum(x) -> Column:
    """Exact sum of a money column, in cents (bigint; ANSI mode raises on overflow)."""
    return F.sum(cents(x))


def wide_sum(c) -> Column:
    """Second-level sum of cent counts that may span the grand total (decimal, cannot overflow).

    Use it on already-reduced rows (per-group cents); the first level stays a
    fast 64-bit ``money_sum``.
    """
    return F.sum(_c(c).cast("decimal(38,0)"))


def to_money(c) -> Column:
    """Cents to dollars at the output: a double (equal to casting the exact decimal)."""
    return _c(c).cast("double") / 100.0


def exact_mean(x, scale: int = 2) -> Column:
    """Mean of values already rounded to ``scale`` places, summed exactly.

    ``sum(cast(x as decimal)) / count(x)``: order-independent, unlike a double ``avg``.
    """
    return F.sum(_c(x).cast(f"decimal(38,{scale})")).cast("double") / F.count(_c(x)).cast("double")


# Fixed point of the mean of ratios: each ratio is kept as round(ratio * 10^15).
RATIO_FIXED = 10 ** 15


def fixed_ratio(num: str, den: str) -> Column:
    """``num / den * 10^15`` of two non-negative integer columns, rounded to nearest (decimal(38,0))."""
    return F.expr(f"CAST((2 * CAST(`{num}` AS DECIMAL(38,0)) * {RATIO_FIXED} + `{den}`) div (2 * CAST(`{den}` AS DECIMAL(38,0))) AS DECIMAL(38,0))")


def round_mean_of_fixed(total: str, count: str, scale: float, digits: int) -> Column:
    """Mean of ``fixed_ratio`` values times ``scale``, rounded half up to ``digits`` places.

    The mean is first rounded to 10^-12. A mean that is a tie, built from
    ratios that 10^-15 can't hold, so is that tie again, and rounds up; and
    the result does not depend on the order of summation.
    """
    mult = int(round(scale * 10 ** digits))
    step = f"CAST(`{count}` AS DECIMAL(38,0)) * 1000"
    snapped = f"CAST((2 * `{total}` + {step}) div (2 * {step}) AS DECIMAL(38,0))"
    return F.expr(f"(2 * {snapped} * {mult} + {10 ** 12}) div (2 * {10 ** 12})") / float(10 ** digits)


def distinct_count(x, approx_rsd: float | None = None) -> Column:
    """``COUNT(DISTINCT x)``: exact, or HyperLogLog++ when ``approx_rsd`` is given (opt-in)."""
    return F.countDistinct(_c(x)) if approx_rsd is None else F.approx_count_distinct(_c(x), rsd=approx_rsd)


def distinct_months(month, words: int, approx_rsd: float | None = None) -> Column:
    """Number of distinct calendar months among dates, as an aggregate without copies of rows.

    A second ``COUNT(DISTINCT ..)`` in one aggregation makes Spark copy each
    row once per count. Months have dense codes, so they are kept as bits of
    ``words`` longs per group, merged by ``bit_or`` in the same partial
    aggregation as the sums. The place of a month is its code modulo
    ``64 * words``, which is one-to-one within a group that spans fewer months
    than that; a longer span is an error that names the setting, never a wrong
    count. ``words`` 0 counts with ``COUNT(DISTINCT ..)`` instead, over any
    span. Null months aren't counted.
    """
    if words == 0 or approx_rsd is not None:
        return distinct_count(F.trunc(_c(month), "month"), approx_rsd)
    bits = 64 * words
    code = F.year(_c(month)) * 12 + F.month(_c(month))
    place = F.pmod(code, F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    count = F.lit(0)
    for k in range(words):
        inside = (place >= 64 * k) & (place < 64 * (k + 1))
        count = count + F.bit_count(F.bit_or(F.when(inside, bit).otherwise(F.lit(0).cast("bigint"))))
    problem = F.raise_error(F.lit(f"months of one group span {bits} months or more: raise Params.month_words ({words}), or 0 for COUNT(DISTINCT)"))
    return F.when(F.max(code) - F.min(code) >= bits, problem.cast("bigint")).otherwise(count.cast("bigint"))


def lookup(key, pairs: Iterable[tuple], default=None) -> Column:
    """Simple ``CASE key WHEN k1 THEN v1 ... [ELSE default] END`` from parameter pairs."""
    k = _c(key)
    expr = None
    for kk, vv in pairs:
        expr = F.when(k == kk, vv) if expr is None else expr.when(k == kk, vv)
    if expr is None:
        return F.lit(default)
    return expr.otherwise(default) if default is not None else expr


# ---------------------------------------------------------------- labels

def _by_two(first: Column, second: Column, labels: tuple[str, str, str, str]) -> Column:
    """The label of two tests: both, only the first, only the second, none."""
    place = F.lit(1) + F.when(first, 0).otherwise(2) + F.when(second, 0).otherwise(1)
    return F.element_at(F.array(*map(F.lit, labels)), place)


def whitespace_quadrant(mpi, revenue, med_mpi, med_revenue) -> Column:
    """Star / Whitespace / Saturated / Abandon by ``>=`` against the medians; a missing value counts as low."""
    return _by_two(_c(mpi) >= _c(med_mpi), _c(revenue) >= _c(med_revenue), ("Star", "Whitespace", "Saturated", "Abandon"))


_TESTS = {"=": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def first_match(rules: Iterable[tuple], values: dict[str, Column]) -> Column:
    """The label of the first rule all of whose bounds hold; null when none does.

    A rule is (label, bounds), a bound (name of a value, test, limit). A missing
    value fulfils no bound; a rule without bounds always holds.
    """
    expr = None
    for label, bounds in rules:
        unknown = [b for b in bounds if b[0] not in values or b[1] not in _TESTS]
        if unknown:
            raise ValueError(f"rule {label!r}: unknown bounds {unknown}")
        holds = F.lit(True)
        for name, test, limit in bounds:
            holds = holds & _TESTS[test](values[name], F.lit(limit))
        expr = F.when(holds, label) if expr is None else expr.when(holds, label)
    return F.lit(None).cast("string") if expr is None else expr


def coverage_status(tier, monthly_calls, total_calls, p) -> Column:
    """First match of ``p.coverage_table``; by default an unreached tier A/B HCP is never 'Not Reached'."""
    return first_match(p.coverage_table, {"tier": _c(tier), "monthly_calls": _c(monthly_calls), "calls": _c(total_calls)})


def bcg_label(share, growth, p) -> Column:
    """Star / Cash Cow / Question Mark / Dog by ``>=`` against the cut-offs; a missing value counts as low."""
    return _by_two(_c(share) >= p.bcg_share_cut, _c(growth) >= p.bcg_growth_cut, ("Star", "Cash Cow", "Question Mark", "Dog"))


def deployment_label(mpi, productivity, p) -> Column:
    """First match of ``p.deployment_table`` on the potential (MPI / 100) and the productivity score."""
    return first_match(p.deployment_table, {"potential": _c(mpi).cast("double") / 100.0, "productivity": _c(productivity)})
