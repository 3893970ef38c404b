"""Plan inspection through the public ``explain`` output."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints (the physical plan before adaptive re-planning)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def exchanges(df: DataFrame) -> list[str]:
    """The exchange (shuffle and broadcast) lines of the plan, for a quick review."""
    return [ln.strip() for ln in plan_text(df, "simple").splitlines() if "Exchange" in ln]


def census(df: DataFrame) -> dict[str, int]:
    """Counts of shuffles, broadcasts, single-partition exchanges, windows and subqueries."""
    import re
    t = plan_text(df)
    return {
        "shuffles": len(re.findall(r"Arguments: (?:hashpartitioning|rangepartitioning)", t)),
        "broadcasts": len(re.findall(r"\(\d+\) BroadcastExchange", t)),
        "single_partition": t.count("Arguments: SinglePartition"),
        "windows": len(re.findall(r"\(\d+\) Window", t)),
        "subqueries": len(re.findall(r"^Subquery:\d+", t, re.M)),
    }


def census_table(spark, sf_dir: str) -> str:
    """The plan census of every registered query, as a Markdown table (see README)."""
    from repsight.params import fixture_params
    from repsight.plans.catalog import QUERIES
    from repsight.sources.fixtures import fixture_star

    p = fixture_params()
    star = fixture_star(spark, sf_dir, p)
    lines = ["| query | shuffles | broadcasts | single-partition | windows | subqueries |", "|---|---|---|---|---|---|"]
    for name, q in QUERIES.items():
        c = census(q(star, p))
        lines.append(f"| {name} | {c['shuffles']} | {c['broadcasts']} | {c['single_partition']} | {c['windows']} "
                     f"| {c['subqueries']} |")
    return "\n".join(lines)
