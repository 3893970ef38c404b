"""Command line: the whole analysis run, like the original script.

    python -m repsight --star DIR [--star-format csv|parquet] --out DIR [--format csv|parquet|json]
    python -m repsight --tpch DIR --out DIR            # the TPC-H-shaped test tables, fixture parameters

Under ``spark-submit`` the job runs on the submitted master; with plain
``python`` on the one of Spark's own settings (local if there are none). Parameters can be overridden with ``--set name=value``.
"""

from __future__ import annotations

import argparse
import ast
import dataclasses
import sys

from pyspark.sql import SparkSession

from repsight.params import Params, fixture_params
from repsight.plans.session import RECOMMENDED_CONF
from repsight.plans.analysis import RESULTS, run_analysis


def _params(base: Params, overrides: list[str]) -> Params:
    changes = {}
    fields = {f.name for f in dataclasses.fields(Params)}
    for item in overrides:
        name, _, raw = item.partition("=")
        if name not in fields:
            raise SystemExit(f"unknown parameter {name!r}")
        try:
            changes[name] = ast.literal_eval(raw)
        except (ValueError, SyntaxError):
            changes[name] = raw
    return base.with_(**changes)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="repsight", description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--star", help="folder with territories, products, reps, physicians, sales, call_logs")
    src.add_argument("--tpch", help="folder with the TPC-H-shaped test tables (fixture mapping)")
    ap.add_argument("--star-format", default="csv", choices=("csv", "parquet"))
    ap.add_argument("--ingest", help="first write a CSV star to this folder as Parquet, its bad records to <folder>/quarantine")
    ap.add_argument("--out", required=True, help="output folder (one sub-folder per result)")
    ap.add_argument("--format", default="csv", choices=("csv", "parquet", "json"))
    ap.add_argument("--only", nargs="*", choices=RESULTS, help="write only these results")
    ap.add_argument("--region", help="narrow the results that carry a region")
    ap.add_argument("--territory", help="narrow the results that carry a territory")
    ap.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE", help="override a parameter")
    args = ap.parse_args(argv)

    # the master comes from the submission or the Spark settings, never from here
    spark = SparkSession.getActiveSession() or SparkSession.builder.config(map=RECOMMENDED_CONF).getOrCreate()
    if args.tpch:
        from repsight.sources.fixtures import fixture_star
        p = _params(fixture_params(), args.set)
        star = fixture_star(spark, args.tpch, p)
    else:
        from repsight.sources.readers import ingest_star, read_star
        p = _params(Params(), args.set)
        if args.ingest:
            star, bad = ingest_star(spark, args.star, args.ingest)
            for row in bad.groupBy("table").count().orderBy("table").collect():
                print(f"{row['table']}: {row['count']} records don't fit, see {args.ingest.rstrip('/')}/quarantine")
        else:
            star = read_star(spark, args.star, fmt=args.star_format)
    written = run_analysis(star, p, args.out, fmt=args.format, only=tuple(args.only) if args.only else None,
                           region=args.region, territory_id=args.territory)
    print("\n".join(f"wrote {args.out.rstrip('/')}/{name}" for name in written))
    return 0


if __name__ == "__main__":
    sys.exit(main())
