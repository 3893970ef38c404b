"""Writers: results as CSV / Parquet / JSON, and the star schema as tables.

Results are written by Spark's own writers (one folder per result, many part
files); nothing goes through the driver. Fact tables are partitioned by
``year`` so year filters prune whole folders.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from repsight.sources.schema import Star

FACTS = ("sales", "call_logs")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


# Rows per written file: a task that holds a skewed share of a table still writes
# files of bounded size (readers then split them over many tasks).
MAX_RECORDS_PER_FILE = 5_000_000


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None,
                 fmt: str = "parquet", mode: str = "overwrite",
                 max_records_per_file: int = MAX_RECORDS_PER_FILE) -> None:
    """Write each frame to ``path/<name>`` (CSV: ``path/<name>.csv`` with a header).

    The writes are independent jobs; they are submitted together so the
    scheduler can run them side by side.
    """
    parts = partition_by or {}

    def one(item: tuple[str, DataFrame]) -> None:
        name, df = item
        w = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
        if fmt == "csv":
            w.option("header", True).csv(os.path.join(path, f"{name}.csv"))
            return
        if name in parts:
            w = w.partitionBy(parts[name])
        w.parquet(os.path.join(path, name))

    with ThreadPoolExecutor(max_workers=max(len(tables), 1)) as pool:
        list(pool.map(one, tables.items()))


def read_tables(spark: SparkSession, path: str, like: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Read back Parquet tables written by ``write_tables`` with the schemas and column order of ``like``."""
    return {name: spark.read.schema(df.schema).parquet(os.path.join(path, name)).select(*df.columns)
            for name, df in like.items()}


def write_star(star: Star, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write the six tables under ``path``: Parquet (facts partitioned by year) or
    CSV with a header (one ``<name>.csv`` folder per table, the original layout)."""
    parts = {n: "year" for n, df in star.tables().items() if n in FACTS and "year" in df.columns}
    write_tables(star.tables(), path, parts, fmt=fmt, mode=mode)


def read_written_star(spark: SparkSession, path: str, like: Star) -> Star:
    """Read back a star written by ``write_star`` (Parquet) with the schemas of ``like``."""
    return Star(**read_tables(spark, path, like.tables()))
