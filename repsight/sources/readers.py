"""Readers for the star schema as files: CSV (the original layout) or Parquet.

Schemas are declared, never inferred (inference costs a full extra pass and
would read money as double). CSV columns are bound by header name, and records
that don't fit are kept apart (``csv_tables``): ``read_star`` leaves them out,
``quarantine`` returns them, ``ingest_star`` writes both sides.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repsight.sources.csv_tables import read_csv_table
from repsight.sources.schema import SCHEMAS, Star
from repsight.sources.sinks import write_star


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "csv") -> DataFrame:
    """One table in its declared schema (CSV: the records that fit it)."""
    schema = SCHEMAS[name]
    if fmt == "csv":
        return read_csv_table(spark, path, schema).good
    if fmt == "parquet":
        # a partition column (year of the facts) comes back last: restore the declared order
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    raise ValueError(f"unknown format {fmt!r}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, on whatever file system Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _path(spark: SparkSession, directory: str, name: str, fmt: str) -> str:
    for cand in (f"{name}.{fmt}", name):
        p = os.path.join(directory, cand)
        if exists(spark, p):
            return p
    return os.path.join(directory, f"{name}.{fmt}")


def read_star(spark: SparkSession, directory: str, fmt: str = "csv") -> Star:
    """Read ``territories``, ``products``, ``reps``, ``physicians``, ``sales``, ``call_logs``
    from ``directory`` (``<name>.csv`` files or ``<name>`` / ``<name>.parquet`` folders)."""
    return Star(**{n: read_table(spark, _path(spark, directory, n, fmt), n, fmt) for n in SCHEMAS})


def quarantine(spark: SparkSession, directory: str) -> DataFrame:
    """The CSV records of a star that ``read_star`` leaves out: (table, file, record, columns)."""
    parts = [read_csv_table(spark, _path(spark, directory, n, "csv"), schema).bad.select(F.lit(n).alias("table"), "file", "record", "columns")
             for n, schema in SCHEMAS.items()]
    return reduce(DataFrame.unionByName, parts)


def ingest_star(spark: SparkSession, directory: str, out: str) -> tuple[Star, DataFrame]:
    """Write a CSV star as Parquet under ``out`` (facts by year) and its bad records under ``out/quarantine``; both read back.

    Analyses then read typed columns instead of parsing text once a query.
    """
    write_star(read_star(spark, directory, "csv"), out)
    bad = quarantine(spark, directory)
    path = os.path.join(out, "quarantine")
    bad.write.mode("overwrite").partitionBy("table").parquet(path)
    return read_star(spark, out, "parquet"), spark.read.schema(bad.schema).parquet(path).select(*bad.columns)
