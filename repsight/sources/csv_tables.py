"""CSV files read by header name, with bad records kept apart.

Spark binds a declared schema to CSV columns by position. Here each file's
header decides: files are grouped by header, each group is read with the
declared types in its own column order (columns that aren't declared are read
as text and left out), and the groups are put together by name. A declared
column that a file lacks, or a name that comes twice, is an error that names
the file; a file without any byte has no rows.

A record that doesn't fit (a value that isn't of its type, too few or too many
fields) costs that record, not the run: ``good`` leaves it out and ``bad``
holds it with its file, its raw text and the columns that didn't parse (none
named: the number of fields is wrong). Values are judged in all columns, also
when a query needs few of them, so every query sees the same rows.

Only headers pass the driver: the first line of each file, read by a few
threads through the Hadoop file system (compressed files as Spark would).
"""

from __future__ import annotations

import csv
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that its header may take at most.
HEADER_BYTES = 1 << 20
_RECORD = "__record"
_THREADS = 16


class HeaderError(ValueError):
    """A file's header doesn't hold the declared columns."""


@dataclass(frozen=True)
class CsvTable:
    """The rows that fit the declared schema, and the records that don't: (file, record, columns)."""
    good: DataFrame
    bad: DataFrame


def _files(spark: SparkSession, path: str) -> list:
    """Status of every data file under ``path`` (a file, folder or pattern)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    out, todo = [], list(found)
    while todo:
        status = todo.pop()
        if status.getPath().getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            todo.extend(fs.listStatus(status.getPath()))
        else:
            out.append(status)
    return out


def _first_line(spark: SparkSession, path) -> str:
    conf = spark._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        reader = spark._jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream)
        line = spark._jvm.org.apache.hadoop.io.Text()
        reader.readLine(line, HEADER_BYTES)
        return line.toString().removeprefix("﻿")
    finally:
        stream.close()


def headers(spark: SparkSession, path: str, sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by header (names trimmed, as written); empty files are left out."""
    files = [f.getPath() for f in _files(spark, path) if f.getLen() > 0]
    with ThreadPoolExecutor(max_workers=_THREADS) as pool:
        lines = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for file, line in zip(files, lines, strict=True):
        names = next(csv.reader([line], delimiter=sep), [])
        groups[tuple(n.strip() for n in names)].append(file.toString())
    return dict(groups)


def _checked(names: tuple[str, ...], schema: T.StructType, files: list[str]) -> list[str]:
    lower = [n.lower() for n in names]
    missing = [c for c in schema.fieldNames() if c.lower() not in lower]
    if missing:
        raise HeaderError(f"{files[0]} (and {len(files) - 1} more with this header) lacks {', '.join(missing)}; its header is {', '.join(names)}")
    twice = sorted({n for n in lower if lower.count(n) > 1})
    if twice:
        raise HeaderError(f"{files[0]} names {', '.join(twice)} more than once")
    return lower


def _group(spark: SparkSession, names: tuple[str, ...], files: list[str], schema: T.StructType, sep: str) -> tuple[DataFrame, DataFrame]:
    lower = _checked(names, schema, files)
    declared = {f.name.lower(): f for f in schema.fields}
    fields = [T.StructField(declared[n].name, declared[n].dataType) if n in declared else T.StructField(f"__extra_{k}", T.StringType()) for k, n in enumerate(lower)]
    read = (spark.read.schema(T.StructType([*fields, T.StructField(_RECORD, T.StringType())]))
            .options(header=True, sep=sep, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD,
                     dateFormat="yyyy-MM-dd", enforceSchema=True).csv(files))
    # null exactly where the record fits. Spark converts (and judges) only the columns that a query needs, so all of them are named here
    nothing = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in schema.fieldNames()])
    unfit = F.concat(F.col(_RECORD), F.when(nothing, "0").otherwise("1"))
    good = read.filter(unfit.isNull()).select(*schema.fieldNames())
    # the record once more as text: a value that is there as text but not as its type didn't parse
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    raw = F.from_csv(_RECORD, text.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep, "quote": '"', "escape": '"'})
    wrong = [F.when(F.col("__raw").getField(f.name).isNotNull() & F.col(f.name).isNull(), F.lit(f.name)) for f in fields if not f.name.startswith("__extra_")]
    bad = (read.withColumn("__file", F.col("_metadata.file_path")).filter(unfit.isNotNull()).withColumn("__raw", raw)
           .select(F.col("__file").alias("file"), F.col(_RECORD).alias("record"), F.array_compact(F.array(*wrong)).alias("columns")))
    return good, bad


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> CsvTable:
    """The records of all files under ``path`` by header name, in the declared order and types."""
    groups = headers(spark, path, sep)
    if not groups:
        return CsvTable(spark.createDataFrame([], schema), spark.createDataFrame([], "file string, record string, columns array<string>"))
    parts = [_group(spark, names, files, schema, sep) for names, files in sorted(groups.items())]
    return CsvTable(reduce(DataFrame.unionByName, [g for g, _ in parts]), reduce(DataFrame.unionByName, [b for _, b in parts]))
