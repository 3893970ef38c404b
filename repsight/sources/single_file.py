"""One ordered CSV file per result, whatever its size.

The rows are range-sorted and written in parallel as part files without a
header; then the parts become one file without passing through one task or the
driver:

- a file system that can ``concat`` (HDFS) joins header and parts by metadata;
- on a shared POSIX path (``file:``) every part's place in the file follows
  from the sizes of the parts before it, and tasks copy their parts there in
  parallel, each with positional writes. A task that is run again writes the
  same bytes to the same place.

Other file systems (object stores) can do neither: ``can_join`` is False there
and ``write_ordered_csv`` raises before any work.

The file appears under its name only when it is whole. An empty result is a
file with the header alone. Rows that are equal in every sort column stand in
any order among themselves.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes copied at once.
CHUNK = 8 << 20
CONCAT = "fs.capability.paths.concat"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def _way(fs, path) -> str | None:
    if fs.getUri().getScheme() == "file":
        return "copy"
    return "concat" if fs.hasPathCapability(path, CONCAT) else None


def can_join(spark: SparkSession, path: str) -> bool:
    """Whether parts under ``path`` can become one file without being read by one task."""
    return _way(*_file_system(spark, path)) is not None


def write_result_file(df: DataFrame, folder: str, order: Sequence[Column | str]) -> None:
    """``folder`` replaced by one that holds the ordered result as ``<name of the folder>.csv`` alone."""
    fs, at = _file_system(df.sparkSession, folder)
    fs.delete(at, True)
    write_ordered_csv(df, f"{folder.rstrip('/')}/{at.getName()}.csv", order)


def header_line(spark: SparkSession, columns: Sequence[str]) -> str:
    """The CSV header as Spark's writer gives it."""
    names = F.struct(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(columns)])
    return spark.range(1).select(F.to_csv(names).alias("line")).first()["line"] + "\n"


def _parts(fs, folder) -> list[tuple[str, int]]:
    """(path, bytes) of the written parts in partition order; empty parts left out."""
    found = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in fs.listStatus(folder)]
    # part-<partition>-<job>-c<file of the partition>: numbers may outgrow their padding
    place = lambda name: (int(name.split("-")[1]), int(name.rsplit("-c", 1)[1].split(".")[0]))
    return [(path, size) for name, path, size in sorted((f for f in found if f[0].startswith("part-") and f[2] > 0), key=lambda f: place(f[0]))]


def _copy(target: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = os.open(target, os.O_WRONLY)
        try:
            for part, at in zip(batch["part"], batch["at"], strict=True):
                with open(part, "rb") as f:
                    while piece := f.read(CHUNK):
                        while piece:  # a positional write may take less than it is given
                            done = os.pwrite(out, piece, at)
                            piece, at = piece[done:], at + done
            os.fsync(out)
        finally:
            os.close(out)
        yield batch[["at"]]


def write_ordered_csv(df: DataFrame, path: str, order: Sequence[Column | str], max_records_per_file: int = 5_000_000) -> None:
    """Write ``df`` sorted by ``order`` as the one CSV file ``path`` with a header; an existing file is replaced."""
    spark = df.sparkSession
    fs, target = _file_system(spark, path)
    way = _way(fs, target)
    if way is None:
        raise ValueError(f"{path}: this file system can't join parts; write ordered part files instead")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    # names that start with "_" are skipped by readers of the folder
    work = hadoop_path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    rows, whole = hadoop_path(work, "rows"), hadoop_path(work, "whole")
    try:
        df.orderBy(*order).write.option("header", False).option("maxRecordsPerFile", max_records_per_file).csv(rows.toString())
        parts = _parts(fs, rows)
        head = header_line(spark, df.columns).encode()
        stream = fs.create(whole)
        stream.write(head)
        stream.close()
        if way == "concat":
            if parts:
                gateway = spark.sparkContext._gateway
                sources = gateway.new_array(hadoop_path, len(parts))
                for k, (part, _) in enumerate(parts):
                    sources[k] = hadoop_path(part)
                fs.concat(whole, sources)
        elif parts:
            places, at = [], len(head)
            for part, size in parts:
                places.append((hadoop_path(part).toUri().getPath(), at))
                at += size
            local = whole.toUri().getPath()
            table = spark.createDataFrame(places, "part string, at long").repartition(min(len(places), spark.sparkContext.defaultParallelism), "at")
            copied = table.mapInPandas(lambda batches: _copy(local, batches), "at long").agg(F.count("*").alias("n")).first()["n"]
            if copied != len(places) or fs.getFileStatus(whole).getLen() != at:
                raise OSError(f"{path}: {copied} of {len(places)} parts were copied")
            # a checksum file beside the target would describe the header alone
            fs.delete(hadoop_path(work, ".whole.crc"), False)
        fs.delete(target, False)
        if not fs.rename(whole, target):
            raise OSError(f"{path}: the finished file couldn't be renamed")
    finally:
        fs.delete(work, True)
