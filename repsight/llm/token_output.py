"""#10 Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

``write_tokens`` range-partitions the documents by doc_id, tokenizes each
partition behind the exchange and writes one ORC file per partition in
ascending doc_id order; rows that share a doc_id, or have none, are divided by
their text's hash, so that no partition grows with them. ORC stores the id lists with its integer run-length
encoding; every stripe carries row indexes (minimum and maximum per
``row_index_stride`` rows) and a Bloom filter on doc_id, so ``read_tokens``
with a doc_id condition skips files' stripes and row groups, and a full read
splits at stripes.

Edge cases: a null text is an empty one (its only id is the end id); null
doc_ids come first; rows that repeat a doc_id stand side by side, in some fixed
order; further columns of the input are ignored, also
when they are called ``ids`` or ``start``; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .tokens import default_vocabulary, encode_all

#: Documents whose ids leave a task in one Arrow batch at most; a batch also ends at this many ids.
BATCH_IDS = 4_000_000


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, row order within partitions kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()

        def out(keys: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

        for batch in batches:
            keys, ids, n = [], [], 0
            for key, found in zip(batch.column(0).to_pylist(), encode_all(batch.column(1), path), strict=True):
                keys.append(key)
                ids.append(found)
                n += len(ids[-1])
                if n >= BATCH_IDS:
                    yield out(keys, ids)
                    keys, ids, n = [], [], 0
            if keys:
                yield out(keys, ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, row_index_stride: int = 10_000, stripe_bytes: int = 64 << 20) -> None:
    """Write the ids of all documents as ORC files in ascending doc_id order."""
    # the text's hash divides rows that share an id, or have none, over partitions
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(F.col("doc_id").asc(), F.col("h")).sortWithinPartitions("doc_id", "h")
    (encoded(ordered, vocabulary).write
     .option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.create.index", "true")
     .option("orc.row.index.stride", row_index_stride).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of written files; filters on doc_id reach the stripes' indexes and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, file, n_tokens, ids_crc32) of (doc_id, ids, file)."""
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files' numbers follow the range partitions. A running sum within each
    file (in parallel) plus the total of the files before it (one row per file)
    gives the start.
    """
    read = read_tokens(spark, path).withColumn("file", F.input_file_name())
    rows = written(read.mapInArrow(checksums, "doc_id long, file string, n_tokens long, ids_crc32 long"), "token-index")
    part, chunk = (F.regexp_extract("file", r"part-(\d+)-[^/]*?-c(\d+)", k).cast("long") for k in (1, 2))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy(part, chunk).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inner_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
            .join(files, "file")
            .select("doc_id", (F.col("file_start") + F.col("inner_start")).cast("long").alias("start"), "n_tokens", "ids_crc32"))


def token_binary(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` to ``path`` (default: the shared folder) and return the index read back from the files."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens-orc")
    write_tokens(docs, path, vocabulary)
    return token_index(spark, path)
