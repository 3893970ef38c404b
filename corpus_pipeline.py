"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``.

1. quality rules: documents that the default policy rejects go;
2. line dedup: repeated multi-line chunks go; a document left without words goes;
3. n-gram Jaccard join: one document of each group of near copies stays;
4. mixing: documents appear as often as their source's target asks (0 to 3
   times, whole texts), range-sorted by training time;
5. packing: the pieces of all documents in sequences of 4096 ids.

Edge cases are those of the operators; a stage that gets an empty table
returns an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repsight.llm.common import WORD, ship, table, written
from repsight.llm.jaccard_join import one_of_each
from repsight.llm.line_dedup import dedup_lines
from repsight.llm.mixing import mix
from repsight.llm.packing import pack
from repsight.llm.quality_rules import apply_policy, ledger

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass every rule of the default policy."""
    return apply_policy(ledger(docs)).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated line chunks; n_chars follows the text."""
    left = dedup_lines(docs).filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    ship(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the sources' targets ask, in training order.

    The one document per source that the target cuts counts as whole if at
    least half of it is taken.
    """
    mixed = mix(docs, key=F.xxhash64("text"))
    copies = (mixed.filter("taken > 0").groupBy(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"))
              .agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies"), F.min("positions").alias("positions"))
              .select("__d", "__k", F.slice("positions", F.lit(1), F.col("copies")).alias("positions")))
    keyed = docs.withColumn("__t", F.xxhash64("text"))
    due = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__k")))
    due = due.select(*docs.columns, F.explode("positions").alias("__p"))
    return due.repartitionByRange("__p", "doc_id").sortWithinPartitions("__p", "doc_id").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the pieces of all documents into sequences; ``bins`` and ``bound`` are the certificate of the piece's partition."""
    ship(spark)
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenizing and best-fit packing can't be stated in SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
