"""Exact deduplication by distributed MSD radix partitioning.

Every document is the bytes of its text with each run of space or
U+0009..U+000D replaced by one space. All documents start in one group; a
round splits every open group by the next bytes of its documents. A group is
closed when it holds one document, or when its documents have ended within the
round's bytes: then they are equal, byte by byte, and no digest decides
anything. Open documents go on with the bytes not compared yet.

A round takes 64 bytes at first and eight times as many each time, so that a
text of b bytes is compared within log8(b/9) rounds, every byte once. Each
round is one aggregation (rows of a group and block, combined before the
shuffle) and one join with its result, in which groups with a large share of
the rows are found by broadcast and spread (``spread``). A round's documents
are written to the shared folder, so a lost executor costs its tasks only;
nothing is collected but row counts, and no task holds a group.

Defined results: null text counts as empty; empty texts are equal to each
other (and differ from a text of white space, which is one space); of equal
rows with the same id one stays; a null id counts as larger than every other,
so ``keep_id`` is null only where all ids of the group are; an empty table
gives an empty one; columns besides id and text are not read unless named in
``carry``, where they come back inside one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .spread import left_join_spread

#: Bytes of the first round, and the factor from round to round.
FIRST_BYTES, GROWTH = 64, 8


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null: empty."""
    # a single space needs no replacement, which spares nearly all matches
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _round(rows: DataFrame, n_rows: int, width: int, number: int) -> tuple[DataFrame, DataFrame]:
    """Splits the groups (``grp``) of ``rows`` by the first ``width`` bytes of ``rest``: (closed, open) documents.

    Closed ones carry their class ``grp`` (null: alone) and a tag that tells equal rows apart.
    """
    spark = rows.sparkSession
    block = F.substring("rest", 1, width)
    path = scratch(spark, f"radix-{number}-groups")
    (rows.groupBy("grp", block.alias("block")).agg(F.count("*").alias("n")).filter("n > 1")
     .withColumn("next", F.monotonically_increasing_id() + F.lit(number << 58)).write.parquet(path))
    groups = spark.read.schema("grp long, block binary, n long, next long").parquet(path)
    met = left_join_spread(rows.withColumn("block", block), groups, ["grp", "block"], n_rows)
    going = F.col("next").isNotNull() & (F.length("block") == width)
    split = met.select(F.col("next").alias("grp"), "id", "sha", "carried", F.when(going, F.substring(F.col("rest"), width + 1, 2**31 - 1)).alias("rest"),
                       F.monotonically_increasing_id().alias("tag"), going.cast("int").alias("going"))
    path = scratch(spark, f"radix-{number}")
    split.write.partitionBy("going").parquet(path)
    back = spark.read.schema(split.schema).parquet(path)
    return back.filter("going = 0").drop("rest", "going"), back.filter("going = 1").drop("tag", "going")


def exact_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: its class's smallest id, size, whether it stays, the normalised text's digest, carried columns."""
    text = normalised(F.col(text_column))
    rows = docs.select(F.lit(0).cast("long").alias("grp"), F.col(id_column).cast("long").alias("id"), F.sha2(text, 256).alias("sha"),
                       F.struct(F.lit(True).alias("present"), *carry).alias("carried"), text.cast("binary").alias("rest"))
    n_rows = n_open = docs.count()
    width, number, closed = FIRST_BYTES, 0, None
    while number == 0 or n_open:
        done, rows = _round(rows, n_open, width, number)
        closed = done if closed is None else closed.unionByName(done)
        n_open = rows.count()
        width, number = width * GROWTH, number + 1
    many = closed.filter("grp is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("without"), F.col("id"), F.col("tag")))
    kept = many.groupBy("grp").agg(F.count("*").alias("n"), first.alias("first"))
    alone = closed.filter("grp is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "carried")
    joined = left_join_spread(many, kept, ["grp"], n_rows).select(
        "id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("tag") == F.col("first.tag")).alias("kept"), "sha", "carried")
    result = alone.unionByName(joined).withColumnsRenamed({"id": id_column, "sha": "text_sha256"})
    return result if carry else result.drop("carried")
