"""#4 Line dedup by content-defined line chunks.

A rolling hash over the hashes of two consecutive lines opens a chunk where it
is divisible by ``divisor``; whether it does depends on these two lines only,
so inserting or deleting lines elsewhere leaves the other boundaries in place.
A chunk's head, its first two lines, anchors a match: where it occurs earlier
(smaller doc_id, then text hash, then line), the match is extended line by
line to both sides, through the chunk and beyond it, as long as each two
lines in a row occur earlier as well. The lines of a match go if at least
``min_lines`` of them hold a word; what occurs first stays. A run of repeated
lines with more than ``passage_words`` words needs no chunk to open in it, and
a line with more than that is a chunk by itself: it goes if it occurs earlier.
Lines are removed only after their bytes were compared with the first
occurrence's. Only DataFrame functions are used.

Pairs of lines are counted as hashes, with partial aggregation before the
shuffle; pairs that hang on much of the corpus are joined by broadcast and
spread (``spread``); texts are fetched for documents with repeated pairs only.

Edge cases: a null text stays null; an empty text has one empty line; a text
whose lines all go becomes empty; rows
with equal doc_id and text are one document and get the same result; null
doc_ids come first; blank lines go only inside a match; further columns pass
through, whatever their names except those added (``n_lines``,
``n_removed_lines``); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written
from .spread import left_join_spread

#: A pair of lines in one of so many opens a chunk.
DIVISOR = 2
#: A repeated line, or run of lines, with more words than this goes without a chunk's head.
PASSAGE_WORDS = 50


def line_hash(line: Column) -> Column:
    """32 bits of a line."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def line_pairs(lines: Column, divisor: int) -> Column:
    """array<struct<i, pair, opens, span>>: per two consecutive lines their 64-bit hash and whether they open a chunk."""
    def of(h: Column) -> Column:
        def pair(line: Column, i: Column) -> Column:
            opens = F.pmod(F.pmod(F.get(h, i) * F.lit(31) + F.get(h, i + 1), F.lit(1 << 32)), F.lit(divisor)) == 0
            return F.struct(i.alias("i"), F.xxhash64(line, F.get(lines, i + 1)).alias("pair"), opens.alias("opens"), F.lit(2).alias("span"))

        return F.transform(F.slice(lines, 1, F.size(lines) - 1), pair)

    return F.flatten(F.transform(F.array(F.transform(lines, line_hash)), of))


def long_lines(lines: Column, passage_words: int) -> Column:
    """The same of every line with more than ``passage_words`` words, as a chunk by itself."""
    def is_long(i: Column) -> Column:
        # n words and the space between them take 2n - 1 characters, so short lines needn't be split
        return F.when(F.length(F.get(lines, i)) > 2 * passage_words, n_words(F.get(lines, i)) > passage_words).otherwise(False)

    def alone(i: Column) -> Column:
        return F.struct(i.alias("i"), F.xxhash64(F.get(lines, i)).alias("pair"), F.lit(False).alias("opens"), F.lit(1).alias("span"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), is_long), alone)


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = 2, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with globally repeated runs of lines removed from ``text``, and n_lines, n_removed_lines (long)."""
    docs = docs.drop("n_lines", "n_removed_lines")
    keyed = docs.withColumn("__t", F.xxhash64("text"))
    lines = F.split("text", "\n")
    split = keyed.select("doc_id", "__t", lines.alias("lines")).filter("lines is not null")
    chunks = F.concat(line_pairs(F.col("lines"), divisor), long_lines(F.col("lines"), passage_words))
    places = (split.select("doc_id", "__t", F.explode(chunks).alias("p"))
              .select(F.col("p.pair").alias("pair"), F.struct("doc_id", "__t", F.col("p.i").alias("i")).alias("place"), F.col("p.opens").alias("opens"), F.col("p.span").alias("span")))
    places = written(places, "line-pairs")
    kept = places.groupBy("pair").agg(F.min("place").alias("kept"), F.max("place").alias("last"), F.count("*").alias("n")).filter("kept != last").drop("last")
    again = left_join_spread(places, written(kept, "line-pairs-kept"), ["pair"], places.count()).filter("kept is not null")
    again = again.select(F.col("place.doc_id").alias("__d"), F.col("place.__t").alias("__u"), F.struct(F.col("place.i").alias("i"), "opens", "span", (F.col("place") == F.col("kept")).alias("is_kept"), "pair", "n").alias("s"))
    per_doc = written(again.groupBy("__d", "__u").agg(F.collect_set("s").alias("found")), "line-repeats")

    def with_found(found: DataFrame, how: str) -> DataFrame:
        # always by shuffle: the list grows with the documents, and sizes that switch plans would hide its cost
        return keyed.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__u")), how)

    first, second = F.get("lines", F.col("s.i")), F.when(F.col("s.span") == 2, F.get("lines", F.col("s.i") + 1))
    texts = (with_found(per_doc, "inner").select("__d", "__u", lines.alias("lines"), F.explode("found").alias("s"))
             .select("__d", "__u", "s.*", F.concat_ws("\n", first, second).alias("bytes"), n_words(first).alias("words_1"), n_words(second).alias("words_2")))
    texts = written(texts, "line-texts")
    original = texts.filter("is_kept").groupBy("pair").agg(F.first("bytes").alias("o_bytes"), F.first("n").alias("n"))
    copies = texts.filter("not is_kept").drop("n", "is_kept")
    same = left_join_spread(copies, written(original, "line-originals"), ["pair"], copies.count()).filter(F.col("bytes") == F.col("o_bytes"))

    # runs of pairs in a row; rows with equal doc_id and text are one document
    once = same.groupBy("__d", "__u", "i").agg(*[F.max(c).alias(c) for c in ("opens", "words_1", "words_2")],
                                               (F.max("span") == 2).alias("is_pair"), (F.min("span") == 1).alias("is_long"))
    run = F.col("i") - F.row_number().over(Window.partitionBy("__d", "__u", "is_pair").orderBy("i"))
    runs = once.withColumn("run", run).groupBy("__d", "__u", "is_pair", "run").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.max("opens").alias("opens"),
        (F.sum((F.col("words_1") > 0).cast("int")) + F.max_by((F.col("words_2") > 0).cast("int"), "i")).alias("with_words"),
        (F.sum("words_1") + F.max_by("words_2", "i")).alias("words"), F.collect_list(F.when(F.col("is_long"), F.col("i"))).alias("long"))
    matched = F.col("is_pair") & (F.col("with_words") >= min_lines) & (F.col("opens") | (F.col("words") > passage_words))
    removed = F.when(matched, F.sequence(F.col("first"), F.col("last") + 1)).otherwise(F.col("long"))
    gone = runs.groupBy("__d", "__u").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(removed)))).alias("gone")).filter(F.size("gone") > 0)

    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g + 1))
    stops = F.concat(F.col("gone"), F.array(F.size(lines)))
    left = F.flatten(F.zip_with(begins, stops, lambda a, b: F.slice(F.split("text", "\n"), a + 1, b - a)))
    return (with_found(gone, "left")
            .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
            .withColumn("n_removed_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"))
            .withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
            .select(*docs.columns, "n_lines", "n_removed_lines"))
