"""The queries of this folder: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scans, secret_scans, sql
from .common import ship, table
from .exact_dedup import exact_classes
from .html_extraction import extract_pages
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .mixing import mix
from .nearest import nearest
from .packing import pack
from .quality_rules import quality
from .spelling import spelling_variants
from .token_output import token_binary
from .whitening import whiten


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#1 Mixing sources to target weights: all documents."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return (mixed.withColumn("position", F.round(F.get("positions", F.lit(0)), 6)).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
            .select("doc_id", "size", "source_size", "target", "taken", "position"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#2 N-gram Jaccard join: shingle counts, components and links of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#3 HTML extraction: the main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#4 Line dedup: the texts of all documents without globally repeated multi-line chunks."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed_lines", "text")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#5 Approximate nearest neighbours: every 50th vector against all, the 5 of largest cosine."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#6 Secret scans: spans in all documents, encoded layers included."""
    return secret_scans.digest(secret_scans.scan_secrets(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#7 Quality rules: measurements, failure bits and verdict of all documents."""
    return quality(table(spark, sf_dir, "documents"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#8 License scans: phrases, templates and scores of all documents."""
    return license_scans.digest(license_scans.scan_licenses(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#9 Best-fit packing: the pieces of all documents in sequences of 4096 ids."""
    return pack(table(spark, sf_dir, "documents")).drop("fill", "round")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#10 Token ids as ORC: written in ascending doc_id order and read back."""
    return token_binary(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#11 Spelling variant grouping: the words of all documents, their near words, forms and roots."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#12 Exact dedup: the class of every document by the bytes of its normalised text."""
    return exact_classes(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#13 Embedding whitening: all vectors on the components of their distinct vectors' covariance."""
    return whiten(table(spark, sf_dir, "embeddings"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f) for f in (op1_mixing, op2_jaccard_join, op3_html_extraction, op4_line_dedup, op5_nearest, op6_secret_scans,
                                      op7_quality_rules, op8_license_scans, op9_packing, op10_token_output,
                                      op11_spelling_variants, op12_exact_dedup, op13_whitening)
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": sql.MIXING, "op4_line_dedup": sql.LINE_DEDUP, "op7_quality_rules": sql.QUALITY, "op12_exact_dedup": sql.EXACT_DEDUP}
