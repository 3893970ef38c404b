"""#7 Quality rules: a ledger of failure bits, versioned policies, ablations.

``ledger`` measures every text once and evaluates every rule once; the
outcome is one integer per document whose bit k is set when rule k fails. A
policy is a mask of rules with a version: ``apply_policy`` keeps a document
whose failure bits don't meet the mask, and ``ablations`` tells for each
policy and rule how many documents only that rule rejects, from the stored
bits alone. Only DataFrame functions are used.

Edge cases: a null or empty text has no words and fails ``few_words``; null
doc_ids and repeated rows are judged row by row; further columns pass through
unless they have the name of a measurement, which then holds the measurement;
an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; it sees the measurements only, in whole numbers."""

    name: str
    fails: Callable[[], Column]


c = F.col
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: c("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * c("n_repeat_words") > 50 * c("n_words")),
    Rule("many_symbols", lambda: 10 * c("n_symbols") > 2 * c("n_words")),
    Rule("repeated_lines", lambda: 100 * c("n_dup_lines") > 50 * c("n_lines")),
    Rule("capitals", lambda: 100 * c("n_capitals") > 30 * c("word_chars")),
    Rule("short_words", lambda: c("word_chars") < 2 * c("n_words")),
    Rule("long_words", lambda: c("word_chars") > 20 * c("n_words")),
)
BIT = {r.name: k for k, r in enumerate(RULES)}


def mask(*names: str) -> int:
    """The mask of the named rules."""
    return sum(1 << BIT[n] for n in names)


#: Versioned policies: a new version gets a new key, so stored ledgers can be judged by either.
POLICIES: dict[str, int] = {
    "base@1": mask("few_words", "repeated_windows"),
    "web@1": mask("few_words", "repeated_windows", "many_symbols", "repeated_lines", "capitals"),
    "web@2": mask(*BIT),
}
DEFAULT_POLICY = "web@2"


def _repeat_words(w: Column, n: int = 3) -> Column:
    """Words inside windows of ``n`` words that occur twice or more.

    Windows are compared by a 64-bit hash. Sorting (hash, place) brings equal
    windows together; their places in order then tell how many words they
    cover: each covers n, less where the next begins within it.
    """
    size = F.size(w)
    at = F.sequence(F.lit(0), size - n)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.aggregate(
            F.array(by_hash), F.lit(0).cast("long"),
            lambda _, s: F.aggregate(
                F.sort_array(F.transform(F.filter(s, lambda e, k: (e["x"] == F.coalesce(F.get(s, k - 1)["x"], F.bitwise_not(e["x"]))) | (e["x"] == F.coalesce(F.get(s, k + 1)["x"], F.bitwise_not(e["x"])))), lambda e: e["i"])),
                F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(n), i - a["last"])).cast("long").alias("n")),
                lambda a: a["n"]))

    return F.aggregate(F.array(F.when(size >= n, hashes)), F.lit(0).cast("long"),
                       lambda _, h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.drop(*[m for m in MEASURES if m in docs.columns and m != text])
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # each inline() is a barrier: what it yields is computed once, also when later filters are pushed down
    split = base.select("*", F.inline(F.array(F.struct(words(F.col(text)).alias("__words"), lines.alias("__lines")))))
    measures = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_words(F.col("__words")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count(body, F.lit(r"[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_capitals"))
    return split.select(*base.columns, F.inline(F.array(measures)))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``failed``, the failure bits of all rules."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """A ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0)


def ablations(rows: DataFrame, policies: dict[str, int] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule in it: documents failing the rule, those that only it rejects, and all the policy rejects.

    One pass of bitwise aggregates over the ledger; the result has a row per
    policy and rule.
    """
    cells = [(p, m, k, r.name) for p, m in policies.items() for k, r in enumerate(rules) if m >> k & 1]
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    failed = F.col("failed")
    counts = rows.agg(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"),
                 count(failed.bitwiseAND(F.lit(1 << k).cast("long")) != 0).alias("n_failed"),
                 count(failed.bitwiseAND(F.lit(m).cast("long")) == (1 << k)).alias("n_only_this"),
                 count(failed.bitwiseAND(F.lit(m).cast("long")) != 0).alias("n_rejected"))
        for p, m, k, name in cells]).alias("cells"))
    return counts.select(F.inline("cells"))


def quality(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The contract's rows: measurements, base_failed, kept, failed."""
    judged = apply_policy(ledger(docs.select("doc_id", "text")), policy)
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base@1"]).cast("long")) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed")
