"""The n-gram Jaccard join against brute force, and the pipeline stage by stage."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.test_text_operators import WORD
from repsight.llm import jaccard_join, quality_rules
from repsight.llm.common import written
from repsight.llm.components import components
from repsight.llm.shingles import shingle_set, word_hashes
from llm.conftest import SF


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """[(doc_id, n, component, links)] of [(doc_id, text)]."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            where[t].append(i)
    parent, links = list(range(len(rows))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for t in s for j in where[t] if j < i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows))


def found(docs):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(docs).collect())


def test_all_documents(documents, texts):
    assert found(documents) == brute(list(texts.items()))


def near_copies(n=260):
    """A chain of drifting copies, a star of copies with one or two edits, copies on both sides of the threshold, texts of shared lines."""
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(0, 10_000))
    base, rows = [word() for _ in range(150)], []
    drift = list(base)
    for _ in range(n):
        drift[rng.integers(0, 150)] = word()
        rows.append(" ".join(drift))
        star = list(base)
        for _ in range(rng.integers(0, 7)):
            star[rng.integers(0, 150)] = word()
        rows.append(" ".join(star))
    line = " ".join(word() for _ in range(12))
    rows += [line + " " + " ".join(word() for _ in range(k % 9)) for k in range(80)] + [rows[3]] * 5
    return [(1000 - i, t) for i, t in enumerate(rows)]


def test_groups_of_near_copies(llm, monkeypatch):
    rows = near_copies()
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert found(docs) == want
    monkeypatch.setattr(jaccard_join, "QUERIES_EACH", 3)  # tokens in more sets are answered for groups
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 3_000)  # several blocks a group, several parts of queries
    assert found(docs) == want


def test_salted_tokens(llm, monkeypatch):
    rows = near_copies(60)
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    summary = written(jaccard_join.summaries(docs, 0), "s")
    levels = jaccard_join.order_levels(summary.filter("entry is not null"))
    assert levels.max() >= 5
    monkeypatch.setattr(jaccard_join, "matrix_rows", _few_rows_a_part(jaccard_join.matrix_rows))
    assert found(docs) == brute(rows)


def _few_rows_a_part(real):
    """Raises the levels, so that every shared token is salted."""
    def run(docs, levels, salt):
        high = docs.sparkSession.sparkContext.broadcast(np.where(levels.value > 0, levels.value + 13, 0).astype(np.uint8))
        return real(docs, high, salt)

    return run


def test_edges(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(edge) == brute(rows)
    assert jaccard_join.jaccard_components(nothing).collect() == []
    kept = jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns and kept.count() == len(rows) - 1
    assert jaccard_join.one_of_each(nothing).collect() == []


def test_shingle_sets_count_distinct_shingles(texts):
    odd = ["a  b\tc\n\x0bd\x0ce\rf", "A b C d E", "a b c d e", "x", "", None, "ÄÖ äö É", "\ud800 lone", "k " * 50_000]
    for t in [*odd, *list(texts.values())[:200]]:
        assert len(shingle_set(t)) == len(shingles(t))
    assert word_hashes("A b")[0] == word_hashes("zz a")[1] and shingle_set("A b C d E").tolist() == shingle_set("a b c d e").tolist()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)] + [(100, i) for i in range(101, 140)] + [(139, 49)]])
def test_components(llm, edges):
    rows = llm.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(rows).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in list(parent) if root(x) != x}


def test_pipeline_stage_by_stage(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        n_before = docs.count()
        after = written(stage(llm, docs, SF), f"test-{name}")
        rows = after.collect()
        if name != "packing":
            assert after.columns == columns
        if name == "quality_rules":
            verdict = {r.doc_id for r in quality_rules.quality(docs).filter("kept").collect()}
            assert {r.doc_id for r in rows} == verdict and all(r == before[r.doc_id] for r in rows)
        elif name == "line_dedup":
            assert all(set(r.text.split("\n")) <= set(before[r.doc_id].text.split("\n")) and r.n_chars == len(r.text) for r in rows) and len(rows) <= n_before
            assert {x for r in before.values() for x in r.text.split("\n")} == {x for r in rows for x in r.text.split("\n")} | {x for r in before.values() if not WORD.search(r.text) for x in r.text.split("\n")}
        elif name == "jaccard_join":
            want = {d for d, _, c, _ in brute([(d, r.text) for d, r in before.items()]) if d == c}
            assert sorted(r.doc_id for r in rows) == sorted(want) and all(r == before[r.doc_id] for r in rows)
        elif name == "mixing":
            copies = Counter(r.doc_id for r in rows)
            assert max(copies.values()) <= 3 and all(r == before[r.doc_id] for r in rows)
            size = lambda t: len(WORD.findall(t))
            largest = max(size(r.text) for r in before.values())
            total = {s: sum(size(r.text) for r in rows if r.source == s) for s in {r.source for r in before.values()}}
            for r in corpus_pipeline.mix(docs).select("source", "target").distinct().collect():
                assert abs(total[r.source] - r.target) <= largest
        else:
            assert {r.doc_id for r in rows} == set(before) and sum(r.length for r in rows if r.piece == 0 and r.start == 0) > 0
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
        docs = after


def test_pipeline_runs_on_nothing(llm, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, SF)
        assert docs.collect() == []
        docs = docs if "text" in docs.columns else None
