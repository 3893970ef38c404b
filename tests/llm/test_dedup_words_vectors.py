"""Exact dedup, spelling variants, whitening."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repsight.llm import exact_dedup, spelling, whitening
from repsight.llm.spread import left_join_spread
from llm.conftest import SF


# --- exact dedup -------------------------------------------------------------------------------------------------

def classes(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for body, ids in groups.items():
        sha = hashlib.sha256(body.encode()).hexdigest()
        ids.sort(key=lambda d: (d is None, d or 0))
        out += [(d, ids[0], len(ids), k == 0, sha) for k, d in enumerate(ids)]
    return out


def same(df, want):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_exact_classes_on_odd_rows(llm, edge, nothing):
    same(exact_dedup.exact_classes(edge), classes([(r.doc_id, r.text) for r in edge.collect()]))
    assert exact_dedup.exact_classes(nothing).collect() == []


def test_exact_classes_split_at_every_block_border(llm, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FIRST_BYTES", 4)
    monkeypatch.setattr(exact_dedup, "GROWTH", 2)
    rnd = random.Random(1)
    base = "".join(rnd.choice("ab é\n\t") for _ in range(300))
    texts = [base[:k] for k in range(0, 60)] + [base[:k] + "x" + base[k + 1 :] for k in range(60)] + [base] * 900 + [base + "y"] * 3 + [None, "", " ", "\n\n"]
    rows = [(rnd.randrange(50) if rnd.random() < 0.9 else None, t) for t in texts * 2]
    same(exact_dedup.exact_classes(llm.createDataFrame(rows, "doc_id long, text string").repartition(5)), classes(rows))


def test_exact_classes_carry_columns(llm, edge):
    got = exact_dedup.exact_classes(edge, carry=["kept", "n_chars"]).filter("kept").select("doc_id", "carried.kept", "carried.n_chars").collect()
    assert all(r.kept == "mine" for r in got) and len(got) == len({re.sub(r"\s+", " ", r.text or "") for r in edge.collect()})


def test_left_join_spread_equals_left_join(llm):
    rows = llm.range(5000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900)).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 2").withColumn("v", F.col("k") * 2)
    same(left_join_spread(rows, keys, ["k"], 5000).select("k", "id", "n", "v"), [tuple(r) for r in rows.join(keys, "k", "left").select("k", "id", "n", "v").collect()])


# --- spelling ----------------------------------------------------------------------------------------------------

def counted(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    k = 0
    while k < len(u) and u[k] == v[k]:
        k += 1
    return u[k + 1 :] == v[k + 1 :] if len(u) == len(v) else u[k:] == v[k + 1 :]


def near_words(words):
    """Near words by deletion keys: two near words share a word with a code point less, or one is it."""
    keys = defaultdict(set)
    for w in words:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            keys[x].add(w)
    near = defaultdict(set)
    for group in keys.values():
        for u in group:
            near[u] |= {v for v in group if one_edit(u, v)}
    return near


def variants(n):
    near, form = near_words(n), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_spelling_variants_of_documents(documents):
    want = variants(counted([(r.doc_id, r.text) for r in documents.collect()]))
    assert sum(r[1] is not None for r in want) > 50
    same(spelling.spelling_variants(documents), want)


def test_spelling_variants_of_odd_rows(llm, edge, nothing, monkeypatch):
    assert spelling.spelling_variants(nothing).collect() == []
    rnd = random.Random(5)
    long_ = "".join(rnd.choice("abc") for _ in range(20_000))
    rows = [(r.doc_id, r.text) for r in edge.collect()] * 3 + [(None, f"Ünïcödé ünïcode Äpfel äpfel × {long_} {long_[1:]} {long_}b")] * 3 + [(4, "×÷×÷× aaaaa aaaaaa aaaaaaa Aaaaa aaaaa")] * 3
    want = variants(counted(rows))
    monkeypatch.setattr(spelling, "SEGMENT_BYTES", 100)
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    same(spelling.spelling_variants(llm.createDataFrame(rows, "doc_id long, text string")), want)


@pytest.mark.parametrize("state_words", [1, 3, 4096])
def test_near_pairs_with_divided_states(llm, state_words):
    rnd = random.Random(9)
    alphabet = "abé"
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 2, 5, 6, 6, 7]))) for _ in range(250)} | {"prefix" + "".join(rnd.choice(alphabet) for _ in range(4)) for _ in range(60)}
    near = near_words(words)
    got = spelling.near_pairs(llm.createDataFrame([(w, 1) for w in words], "word string, n long"), max(state_words, 3)).collect()
    assert len(got) == len({(r.word, r.near) for r in got})
    assert {(r.word, r.near) for r in got} == {(u, v) for u in near for v in near[u]}


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted({"talked", "walked", "talker", "walker", "talkes"})
    a = spelling.Acceptor(words)
    for k, w in enumerate(words):
        state, place = a.start, 0
        for c in w:
            state, before = a.arcs[state][c]
            place += before
        assert place == k and not a.arcs[state]
    rests = {tuple(sorted(v[k:] for v in words if v[:k] == w[:k])) for w in words for k in range(7)}
    assert len(a.arcs) == len(rests)


# --- whitening ---------------------------------------------------------------------------------------------------

def plain_whitening(rows, by_count=False, most=16):
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for _, v in fine])
    fit, count = np.unique(x, axis=0, return_counts=True)
    w = count if by_count else np.ones(len(fit), int)
    n, s = int(w.sum()), [int(v) for v in w @ fit]
    mean = np.array(s) / n
    v = ((fit - mean) * w[:, None]).T @ (fit - mean) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return {"ids": [i for i, _ in fine], "n": n, "deviation": [sum((n * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x],
            "z": (x - mean) @ u / np.sqrt(e), "explained": e / np.trace(v)}


def check_whitening(df, rows, **options):
    want, got = plain_whitening(rows, **options), df.collect()
    k = want["z"].shape[1]
    assert len(got) == len(want["ids"]) * k
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    for c, part in by.items():
        order = sorted(range(len(want["ids"])), key=lambda j: (want["ids"][j], want["z"][j].tolist()))
        part.sort(key=lambda r: r.vec_id)
        assert [r.vec_id for r in part] == [want["ids"][j] for j in order]
        a, b = np.array([r.whitened for r in part]), np.array([want["z"][j, c - 1] for j in order])
        assert np.allclose(a, b, atol=1e-7) or np.allclose(a, -b, atol=1e-7)
        assert [r.deviation for r in part] == [want["deviation"][j] for j in order]
        assert {r.n for r in part} == {want["n"]} and np.allclose([r.explained for r in part], want["explained"][c - 1], rtol=1e-9)
        assert {round(r.identity_error, 6) for r in part} == {0.0}
    assert sorted(by) == list(range(1, k + 1))


def test_whitening_of_embeddings(llm):
    df = llm.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(whitening.whiten(df), [(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("weights", ["ones", "counts"])
def test_whitening_with_copies_and_bad_rows(llm, weights):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(2000 + i, rows[i][1]) for i in range(9)]
    bad = [(-1, None), (-2, []), (-3, [None] * 5), (-4, [float("nan")] + [1.0] * 4), (-5, [float("inf")] + [1.0] * 4), (-6, [1e30] + [1.0] * 4), (-7, [1.0, 2.0])]
    df = llm.createDataFrame([(i, v, 3.0) for i, v in rows + bad], "vec_id long, embedding array<double>, x double").repartition(6)
    check_whitening(whitening.whiten(df, weights=weights), rows, by_count=weights == "counts")


def test_whitening_of_nothing_and_of_flat_vectors(llm):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(None, None)]):
        assert whitening.whiten(llm.createDataFrame(rows, schema)).collect() == []
    line = [(i, [float(i), 1.0]) for i in range(10)]
    got = whitening.whiten(llm.createDataFrame(line, schema)).collect()
    assert {r.component for r in got} == {1} and {r.explained for r in got} == {1.0}


def test_deviation_beyond_63_bits_is_null():
    y = np.array([[1 << 40, 0], [0, 0]])
    assert whitening._deviations(y, 2, [1 << 40, 0]) == [None, None]
    assert whitening._deviations(np.array([[3, 1], [1, 1]]), 2, [4, 2]) == [4, 4]
