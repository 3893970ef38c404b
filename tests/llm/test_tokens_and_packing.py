"""Tokenizing, ORC output, packing, mixing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repsight.llm import mixing, packing, tokens
from repsight.llm.common import WORD, n_words, scratch
from repsight.llm.token_output import read_tokens, token_binary, write_tokens


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")


def test_encoding_equals_whole_text(plain, texts):
    rnd = random.Random(3)
    pools = ["abcdefgh ABC  \n\t'svetd.,!0123", "àÉîßŒſıİŉĸ×÷ÿŸ ab's", "\x0b\x0c\x1c\x1d\x1e\x1f\x85  　 aZ", "ΣσςΑ αß ﬁ K Å é é ǅ", "中文字 日本語 😀👍🏽 ‍", "<|endoftext|> <|startoftext|> </w> a", "\x00\x01\x7f ­ªºµ"]
    odd = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    path = tokens.default_vocabulary()
    for text in [*list(texts.values())[:300], *odd, "", None]:
        assert tokens.encode(text, path).tolist() == plain(text).tolist(), text
    column = [*odd, None, "", *list(texts.values())[:300], "a <|endoftext|> b<|startoftext|>", " ", "\n\n"]
    for got, text in zip(tokens.encode_all(pa.array(column).slice(5), path), column[5:], strict=True):
        assert got.tolist() == plain(text).tolist(), text


def test_long_texts_in_segments(plain, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_CHARS", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 200)
    monkeypatch.setattr(tokens, "PIECE_ENTRIES", 30)
    text = " ".join(f"Word{i}, other {i % 7}'s" for i in range(500)) + "y" * 500
    assert tokens.encode(text, tokens.default_vocabulary()).tolist() == plain(text).tolist()
    column = [text, "one", None, text[:150], text[:90], "", text[7:]]
    assert [i.tolist() for i in tokens.encode_all(pa.array(column), tokens.default_vocabulary())] == [plain(t).tolist() for t in column]


def test_added_tokens_as_the_library_gives_them():
    path = tokens.default_vocabulary()
    loaded = Tokenizer.from_file(path)
    rnd = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "a", "Word's", " ", "\n", "é", "中", "\u0338"]
    mixed = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(500)]
    for text in ["a <|endoftext|> b", "x<|startoftext|>y", *mixed]:
        assert tokens.encode(text, path).tolist() == [*loaded.encode(text, add_special_tokens=False).ids, tokens.END_ID], text
    assert tokens.encode("a <|endoftext|> b", path).tolist() == [320, 49407, 321, tokens.END_ID]


def wanted(rows, plain):
    ids = [(r.doc_id, plain(r.text)) for r in rows]
    return sorted(((d is not None, d or 0, len(i), zlib.crc32(i.tobytes())) for d, i in ids))


def test_token_output_round_trip(documents, edge, nothing, plain):
    for docs in (documents, edge):
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32, r.start) for r in token_binary(docs).collect())
        want = wanted(docs.collect(), plain)
        assert [g[:4] for g in got] == want
        assert [g[4] for g in got] == np.cumsum([0, *(w[2] for w in want)])[:-1].tolist()
    assert token_binary(nothing).collect() == []


def test_orc_files(llm, documents):
    path = scratch(llm, "orc")
    write_tokens(documents, path)
    one = read_tokens(llm, path).filter("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def scanned(df):
    """Rows that the scan of a collected frame handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_orc_indexes_and_bloom_filters_prune(llm):
    path = scratch(llm, "orc")
    docs = llm.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.format_string("word %d", "id").alias("text"))
    write_tokens(docs, path, row_index_stride=1000)
    jvm, conf = llm._jvm, llm._jsc.hadoopConfiguration()
    files = [f.getPath() for f in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().endswith(".orc")]
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        kinds = {str(s.getKind()) for s in reader.rows().readStripeFooter(reader.getStripes()[0]).getStreamsList() if s.getColumn() == 1}
        assert "ROW_INDEX" in kinds and "BLOOM_FILTER_UTF8" in kinds
    ids = read_tokens(llm, path)
    assert scanned(ids) == 20_000
    assert scanned(ids.filter("doc_id = 7000")) <= 1000  # one row group, by its least and largest id
    assert scanned(ids.filter("doc_id = 7001")) < 1000  # inside that range, but not in its Bloom filter


def test_rows_without_id_are_divided(llm):
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be joined again
    path = scratch(llm, "orc")
    docs = llm.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("word"), "id").alias("text"))
    got = sorted((r.start, r.n_tokens) for r in token_binary(docs, path).collect())
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(llm.read.orc(path).select(F.input_file_name()).distinct().collect()) > 1
    assert [g[0] for g in got] == np.cumsum([0, *(g[1] for g in got)])[:-1].tolist() and len(got) == 400


def check_packing(rows, docs, plain, capacity):
    ids = defaultdict(Counter)
    for r in docs:
        whole = plain(r.text)
        for k, at in enumerate(range(0, len(whole), capacity)):
            part = whole[at : at + capacity]
            ids[r.doc_id][(k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = defaultdict(Counter)
    for r in rows:
        got[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
    assert got == ids
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_packing(documents, edge, nothing, plain):
    n, total = check_packing(packing.pack(documents).collect(), documents.collect(), plain, 4096)
    assert n <= -(-total // 4096) + 1
    for capacity, rows in ((4096, 50_000), (64, 300)):
        check_packing(packing.pack(edge, capacity=capacity, partition_rows=rows).collect(), edge.collect(), plain, capacity)
    assert packing.pack(nothing).collect() == []


def test_packing_rounds_exchange_documents(documents, plain):
    n, total = check_packing(packing.pack(documents, capacity=512, partition_rows=60).collect(), documents.collect(), plain, 512)
    first = packing.pack(documents, capacity=512, partition_rows=60, max_rounds=0).select("sequence_id").distinct().count()
    assert -(-total // 512) <= n <= first


def test_packing_goes_on_while_rounds_save(documents):
    docs = documents.limit(400).cache()
    few = packing.certificate(packing.pack(docs, capacity=512, partition_rows=25, max_rounds=3), 512)
    rows = packing.pack(docs, capacity=512, partition_rows=25)
    n, least = packing.certificate(rows, 512)
    assert least <= n < 740 and n <= few[0] and least == few[1] == packing.lower_bound(np.array([r.length for r in rows.select("length").collect()]), 512)
    assert all(r.bound <= r.bins for r in rows.select("bins", "bound").distinct().collect())


def test_best_fit_and_bounds():
    rnd = random.Random(9)
    for _ in range(200):
        capacity = rnd.choice([7, 20, 100])
        sizes = np.array(sorted((rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 40))), reverse=True))
        bins = packing.best_fit_decreasing(sizes, capacity)
        free, want = [], []
        for s in sizes.tolist():
            fits = [f for f in free if f >= s]
            if fits:
                free[free.index(min(fits))] -= s
            else:
                free.append(capacity - s)
        assert bins.max() + 1 == len(free) and np.bincount(bins, sizes).max() <= capacity
        assert packing.lower_bound(sizes, capacity) <= len(free)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([4, 4, 4, 3, 3, 3]), 10) == 3


def test_mix_targets_and_order(documents, edge, nothing):
    rows = mixing.mix(documents).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and len(r.positions) == -(-r.taken // r.size) if r.size else r.taken == 0
        assert list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and abs(sum(target.values()) - sum(size.values())) < 1e-3
    got = mixing.mix(edge).collect()
    assert len(got) == edge.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(nothing).collect() == []


def test_mix_spreads_rows_that_share_an_id(llm):
    rows = [(None if k % 2 else 7, f"text number {k} of many", "one") for k in range(4000)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = docs.select(F.floor(mixing.order_hash(F.col("doc_id"), F.col("text")) / F.lit((1 << 32) // 1024)).alias("b")).groupBy("b").count().collect()
    assert len(hashes) > 900 and max(r["count"] for r in hashes) < 20
    got = mixing.mix(docs).collect()
    assert len(got) == 4000 and sum(r.taken for r in got) == sum(r.size for r in got) == got[0].target


def test_words_are_counted_without_an_array_of_them(llm):
    rnd = random.Random(5)
    odd = [None, "", " \t\n\x0b\f\r", "a", "\f a\n", "\x0b$1 \\", *("".join(rnd.choice(" \t\n\x0b\f\r\x00\x08\x0e\x1c\x1f\x85\xa0 aé𝒳$\\x") for _ in range(rnd.randrange(40))) for _ in range(500))]
    counted = llm.createDataFrame([(t,) for t in odd], "text string").select("text", n_words(F.col("text")).alias("n"))
    assert all(r.n == len(re.findall(WORD, r.text or "")) for r in counted.collect())
    docs = llm.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for frame in (counted, mixing.mix(docs)):
        assert "regexp_extract_all" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_mix_reads_the_texts_twice_only(documents):
    mixed = mixing.mix(documents)
    assert len(mixed.collect()) == documents.count()
    plan = mixed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 2 and "ReusedExchange" in plan


def test_training_order_follows_the_schedules(documents):
    mixed = mixing.mix(documents)
    order = [r.position for r in mixing.training_order(mixed).collect()]
    assert order == sorted(order)
    early = Counter()
    names = {s: i % 3 for i, s in enumerate(sorted({r.source for r in documents.select("source").distinct().collect()}))}
    for r in mixed.collect():
        for p in r.positions:
            early[(names[r.source], p < 0.5)] += 1
    assert early[(0, True)] > early[(0, False)] and early[(2, True)] < early[(2, False)]


def test_water_filling_matches_iteration(llm):
    sizes = {f"s{i:02}": n for i, n in enumerate([1, 1000, 5, 40, 3000, 700, 2, 0, 90])}
    frame = llm.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    total, weights = sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    capped: set = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(v for s, v in weights.items() if s not in capped)
        want = {s: 3 * sizes[s] if s in capped else weights[s] * rest / w for s in sizes}
        over = {s for s in sizes if s not in capped and want[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(want)
