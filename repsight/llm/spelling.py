"""Spelling variants by composition of finite-state machines.

Words are counted per task (combined before the shuffle). Two words are near
if one edit (insertion, deletion, replacement of a code point) turns one into
the other, that is, if the pair is accepted by

    vocabulary acceptor  o  one-edit transducer  o  vocabulary acceptor.

The transducer has two states: 0 (copying) and 1 (copying after the edit);
its arcs 0 -> 1 read a : b, nothing : b or a : nothing. The composition is
enumerated per initial state: an initial state is what the two acceptors reach
by a common beginning, so each task needs the words behind that beginning only.
For words of m and m or m + 1 code points there are two families:

* forward: equal first floor(m/2) code points, edit at that place or later;
* backward: equal last ceil(m/2) code points, words read from their end,
  edit before place floor(m/2).

The edit's place is the length of the longest common beginning, so every pair
belongs to exactly one family and state. A task builds the minimised acceptors
of a state's words (m code points, and m + 1) and walks the composition.

A state with more than ``STATE_WORDS`` words is divided on Spark before any
task sees it: by the next code point (arc copied by the transducer), and, for
an edit at this very place, into one small group per rest of the word (arc to
state 1, after which both acceptors must read the same rest). Such a group has
one word per code point of the alphabet. So no task holds a large group,
whatever part of the words begins alike.

Chains of forms are followed by pointer doubling, written each round.

Defined results: null text has no words; a null id is written as nothing
before the colon of the deletion rule; rows repeated in the table count again;
of near words with equal counts the smaller in code-point order is the form; an
empty table gives an empty one; other columns aren't read. Texts are read
whole; a word may be as long as the text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .spread import left_join_spread

MIN_LENGTH, MIN_COUNT, DELETE_EVERY, RATIO = 5, 3, 97, 2
#: Words of one initial state in one task; more are divided first.
STATE_WORDS = 4096
#: Words a task counts before it hands them on, and bytes of text searched at once.
HELD_WORDS, SEGMENT_BYTES = 300_000, 1 << 20
#: Runs of A-Z, a-z and U+00C0..U+00FF in lower-cased UTF-8 (lead byte C3, or none).
_RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
_CUT = re.compile(rb"[\x00-\x60\x7b-\x7f]")


def _runs(data: bytes) -> Counter:
    """The runs of a text, A-Z lower-cased, with their counts."""
    if len(data) <= SEGMENT_BYTES:
        return Counter(_RUN.findall(data.lower()))
    found, at = Counter(), 0
    while at < len(data):
        cut = _CUT.search(data, at + SEGMENT_BYTES)
        end = cut.end() if cut else len(data)
        found.update(_RUN.findall(data[at:end].lower()))
        at = end
    return found


def _length(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts, with the deletion rule applied; a task's counts, in parts."""
    def part() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_py()
            if not data:
                continue
            start = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
            for word, n in _runs(data).items():
                if len(word) < MIN_LENGTH:  # a deletion only shortens it
                    continue
                h = zlib.crc32(word, start)
                if h % DELETE_EVERY == 0:
                    chars = word.decode()
                    k = h % len(chars)
                    word = (chars[:k] + chars[k + 1 :]).encode()
                if _length(word) >= MIN_LENGTH:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield part()
                held.clear()
    if held:
        yield part()


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words found at least ``min_count`` times."""
    rows = docs.select(F.col(id_column).cast("string"), F.col(text_column).cast("binary"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Acceptor:
    """The minimised acceptor of sorted distinct words of one length.

    ``arcs[q]`` maps a symbol to (state, words accepted through smaller symbols);
    adding these along a path gives the place of its word among all.
    """

    def __init__(self, words: list[str], skip: int = 0):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self._count: list[int] = []
        self._known: dict[tuple, int] = {}
        open_: list[list[tuple[str, int]]] = [[]]  # finished arcs of the states on the last word's path
        last = ""
        for word in words:
            word = word[skip:]
            same = 0
            while same < len(last) and last[same] == word[same]:
                same += 1
            self._close(open_, last, same)
            open_.extend([] for _ in range(len(word) - same))
            last = word
        self._close(open_, last, 0)
        self.start = self._state(open_[0]) if words else -1

    def _close(self, open_: list, last: str, down_to: int) -> None:
        while len(open_) > down_to + 1:
            state = self._state(open_.pop())
            open_[-1].append((last[len(open_) - 1], state))

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        if key not in self._known:
            table, before = {}, 0
            for symbol, state in arcs:
                table[symbol] = (state, before)
                before += self._count[state]
            self._known[key] = len(self.arcs)
            self.arcs.append(table)
            self._count.append(before or 1)
        return self._known[key]


def _same_rest(a: Acceptor, p: int, i: int, b: Acceptor, q: int, j: int) -> Iterator[tuple[int, int]]:
    """Places of the words that both acceptors read alike from states p and q (state 1 of the transducer)."""
    todo = [(p, i, q, j)]
    while todo:
        p, i, q, j = todo.pop()
        left, right = a.arcs[p], b.arcs[q]
        if not left and not right:
            yield i, j
        elif left and right:
            if len(right) < len(left):
                todo.extend((left[s][0], i + left[s][1], t, j + k) for s, (t, k) in right.items() if s in left)
            else:
                todo.extend((t, i + k, right[s][0], j + right[s][1]) for s, (t, k) in left.items() if s in right)


def one_replaced(a: Acceptor) -> Iterator[tuple[int, int]]:
    """Places (smaller first) of words of one acceptor that differ by one replaced symbol."""
    todo = [(a.start, 0)]
    while todo:
        state, i = todo.pop()
        arcs = list(a.arcs[state].values())
        for k, (p, x) in enumerate(arcs):
            for q, y in arcs[k + 1 :]:
                yield from _same_rest(a, p, i + x, a, q, i + y)
            todo.append((p, i + x))


def one_inserted(a: Acceptor, b: Acceptor) -> Iterator[tuple[int, int]]:
    """Places in ``a`` and ``b`` of words such that one symbol inserted into the first gives the second.

    Of a run of equal symbols the last is taken as inserted, so a pair comes once.
    """
    todo = [(a.start, 0, b.start, 0)]
    while todo:
        p, i, q, j = todo.pop()
        left, right = a.arcs[p], b.arcs[q]
        for symbol, (r, k) in right.items():
            after = b.arcs[r]
            if not left and not after:
                yield i, j + k
            for s in left.keys() & after.keys():
                if s != symbol:
                    yield from _same_rest(a, left[s][0], i + left[s][1], b, after[s][0], j + k + after[s][1])
            if symbol in left:
                todo.append((left[symbol][0], i + left[symbol][1], r, j + k))


def _common(u: str, v: str) -> int:
    """Length of the longest common beginning."""
    low, high = 0, min(len(u), len(v))
    while low < high:  # halves: long words are compared in C
        mid = (low + high + 1) // 2
        if u[low:mid] == v[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def state_pairs(m: int, skip: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """One-edit pairs with the shorter word of m code points, among words with a common beginning of ``skip``."""
    words = sorted(set(words))
    short, long_ = [w for w in words if len(w) == m], [w for w in words if len(w) == m + 1]
    if not short or len(words) < 2:
        return
    a = Acceptor(short, skip)
    for i, j in one_replaced(a) if len(short) > 1 else ():
        yield short[i], short[j]
    if long_:
        for i, j in one_inserted(a, Acceptor(long_, skip)):
            yield short[i], long_[j]


_KEY = ["side", "m", "skip", "place", "start", "rest"]


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by state -> (u, v, n_u, n_v), both ways round."""
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        u, nu, v, nv = zip(*out)
        return pa.record_batch([pa.array(u, pa.string()), pa.array(nu, pa.int64()), pa.array(v, pa.string()), pa.array(nv, pa.int64())], ["word", "n", "near", "near_n"])

    def finish(key: tuple, group: dict[str, int]) -> None:
        side, m, skip, place, _, _ = key
        for u, v in state_pairs(m, skip, list(group)):
            x, y = (u[::-1], v[::-1]) if side else (u, v)
            if place >= 0 and _common(u, v) != place:  # a divided state's edit stands at this place
                continue
            if (_common(x, y) < m // 2) != bool(side):  # the other family's pair
                continue
            out.extend([(x, group[u], y, group[v]), (y, group[v], x, group[u])])

    key, group = None, {}
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:6] != key:
                if len(group) > 1:
                    finish(key, group)
                    if len(out) >= 20_000:
                        yield emit()
                        out.clear()
                key, group = row[:6], {}
            group[row[6]] = row[7]
    if len(group) > 1:
        finish(key, group)
    if out:
        yield emit()


def near_pairs(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """(word, n, near, near_n): every word of (word, n) with every near one."""
    size = F.length("word")
    # a word is the shorter of a pair (m = its length) or the longer (m = its length - 1)
    starts = words.withColumn("m", F.explode(F.array(size, size - 1))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    starts = starts.withColumn("read", F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word")))
    half = F.floor(F.col("m") / 2).cast("int")
    skip = F.when(F.col("side") == 1, F.col("m") - half).otherwise(half)
    columns = [*_KEY, "read", "uses"]
    now = starts.withColumn("skip", skip).withColumn("start", F.expr("substring(read, 1, skip)"))
    now = written(now.withColumns({"place": F.lit(-1), "rest": F.lit(""), "uses": F.col("n")}).select(columns), "spelling-states")
    ready = []
    on = ["side", "m", "skip", "start"]
    while True:
        large = written(now.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > state_words), "spelling-large")
        if large.isEmpty():
            return _near([now, *ready])
        met = written(left_join_spread(now, large, on, now.count()), "spelling-divided")
        ready.append(met.filter("n is null").select(columns))
        hot = met.filter("n is not null")
        # the edit stands at place ``skip``: the rest of both words is the same, less what was edited
        less = F.expr("concat(substring(read, 1, skip), substring(read, skip + 2))")
        short, long_ = F.length("read") == F.col("m"), F.length("read") > F.col("m")
        for which, rest in ((short & (F.length("read") > F.col("skip")), F.concat(F.lit("r"), less)), (short, F.concat(F.lit("i"), "read")), (long_, F.concat(F.lit("i"), less))):
            ready.append(hot.filter(which).withColumns({"place": F.col("skip"), "rest": rest}).select(columns))
        further = hot.filter(F.length("read") > F.col("skip")).withColumn("skip", F.col("skip") + 1)
        now = written(further.withColumn("start", F.expr("substring(read, 1, skip)")).select(columns), "spelling-states")


def _near(parts: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_enumerated, "word string, n long, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last word of their chain, by pointer doubling."""
    now = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = not now.filter("moved").isEmpty()
        now = now.drop("moved")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", state_words: int = STATE_WORDS) -> DataFrame:
    """One row per word: its form and root, counts of itself and its form, number of near words."""
    words = written(vocabulary(docs, id_column, text_column), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words, state_words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= RATIO * F.col("n")
    forms = written(words.join(near, "word", "left").select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                            F.when(fits, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
