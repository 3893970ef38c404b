"""#2 N-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets are one class. Classes are partitioned into
groups of similar ones: same smallest shingle hash (of the shingles that make
up most of the text, where most of it is shared with other texts), same size
range. The token-group matrix holds, for every group, the union of its
members' tokens:

* lookup: a pair with Jaccard similarity t = 3/4 or more shares l tokens among
  the first ``n - ceil(3n/4) + l`` tokens of the larger set and the first
  ``n - ceil(6n/7) + l`` of the smaller, under any order of all tokens. The
  matrix' rows for those tokens, spread over Spark by token, count the tokens
  that a set shares with a group (for tokens in many sets: all sets of its
  group at once); groups that share fewer than l with it are out
  (``least_shared``: l grows with the smaller set);
* bound: for each query of the asking group, the number of a set's tokens in the group's
  union bounds its overlap with every member; a group whose bound stays below
  what its smallest fitting member would need isn't opened;
* open: in the rest, overlaps with all members come from the group's token
  lists, and pairs are tested exactly: ``100 * intersection >= 75 * union``.

The order puts tokens that many documents share last. It is read from a table
of fixed size (``ORDER_BITS``) filled from all documents; it affects the number
of groups that are looked up, never the result. Tokens that are frequent all
the same are salted. Groups are split into blocks of bounded token count, and
queries of a block likewise. A block reports links as a spanning forest and
link counts, never all pairs; components are contracted in Spark.

Edge cases: null and empty texts have no shingles and link with nothing; null
doc_ids take part but never name a component unless all its ids are null;
repeated rows are members of one class; further columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .shingles import digests, mix, shingle_set

ORDER_BITS = 20
#: Tokens of a group's block and of the queries that meet it in one task.
BLOCK_TOKENS = 1_000_000
#: A token met by more classes than this has its lookups salted.
SALT_ABOVE = 1 << 14
_FLUSH = 2_000_000
#: A looked-up token in more classes than this is answered for groups of queries at once, in fewer for each query.
QUERIES_EACH = 64


def size_range(n: np.ndarray | int) -> np.ndarray:
    """The number of the size range: sets that can be similar are in the same or neighbouring ones."""
    return np.searchsorted(_RANGES, n, "right")


_RANGES = [1]
while _RANGES[-1] < 1 << 62 and len(_RANGES) < 254:
    _RANGES.append(_RANGES[-1] * 4 // 3 + 1)
_RANGES = np.array(_RANGES)


def least_shared(n: np.ndarray | int) -> np.ndarray | int:
    """l of the lookup for a smaller set of n tokens."""
    return 1 + n // 40


def group_of(tokens: np.ndarray, level: np.ndarray) -> int:
    """The group of a set: its smallest token and size range; of a text that is mostly shared, the smallest token of about the middle level or above.

    Copies of one text with edits of their own so stay together: their own
    tokens are rare, and don't compete for the smallest.
    """
    middle = int(np.partition(level, len(level) // 2)[len(level) // 2])
    first = tokens[level >= middle - 1][0] if middle > 1 else tokens[0]
    span = int(size_range(len(tokens)))
    return (int(mix(np.array([first], np.uint64))[0]) >> 9 << 8 | span) if span < 256 else span


def _batch(**columns: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def summaries(docs: DataFrame, salt: int) -> DataFrame:
    """One pass over all texts: a row per document, and rows that count shared tokens by order-table entry.

    Per _FLUSH tokens of different classes, tokens met twice or more are
    counted; a token in more classes than there are such flushes is met twice
    in one of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n_held = set(), [], 0

        def shared() -> pa.RecordBatch | None:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            tokens, times = tokens[times > 1], times[times > 1]
            if not len(tokens):
                return None
            entry, at = np.unique(tokens >> np.uint64(64 - ORDER_BITS), return_index=True)
            k = len(entry)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.add.reduceat(times, at), pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(entry.astype(np.int64))],
                ["doc_id", "row_hash", "n", "class", "check", "entry"])

        for batch in batches:
            rows: list[tuple] = []
            for key, row_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = shingle_set(text.as_py())
                a, b = digests(tokens, salt) if len(tokens) else (None, None)
                rows.append((key, row_hash, len(tokens), a, b, None))
                if a is not None and a not in seen:
                    seen.add(a)
                    held.append(tokens)
                    n_held += len(tokens)
                    if n_held >= _FLUSH:
                        if (out := shared()) is not None:
                            yield out
                        held, n_held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "row_hash", "n", "class", "check", "entry"])
        if held and (out := shared()) is not None:
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, row_hash long, n long, class long, check long, entry long")


def order_levels(shared: DataFrame) -> np.ndarray:
    """The order table: per entry, the binary logarithm of the shared tokens counted there; at most 2^ORDER_BITS rows are collected."""
    levels = np.zeros(1 << ORDER_BITS, np.uint8)
    for r in shared.groupBy("entry").agg(F.sum("n").alias("n")).toLocalIterator():
        levels[r["entry"]] = int(r["n"]).bit_length()
    return levels


def ordered_prefix(tokens: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The probing prefix in global order, its levels, and how many of it are in the indexing prefix."""
    n = len(tokens)
    shared = least_shared(n)
    probe, index = n - -(-3 * n // 4) + shared, n - -(-6 * n // 7) + shared
    order = np.argsort(level, kind="stable")[:probe]  # tokens ascend already
    return tokens[order], level[order], index


_MATRIX = {"token": np.int64, "part": np.int32, "class": np.int64, "grp": np.int64, "n": np.int32, "kind": np.int8}
#: Kinds of matrix rows: of the probing prefix only, of both prefixes, a further copy of an indexed row, a class' membership in its group.
PROBE, BOTH, COPY, MEMBER = range(4)
#: Kinds of lookup rows.
OWN, QUERY, GROUP = range(3)


def matrix_rows(docs: DataFrame, levels, salt: int) -> DataFrame:
    """The looked-up part of the matrix, its queries and memberships: (token, part, class, grp, n, kind)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = set(), levels.value
        cols, held = [[] for _ in _MATRIX], 0

        def out() -> pa.RecordBatch:
            return _batch(**{k: np.concatenate(c).astype(t) for (k, t), c in zip(_MATRIX.items(), cols, strict=True)})

        for batch in batches:
            for text in batch.column(0):
                tokens = shingle_set(text.as_py())
                if not len(tokens) or (a := digests(tokens, salt)[0]) in seen:
                    continue
                seen.add(a)
                level = table[tokens >> np.uint64(64 - ORDER_BITS)]
                prefix, own_level, index = ordered_prefix(tokens, level)
                prefix, grp = prefix.view(np.int64), group_of(tokens, level)
                parts = np.left_shift(1, np.maximum(0, own_level.astype(np.int64) - (SALT_ABOVE.bit_length() - 1)))
                own = a % parts
                # frequent tokens: a query looks into one part, an indexed row stands in all of them
                copied = np.flatnonzero((np.arange(len(prefix)) < index) & (parts > 1))
                more = parts[copied] - 1
                again = np.repeat(copied, more)
                nth = np.arange(len(again)) - np.repeat(np.cumsum(more) - more, more)
                kind = np.where(np.arange(len(prefix)) < index, BOTH, PROBE)
                k = len(prefix) + len(again) + 1
                for c, values in zip(cols, ((prefix, prefix[again], [a]), (own, (own[again] + 1 + nth) % parts[again], [0]), (np.full(k, a),), (np.full(k, grp),),
                                            (np.full(k, len(tokens)),), (kind, np.full(len(again), COPY), [MEMBER])), strict=True):
                    c.extend(np.asarray(v) for v in values)
                held += k
                if held > 500_000:
                    yield out()
                    cols, held = [[] for _ in _MATRIX], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "token long, part int, class long, grp long, n int, kind byte")


def _lookup(cls: np.ndarray, grp: np.ndarray, n: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (querying group, group) pairs of one token's rows: sizes allow a smaller indexed member to partner a larger querying one."""
    order = np.lexsort((cls, grp))
    cls, grp, n, kind = cls[order], grp[order], n[order].astype(np.int64), kind[order]
    first = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1])))
    several = np.logical_or.reduceat(np.concatenate(([False], (cls[1:] != cls[:-1]) & (grp[1:] == grp[:-1]))), first)
    if len(first) == 1 and not several[0]:
        return
    asks, holds = kind < COPY, (kind == BOTH) | (kind == COPY)
    least_q, most_q = np.minimum.reduceat(np.where(asks, n, 1 << 60), first), np.maximum.reduceat(np.where(asks, n, 0), first)
    least_i, most_i = np.minimum.reduceat(np.where(holds, n, 1 << 60), first), np.maximum.reduceat(np.where(holds, n, 0), first)
    groups, inner = grp[first], np.flatnonzero(most_i > 0)
    if not len(inner):
        return
    step = max(1, 4_000_000 // len(inner))
    for at in range(0, len(groups), step):
        q = np.arange(at, min(at + step, len(groups)))
        fits = (most_q[q, None] >= least_i[inner]) & (4 * most_i[inner] >= 3 * least_q[q, None]) & ((q[:, None] != inner) | several[inner])
        i, j = np.nonzero(fits)
        if len(i):
            yield groups[q[i]], groups[inner[j]]


def lookups(rows: DataFrame) -> DataFrame:
    """(id, grp, kind, shared): tokens that a query (kind QUERY) or a group of queries (kind GROUP) shares with a group; each class' own group (kind OWN)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, found, held = None, [], 0

        def pairs() -> pa.RecordBatch:
            both = np.concatenate(found, axis=1)
            both = both[:, np.lexsort(both)]
            first = np.flatnonzero(np.concatenate(([True], (both[:, 1:] != both[:, :-1]).any(axis=0))))
            return _batch(id=both[0][first], grp=both[1][first], kind=both[2][first].astype(np.int8), shared=np.diff(np.append(first, both.shape[1])))

        def add(ids: np.ndarray, groups: np.ndarray, kind: int) -> None:
            nonlocal held
            if len(ids):
                found.append(np.stack([ids, groups, np.full(len(ids), kind)]))
                held += len(ids)

        def tokens(cols: list[np.ndarray]) -> None:
            cls, grp, kind = cols[2], cols[3], cols[5]
            n = cols[4].astype(np.int64)
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(cols[0])]))
            size = ends - starts
            for k in range(2, 5):  # by far most: all runs of one length at once
                at = starts[(size == k) & (size <= QUERIES_EACH)]
                for a in range(k if len(at) else 0):
                    q, hits = at + a, []
                    for i in (at + b for b in range(k) if b != a):
                        fits = (kind[q] < COPY) & ((kind[i] == BOTH) | (kind[i] == COPY)) & (cls[q] != cls[i]) & (n[q] >= n[i]) & (4 * n[i] >= 3 * n[q])
                        hits.append(np.stack([cls[q[fits]], grp[i[fits]], cols[0][q[fits]]]))
                    one = np.concatenate(hits, axis=1)
                    # a token counts once for a query and group, however many members hold it
                    one = np.unique(one, axis=1) if k > 2 and one.shape[1] else one
                    add(one[0], one[1], QUERY)
            for k in np.flatnonzero((size > 4) & (size <= QUERIES_EACH)):
                c, g, m, t = (x[starts[k] : ends[k]] for x in (cls, grp, n, kind))
                fits = (t[:, None] < COPY) & ((t == BOTH) | (t == COPY)) & (c[:, None] != c) & (m[:, None] >= m) & (4 * m >= 3 * m[:, None])
                i, j = np.nonzero(fits)
                if len(i):
                    one = np.unique(np.stack([c[i], g[j]]), axis=1)
                    add(one[0], one[1], QUERY)
            for k in np.flatnonzero(size > QUERIES_EACH):
                for ids, groups in _lookup(*(c[starts[k] : ends[k]] for c in cols[2:])):
                    add(ids, groups, GROUP)

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _MATRIX]
            own = cols[5] == MEMBER
            if own.any():
                yield _batch(id=cols[2][own], grp=cols[3][own], kind=np.full(int(own.sum()), OWN, np.int8), shared=np.zeros(int(own.sum()), np.int64))
                cols = [c[~own] for c in cols]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                tokens([c[:cut] for c in cols])
            carry = [c[cut:] for c in cols]
            if held > 500_000:
                yield pairs()
                found, held = [], 0
        if carry is not None and len(carry[0]):
            tokens(carry)
        if found:
            yield pairs()

    spread = rows.repartition("token", "part").sortWithinPartitions("token", "part")
    return spread.mapInArrow(run, "id long, grp long, kind byte, shared long").groupBy("id", "grp", "kind").agg(F.sum("shared").alias("shared"))


def candidates(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, grp): own groups, (class, grp): groups that share enough tokens with the class to hold a partner).

    What a query shares is what it was counted for itself plus what its group
    was; the latter is at least what the query has of those tokens.
    """
    own = found.filter(F.col("kind") == OWN).select(F.col("id").alias("class"), F.col("grp").alias("own"))
    least = F.element_at(F.array(*[F.lit(int(x)) for x in least_shared(_RANGES)]), F.col("grp").bitwiseAND(F.lit(255)).cast("int"))
    by_group = found.filter(F.col("kind") == GROUP).select(F.col("id").alias("own"), "grp", F.col("shared").alias("more"))
    by_query = found.filter(F.col("kind") == QUERY).select(F.col("id").alias("class"), "grp", "shared")
    some = by_query.join(own, "class").join(by_group, ["own", "grp"], "left").filter(F.col("shared") + F.coalesce("more", F.lit(0)) >= least)
    whole = by_group.filter(F.col("more") >= least).join(own, "own")
    return own.withColumnRenamed("own", "grp"), some.select("class", "grp").unionByName(whole.select("class", "grp")).distinct()


def routes(classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(class, grp, block, part, is_query): where every needed set goes.

    A group has a block per BLOCK_TOKENS tokens; a block's queries are dealt to
    parts of as many, and its members stand in each part.
    """
    size = lambda: F.sum("n")
    hit = asked.select("grp").distinct()
    groups = classes.join(hit, "grp").groupBy("grp").agg(F.ceil(size() / BLOCK_TOKENS).cast("int").alias("blocks"))
    queries = (asked.join(groups, "grp").join(classes.select("class", "n"), "class")
               .select("class", "grp", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    parts = queries.groupBy("grp", "block").agg(F.ceil(size() / BLOCK_TOKENS).cast("int").alias("parts"))
    deal = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "class"), F.col(m)).cast("int")
    members = (classes.join(groups, "grp").select("class", "grp", deal(1, "blocks").alias("block")).join(parts, ["grp", "block"])
               .select("class", "grp", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_query")))
    queries = queries.join(parts, ["grp", "block"]).select("class", "grp", "block", deal(2, "parts").alias("part"), F.lit(True).alias("is_query"))
    return members.unionByName(queries)


def open_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a block's queries to its members: rows (u, v, links), v null for link counts."""
    members = rows[~rows["is_query"]].drop_duplicates("class").sort_values(["n", "class"], ignore_index=True)
    queries = rows[rows["is_query"]].drop_duplicates("class")
    empty = pd.DataFrame({"u": pd.array([], "Int64"), "v": pd.array([], "Int64"), "links": pd.array([], "Int64")})
    if members.empty or queries.empty:
        return empty
    sizes, ids, copies = members["n"].to_numpy(), members["class"].to_numpy(), members["copies"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in members["tokens"]]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    union, first, count = np.unique(flat[order], return_index=True, return_counts=True)
    owner, place = owner[order], {c: i for i, c in enumerate(ids.tolist())}
    label, counted = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    edges: list[tuple] = []
    links: list[tuple] = []
    for cls, n, own_copies, body in zip(queries["class"].tolist(), queries["n"].tolist(), queries["copies"].tolist(), queries["tokens"], strict=True):
        tokens, me = np.frombuffer(body, np.uint64), place.get(cls)
        low = np.searchsorted(sizes, -(-3 * n // 4), "left")
        high = np.searchsorted(sizes, n, "left")
        same = np.searchsorted(sizes, n, "right")
        high += int(np.searchsorted(ids[high:same], cls, "left"))
        if low >= high:
            continue
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        at = at[union[at] == tokens]
        bound = len(at) - (int((count[at] == 1).sum()) if me is not None else 0)
        if 7 * bound < 3 * (n + int(sizes[low])):
            continue
        k = count[at]
        spots = np.repeat(first[at] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        overlap = np.bincount(owner[spots], minlength=len(ids))[low:high]
        partners = low + np.flatnonzero(100 * overlap >= 75 * (n + sizes[low:high] - overlap))
        if not len(partners):
            continue
        links.append((cls, None, int(copies[partners].sum())))
        counted[partners] += own_copies
        roots = np.unique(label[partners])
        edges += [(cls, int(ids[r]), None) for r in roots if me is None or label[me] != r]
        joined = np.append(roots, label[me]) if me is not None else roots
        label[np.isin(label, joined)] = joined.min()
    links += [(int(ids[i]), None, int(counted[i])) for i in np.flatnonzero(counted)]
    return pd.DataFrame({name: pd.array([r[i] for r in edges + links], "Int64") for i, name in enumerate(("u", "v", "links"))})


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The shingle set of each needed class' document, once per route."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, copies, to = (batch.column(c).to_pylist() for c in ("class", "n", "copies", "to"))
            out: list[tuple] = []
            held = 0
            for i, text in enumerate(batch.column("text")):
                body = shingle_set(text.as_py()).tobytes()
                for t in to[i]:
                    out.append((cls[i], n[i], copies[i], t["grp"], t["block"], t["part"], t["is_query"], body))
                    held += len(body)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(_SET, r, strict=True)) for r in out], schema=_SET_SCHEMA)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_SET, r, strict=True)) for r in out], schema=_SET_SCHEMA)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    joined = keyed.join(needed, keyed["doc_id"].eqNullSafe(needed["rep_id"]) & (keyed["row_hash"] == needed["rep_hash"]))
    return joined.select("class", "n", "copies", "to", "text").mapInArrow(run, "class long, n long, copies long, grp long, block int, part int, is_query boolean, tokens binary")


_SET = ("class", "n", "copies", "grp", "block", "part", "is_query", "tokens")
_SET_SCHEMA = pa.schema(list(zip(_SET, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, root, n_shingles, component_id, n_links of every row of ``docs``.

    ``root`` is the component's own number (null without shingles); ``n_links`` counts the rows linked with a row, copies included, itself
    excluded; ``row_hash`` (of the text) tells rows that share a doc_id apart.
    """
    spark, salt = docs.sparkSession, 0
    while True:
        summary = written(summaries(docs, salt), "shingle-summaries")
        rows = summary.filter("entry is null").drop("entry")
        classes = rows.filter("class is not null").groupBy("class").agg(
            F.first("n").alias("n"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "row_hash")).alias("rep"),
            F.min("doc_id").alias("least_id"), (F.min("check") != F.max("check")).alias("clash"))
        classes = written(classes, "shingle-classes")
        if not classes.filter("clash").limit(1).count():  # two sets under one 64-bit class number: take other numbers
            break
        salt += 1
    levels = spark.sparkContext.broadcast(order_levels(summary.filter("entry is not null")))
    found_groups = written(lookups(matrix_rows(docs, levels, salt)), "group-lookups")
    own, asked = candidates(found_groups)
    to = routes(own.join(classes.select("class", "n"), "class"), written(asked, "group-queries")).groupBy("class").agg(F.collect_list(F.struct("grp", "block", "part", "is_query")).alias("to"))
    needed = classes.join(to, "class").select("class", "n", "copies", "to", F.col("rep.doc_id").alias("rep_id"), F.col("rep.row_hash").alias("rep_hash"))
    opened = _sets(docs, needed).groupBy("grp", "block", "part").applyInPandas(open_block, "u long, v long, links long")
    found = written(opened, "group-links")
    roots = components(found.filter("v is not null").select("u", "v"))
    counts = found.filter("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))
    rooted = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "copies", "least_id", F.coalesce("root", "class").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").join(counts, "class", "left")
    named = named.select("class", "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return (rows.join(named, "class", "left")
            .select("doc_id", "row_hash", "root", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, then row_hash; rows without words all stay.

    Rows that agree in doc_id and text are one document and stay once.
    """
    found = jaccard_components(docs)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    kept = found.filter("root is not null").groupBy("root").agg(F.min(row).alias("row")).select("row.doc_id", "row.row_hash")
    kept = kept.unionByName(found.filter("root is null").select("doc_id", "row_hash").distinct()).select(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__h"))
    keyed = docs.withColumn("__t", F.xxhash64("text"))
    return (keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")))
            .dropDuplicates(["__d", "__h"]).select(*docs.columns))
