"""#9 Best-fit packing with certified bounds.

Documents are tokenized, cut only where longer than a sequence, and the pieces
are dealt by hash to partitions of bounded size. Each partition packs its
pieces by best-fit decreasing and computes a lower bound of its number of
sequences from dual-feasible functions. A partition that meets its bound is
certified: no packing of its pieces needs fewer. While all sequences together
are more than the same bound of all pieces, the partitions release those that
aren't nearly full; the released pieces are dealt anew (so pieces of different
partitions meet) and packed again. A round counts only
if it needs fewer sequences; after one that doesn't, the pieces are dealt by
another seed. The rounds end when there is no such gap or when ``IDLE`` deals in
a row (one, if all released pieces fit one partition) save nothing. ``bins`` and ``bound`` of the
result are those of the partition that packed the piece last; ``certificate``
gives those of the whole result.

Edge cases: a null text is an empty one (one piece with the end id); repeated
rows are packed once per row, also with equal or null doc_ids; ties are broken
by doc_id, piece, start and checksum; further columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import default_vocabulary, encode_all

#: Deals in a row without a gain that end the rounds.
IDLE = 3
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, part long, bin long, offset long, fill long, bins long, bound long"

RESULT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "round", "bins", "bound")


def pieces(docs: DataFrame, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document: (doc_id, piece, start, length, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1), path), strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence number of each length; ``lengths`` must descend.

    Open sequences are kept by free space; an integer whose bit r is set when
    some sequence has exactly r free answers "least free space that fits".
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n, out = 0, 0, np.empty(len(lengths), np.int64)
    for i, x in enumerate(lengths.tolist()):
        fits = mask >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            r, b, n = capacity, n, n + 1
        out[i] = b
        if r > x:
            free[r - x].append(b)
            mask |= 1 << (r - x)
    return out


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 24) -> int:
    """Sequences that any packing needs: the best of two families of dual-feasible functions and the plain volume.

    First family, with threshold e <= capacity / 2: lengths above capacity - e
    count as a whole sequence, those below e as nothing, others as they are.
    Second family, for k = 1..steps: (k+1) * x / capacity is rounded down and
    divided by k, unless it is whole, when x counts as it is.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1], capacity, steps)


def bound_of(count: np.ndarray, capacity: int, steps: int = 24) -> int:
    """``lower_bound`` of ``count[x]`` pieces of each length x."""
    count = count.astype(object)
    volume = [int(c) * x for x, c in enumerate(count)]
    best = -(-sum(volume) // capacity)
    below, above = np.cumsum([0, *volume]), np.cumsum([0, *count])
    for e in range(1, capacity // 2 + 1):
        whole = int(above[capacity + 1] - above[capacity - e + 1])
        middle = int(below[capacity - e + 1] - below[e])
        best = max(best, -(-(whole * capacity + middle) // capacity))
    for k in range(1, steps + 1):
        total = 0  # in units of 1 / (k * capacity)
        for x, c in enumerate(count):
            if c:
                q, r = divmod((k + 1) * x, capacity)
                total += int(c) * (x * k if r == 0 else q * capacity)
        best = max(best, -(-total // (k * capacity)))
    return best


def packer(capacity: int):
    """The function that packs one partition."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        rows["bin"] = best_fit_decreasing(lengths, capacity)
        by = rows.groupby("bin", sort=False)["length"]
        rows["offset"] = by.cumsum() - lengths
        rows["fill"] = by.transform("sum")
        rows["bins"], rows["bound"] = rows["bin"].max() + 1, lower_bound(lengths, capacity)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "fill", "bins", "bound"]].astype({"doc_id": "Int64"})

    return run


def all_bound(rows: DataFrame, capacity: int) -> int:
    """The lower bound of all pieces together, from the number of pieces of each length."""
    count = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        count[r["length"]] = r["n"]
    return bound_of(count, capacity)


def certificate(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """(sequences of the whole result, sequences that any packing of its pieces needs)."""
    return packed.filter("offset = 0").count(), all_bound(packed, capacity)


def pack(docs: DataFrame, capacity: int = 4096, partition_rows: int = 50_000, release_below: float = 0.995, max_rounds: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """Pack all documents into sequences of ``capacity`` ids: one row per piece with its sequence and offset.

    ``partition_rows`` bounds what one task packs. The result also carries
    ``fill`` (ids in the sequence), ``round`` (0: never released), and ``bins``
    and ``bound`` of the piece's partition.
    """
    left = written(pieces(docs, capacity, vocabulary), "pieces")
    done, before, base, k, deal, idle, settled, least = None, None, 0, 0, 0, 0, 0, None
    while n := left.count() or done is None:
        parts = max(1, math.ceil(n / partition_rows))
        dealt = left.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64(F.lit(deal), "doc_id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("long").alias("part"))
        packed = written(dealt.groupBy("part").applyInPandas(packer(capacity), PACKED), "packed")
        bins, deal = packed.filter("offset = 0").count(), deal + 1
        if before is not None and bins >= before:
            idle += 1
            if parts == 1 or idle == IDLE:
                return done.unionByName(left).select(*RESULT)
            continue
        idle = 0
        numbered = packed.withColumn("sequence_id", (F.col("part") + F.lit(base)) * F.lit(1 << 32) + F.col("bin")).withColumn("round", F.lit(k))
        base += parts
        least = all_bound(packed, capacity) if least is None else least  # of all pieces: they are in the first deal
        loose = F.lit(settled + bins > least) & (F.col("fill") < F.lit(math.floor(release_below * capacity)))
        kept = numbered.filter(~loose)
        done = kept if done is None else done.unionByName(kept)
        left = numbered.filter(loose)
        before = left.filter("offset = 0").count()
        settled += bins - before
        if k == max_rounds or before < 2:
            done = done.unionByName(left)
            break
        k += 1
    return done.select(*RESULT)
