"""#5 Approximate nearest neighbours by collision counting.

Vectors are scaled to unit length and projected on ``projections`` random
directions; per block of vectors each direction keeps one array of vectors
sorted by projection. A query opens a window around its own projection in
every array; a vector inside the window of a direction collides there. Windows
widen step by step (virtual rehashing). A vector that collides in
``threshold`` of the directions is verified: its cosine is computed in double
precision on the original vectors. Widening ends when the query's k-th best
verified distance is so small against the window that a closer vector would
collide in the required share of directions with ``sure`` probability per
direction, or when the windows span the block.

Queries meet all vectors block by block: every vector lies in one block of at
most about ``block_rows`` rows and is shuffled and indexed once; the queries
are sent to every block and stream past it batch by batch, so a task holds one
block and one batch. The blocks' k best are merged in Spark. Nothing caps
candidates.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; only vectors of equal
length are compared; rows with the query's own id are never its neighbours;
of query rows that share an id and a length the smallest vector asks; repeated
rows of another id count row by row; further columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEST = "query_id bigint, vec_id bigint, score double"
_SEED = 20_231
#: Rows whose cosines are computed at once, and the least rows that make a further block worth while.
SLICE, LEAST_ROWS = 4096, 1024


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index(NamedTuple):
    """One block of vectors: the vectors, their ids and lengths, and per direction the rows in order of projection."""

    base: np.ndarray
    ids: np.ndarray
    norms: np.ndarray
    lines: np.ndarray
    order: list[np.ndarray]
    values: np.ndarray


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def index(base: np.ndarray, ids: np.ndarray, projections: int) -> Index:
    """The sorted arrays of a block."""
    lines = np.random.default_rng(_SEED).standard_normal((base.shape[1], projections))
    at = _unit(base) @ lines
    order = np.argsort(at, axis=0, kind="stable")
    values = np.take_along_axis(at, order, axis=0)
    return Index(base, ids, _norms(base), lines, [np.ascontiguousarray(order[:, j]) for j in range(projections)], values)


def _cosine(block: Index, rows: np.ndarray, one: np.ndarray, norm: float) -> np.ndarray:
    # slice by slice: the products stay in the processor's cache
    parts = [(block.base[r] * one).sum(axis=1) / (block.norms[r] * norm) for r in np.array_split(rows, max(1, len(rows) // SLICE))]
    return np.concatenate(parts)


def search(block: Index, queries: np.ndarray, query_id: np.ndarray, k: int, share: float, sure: float, widen: float) -> tuple[list[tuple[int, int, float]], int]:
    """The k best verified (query, vector, cosine) of one block for each query, and how many vectors were verified in all."""
    projections = len(block.order)
    q_at, q_norms = _unit(queries) @ block.lines, _norms(queries)
    radii = [0.25]
    while radii[-1] < 2.0:
        radii.append(radii[-1] * widen)
    half = [r * sure for r in radii]
    least = math.ceil(share * projections)
    # per direction, the window ends of every query at every radius
    low, high = (np.stack([np.searchsorted(block.values[:, j], (q_at[:, j, None] + sign * np.array(half)).ravel(), side).reshape(len(queries), -1) for j in range(projections)], axis=2)
                 for sign, side in ((-1, "left"), (1, "right")))
    out: list[tuple[int, int, float]] = []
    n_verified = 0
    for q in range(len(queries)):
        verified = block.ids == query_id[q]
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for r, radius in enumerate(radii):
            inside = np.concatenate([c[a:b] for c, a, b in zip(block.order, low[q, r], high[q, r], strict=True)])
            if r + 1 < len(radii) and len(inside) < least:
                continue
            hit = (np.bincount(inside, minlength=len(block.ids)) >= least) & ~verified
            if r + 1 == len(radii):
                hit = ~verified if len(ids) < k else hit
            rows = np.flatnonzero(hit)
            if len(rows):
                verified |= hit
                n_verified += len(rows)
                ids, scores = np.concatenate((ids, block.ids[rows])), np.concatenate((scores, _cosine(block, rows, queries[q], q_norms[q])))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k and math.sqrt(max(0.0, 2.0 - 2.0 * scores[-1])) <= radius:
                break
        out += [(int(query_id[q]), int(i), float(s)) for i, s in zip(ids, scores, strict=True)]
    return out, n_verified


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 32768,
            projections: int = 24, share: float = 0.75, sure: float = 1.645, widen: float = 1.3) -> DataFrame:
    """Each query's k nearest: query_id, rank, vec_id, score. ``sure``: half width of a window in radii (1.645: a vector at that distance collides with 90 %).

    Tables of few blocks are dealt to about as many blocks as there are cores, so that all of them work.
    """
    v = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
         .filter(F.col("id").isNotNull()).filter(usable(F.col("v"))).withColumn("dim", F.size("v")))
    n, cores = v.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / block_rows), min(cores, math.ceil(n / LEAST_ROWS)))
    base = v.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b"), "dim", F.lit(False).alias("asks"), "id", "v")
    asked = (v.filter("is_query").groupBy("id", "dim").agg(F.min("v").alias("v"))
             .select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "dim", F.lit(True).alias("asks"), "id", "v"))

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, block = None, [], None
        for batch in batches:
            for (b, dim, asks), part in batch.groupby(["b", "dim", "asks"], sort=True):
                if (b, dim) != at:
                    at, rows, block = (b, dim), [], None
                if not asks:
                    rows.append((np.stack(part["v"].to_list()), part["id"].to_numpy()))
                    continue
                if block is None and rows:
                    block, rows = index(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), projections), []
                if block is not None:
                    found, _ = search(block, np.stack(part["v"].to_list()), part["id"].to_numpy(), k, share, sure, widen)
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    # by range of the block's number: hashing would give some tasks several blocks and others none
    laid = base.unionByName(asked).repartitionByRange(blocks, "b").sortWithinPartitions("b", "dim", "asks")
    best = laid.mapInPandas(pass_by, BEST)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
