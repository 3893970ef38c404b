"""Embedding whitening from a weighted covariance over distinct vectors.

A vector's entries c, as doubles, become integers x = floor(64 * c) + 1000000.
Identical x vectors are one *distinct vector*; it weighs one, or as many rows
as it stands for (``weights="counts"``). Steps, all but the d x d algebra on
Spark:

1. group the rows by x (combined before the shuffle): distinct vectors, counts;
2. total weight n and integer sums S, then the covariance: each Arrow batch is
   centred by S / n and multiplied with itself (one GEMM), a task adds its
   batches, eight tasks add the tasks' matrices, the driver adds those eight;
   it never holds more than 8 d x d matrices;
3. eigenvectors of that matrix on the driver (d x d, whatever the rows);
4. every distinct vector is projected once and written; the covariance of what
   was written gives ``identity_error``;
5. rows get their vector's result by a join on x, in which often repeated
   vectors are broadcast and spread (``spread``).

Defined results: vectors that are null, empty, or hold a null or non-finite
entry take no part; neither do vectors whose length isn't the most frequent
one (ties: the shorter), nor entries beyond +-2^46, whose x no longer follows
the double. Null or repeated ids pass through, one result a row. Components
whose variance is under 1e-12 of the trace can't be whitened and are left out
(all of them with one distinct vector, so an empty table, or one vector, gives
no rows). ``deviation`` is exact; it is null where it exceeds 63 bits.
Components carry a sign of their own: the entry of largest size is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .spread import left_join_spread

#: x is floor(64 * c) + 1000000; the shift cancels in all that is returned, so the code holds y = floor(64 * c).
SCALE = 64
COMPONENTS = 16
#: Tasks that add the tasks' matrices; each hands the driver one.
ADDERS = 8
_LIMIT = float(1 << 46)
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row of floor(64 * c) as a width mark and integers of the narrowest width that holds it."""
    low, high = x.min(axis=1), x.max(axis=1)
    need = np.zeros(len(x), int)
    for k, t in enumerate(_WIDTHS[:-1]):
        need[(low < np.iinfo(t).min) | (high > np.iinfo(t).max)] = k + 1
    out: list[bytes] = [b""] * len(x)
    for k, t in enumerate(_WIDTHS):
        for r in np.flatnonzero(need == k):
            out[r] = bytes([k]) + x[r].astype(t).tobytes()
    return out


def _unpack(keys: list[bytes]) -> np.ndarray:
    """The y vectors of ``_pack``'s rows."""
    return np.array([np.frombuffer(b, _WIDTHS[b[0]], offset=1) for b in keys], np.int64)


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, ids = batch.column(1), batch.column(0)
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        for d in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == d)
            part = lists.take(pa.array(rows))
            flat = part.flatten().cast(pa.float64())
            c = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), d)
            fine = (np.abs(np.where(np.isfinite(c), c, _LIMIT)) <= _LIMIT / SCALE).all(axis=1)
            if fine.any():
                keys = _pack(np.floor(c[fine] * SCALE).astype(np.int64))
                yield pa.record_batch([ids.take(pa.array(rows[fine])), pa.array([int(d)] * len(keys), pa.int32()), pa.array(keys, pa.binary())], ["vec_id", "dim", "x"])


def _added(parts: DataFrame) -> np.ndarray | None:
    """The sum of one array of doubles a row, held as bytes."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column(0):
                v = np.frombuffer(b.as_buffer(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    rows = parts.repartition(ADDERS).mapInArrow(add, "part binary").collect()
    return sum(np.frombuffer(r.part, np.float64) for r in rows) if rows else None


def _covariance(distinct: DataFrame, values, mean: np.ndarray, n: int) -> np.ndarray:
    """The weighted covariance (divisor ``n``) of ``values(batch) -> (weights, matrix)`` about ``mean``."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                w, m = values(batch)
                centred = m - mean
                total += (centred * w[:, None]).T @ centred
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    return _added(distinct.mapInArrow(moments, "part binary")).reshape(len(mean), len(mean)) / n


def _sums(distinct: DataFrame, dim: int, by_count: bool) -> tuple[int, list[int]]:
    """Total weight and exact integer sums of the y vectors."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            if batch.num_rows:
                x, w = _unpack(batch.column(0).to_pylist()), np.asarray(batch.column(1)) if by_count else np.ones(batch.num_rows, np.int64)
                n += int(w.sum())
                # 2^46 * weights may pass 63 bits: high and low halves are added apart
                high, low = x >> 24, x & 0xFFFFFF
                total = [t + (int(h) << 24) + int(s) for t, h, s in zip(total, w @ high, w @ low)]
        yield pa.record_batch([pa.array([-1, *range(dim)], pa.int32()), pa.array([str(v) for v in [n, *total]])], ["i", "v"])

    sums = distinct.mapInArrow(add, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r.i: int(r.v) for r in sums}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def _components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, and unit eigenvectors (columns) that can be whitened, and the trace."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u, trace = e[::-1], u[:, ::-1], float(np.trace(v))
    fit = min(most, int((e > 1e-12 * max(trace, 0.0)).sum())) if trace > 0 else 0
    u = u[:, :fit]
    return e[:fit], u * np.where(u[np.abs(u).argmax(axis=0), np.arange(fit)] < 0, -1.0, 1.0) if fit else u, trace


def _deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Per row the sum over dimensions of (n * x - S)^2, the same for y; null beyond 63 bits."""
    reach = n * int(np.abs(x).max()) + max(abs(v) for v in s)
    if reach < 1 << 62:
        d = n * x - np.array(s, np.int64)
        if len(s) * float(np.abs(d).max()) ** 2 < 2.0**62:
            return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
           weights: str = "ones") -> DataFrame:
    """One row per remaining vector and component; ``weights`` is ``ones`` or ``counts``."""
    if weights not in ("ones", "counts"):
        raise ValueError(f"weights must be ones or counts, not {weights!r}")
    spark, by_count = vectors.sparkSession, weights == "counts"
    pairs = vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>"))
    rows = written(pairs.mapInArrow(_quantise, "vec_id long, dim int, x binary"), "whitening-rows")
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    dim, n_rows = sizes["dim"], sizes["count"]
    rows = rows.filter(F.col("dim") == dim).drop("dim")
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("n")), "whitening-distinct")

    total, sums = _sums(distinct, dim, by_count)
    mean = np.array([s / total for s in sums])

    def weigh(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column(1)).astype(float) if by_count else np.ones(batch.num_rows)

    v = _covariance(distinct, lambda b: (weigh(b), _unpack(b.column(0).to_pylist()).astype(float)), mean, total)
    e, u, trace = _components(v, components)
    if not len(e):
        return spark.createDataFrame([], RESULT)
    project = u / np.sqrt(e)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column(0).to_pylist())
                z = (x - mean) @ project
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(_deviations(x, total, sums), pa.int64()), pa.array(list(z))],
                                      ["x", "n", "deviation", "z"])

    results = written(distinct.mapInArrow(whitened, "x binary, n long, deviation long, z array<double>"), "whitening-results")

    def z(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return weigh(batch), np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)

    middle = _weighted_mean(results, z, len(e), total)
    error = float(np.abs(_covariance(results, z, middle, total) - np.eye(len(e))).max())
    explained = F.array(*[F.lit(float(k) / trace) for k in e])
    joined = left_join_spread(rows, results, ["x"], n_rows)
    return joined.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(total).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def _weighted_mean(results: DataFrame, values, width: int, n: int) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                w, m = values(batch)
                total += w @ m
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    return _added(results.mapInArrow(add, "part binary")) / n
