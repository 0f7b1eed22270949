"""Embedding whitening from polarisation covariances.

Entries become integers, so that every sum is exact. The fit list holds each different vector
once. With its size n and its sums S, the centred values are the integers n*x - S; tasks add up
their squares for every dimension, and the squares of the sums for every pair of dimensions.
By polarisation the difference of such variances, Q(i+j) - Q(i) - Q(j), is twice the exact
cross-covariance of i and j. The matrix is rounded once, entry by entry, and ``eigh`` gives the
components that all rows are projected on.

Squares are added in 64 bits where a block's bound shows that they fit, in two halves where
they don't, and as Python integers beyond; partial sums travel as eight limbs of 32 bits, so
no count of rows makes them overflow. The driver sees the sums of dimensions and pairs, never a
vector; the vectors are distinct by a hash aggregation that combines copies in every map task.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped;
entries beyond the range of a long stop at its ends; the vectors of the most frequent length in
the fit list (of ties the longest) are whitened, rows of another length come out once, with null
in all but vec_id; so do rows without any entry. Components without variance have null in
whitened (and in explained, if nothing varies), and identity_error is over the others. A
deviation beyond a long is null and stands in deviation_digits, which is null otherwise.
Repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import batch_limits, store

BLOCK = 1 << 10             # vectors whose squares are added at a time
LIMBS = 8                   # of 32 bits, the last with a sign
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
       "deviation_digits string")


def vectors_of(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x (array of long: floor(scale * entry)) for every row with a finite vector."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return (rows.filter(F.col("embedding").isNotNull() & finite)
            .select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x")))


def matrices(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as rows of a matrix; all have ``dims`` entries."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, in 64 bits where it fits and as Python integers otherwise."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * largest + max(map(abs, sums), default=0) < 1 << 61:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def square_sums(t: np.ndarray) -> np.ndarray:
    """Exact sum of the squares in every row of at most ``BLOCK`` columns."""
    if t.dtype == object:
        return (t * t).sum(axis=1)
    bits = max(int(t.max(initial=0)), -int(t.min(initial=0))).bit_length()
    if 2 * bits <= 52:
        return np.einsum("ij,ij->i", t, t).astype(object)
    if bits > 52:
        return square_sums(t.astype(object))
    half = (bits + 1) // 2
    high, low = t >> half, t & ((1 << half) - 1)
    parts = [np.einsum("ij,ij->i", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low))]
    return parts[0] * (1 << 2 * half) + parts[1] * (1 << half + 1) + parts[2]


def limbs(values: list[int]) -> list[list[int]]:
    top = 32 * (LIMBS - 1)
    return [[(v >> 32 * k) & 0xFFFFFFFF for v in values] for k in range(LIMBS - 1)] + [[v >> top for v in values]]


def _added(partial: DataFrame, keys: list[str]) -> list[tuple[tuple, int]]:
    """Partial sums in limbs, added by key: as many rows as there are keys."""
    rows = partial.groupBy(*keys).agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    return [(tuple(r[k] for k in keys), sum(r[f"l{k}"] << 32 * k for k in range(LIMBS))) for r in rows]


LIMB_COLUMNS = ", ".join(f"l{k} long" for k in range(LIMBS))


def _limb_batch(keys: dict[str, list], values: list[int]) -> pa.RecordBatch:
    columns = {k: pa.array(v, pa.int32()) for k, v in keys.items()}
    return pa.RecordBatch.from_pydict(columns | {f"l{k}": pa.array(v, pa.int64()) for k, v in enumerate(limbs(values))})


def dimension_sums(fit: DataFrame, dims: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, dtype=object)
        for batch in batches:
            x = matrices(batch, dims)
            total = total + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield _limb_batch({"i": list(range(dims))}, [int(v) for v in total])

    found = dict(_added(fit.mapInArrow(run, f"i int, {LIMB_COLUMNS}"), ["i"]))
    return [found[i,] for i in range(dims)]


def polarised(fit: DataFrame, dims: int, n: int, sums: list[int]) -> list[list[int]]:
    """The exact matrix of sum over the fit list of (n*x_i - S_i) * (n*x_j - S_j), from the squares
    of every dimension and of every sum of two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(dims, dtype=object)
        pairs = [np.zeros(dims - i - 1, dtype=object) for i in range(dims)]
        for batch in batches:
            x = matrices(batch, dims)
            for lo in range(0, len(x), BLOCK):
                c = np.ascontiguousarray(centred(x[lo:lo + BLOCK], n, sums).T)
                own = own + square_sums(c)
                for i in range(dims - 1):
                    pairs[i] = pairs[i] + square_sums(c[i + 1:] + c[i])
        for i in range(dims):                               # one row of the matrix at a time
            yield _limb_batch({"i": [i] * (dims - i), "j": list(range(i, dims))}, [int(own[i]), *map(int, pairs[i])])

    q = dict(_added(fit.mapInArrow(run, f"i int, j int, {LIMB_COLUMNS}"), ["i", "j"]))
    return [[q[i, i] if i == j else (q[min(i, j), max(i, j)] - q[i, i] - q[j, j]) // 2 for j in range(dims)] for i in range(dims)]


def components_of(cross: list[list[int]], n: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as rows, trace) of the covariance, the largest first;
    eigenvalues that are zero but for rounding are 0."""
    v = np.array([[c / n ** 3 for c in row] for row in cross], dtype=np.float64)
    trace = sum(cross[i][i] for i in range(len(cross))) / n ** 3
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:count], u.T[::-1][:count]
    return np.where(e > len(cross) * np.finfo(np.float64).eps * trace, e, 0.0), u, trace


def project(c: np.ndarray, n: int, e: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Whitened values of centred rows; null (nan) for components without variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(e > 0, (c.astype(np.float64) @ u.T) / n / np.sqrt(e), np.nan)


def identity_error(fit: DataFrame, dims: int, n: int, sums: list[int], e: np.ndarray, u: np.ndarray) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    k = int((e > 0).sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = project(centred(matrices(batch, dims), n, sums), n, e[:k], u[:k])
            total += w.T @ w                                # projected from centred values
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.repeat(np.arange(k), k), pa.int32()),
                                          "b": pa.array(np.tile(np.arange(k), k), pa.int32()), "s": total.ravel()})

    rows = fit.mapInArrow(run, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / n - (r["a"] == r["b"])) for r in rows)


def deviations(c: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Exact sum of squares of every row, as a long, or as digits where it is beyond a long."""
    large = max(int(c.max(initial=0)), -int(c.min(initial=0)))
    if large * large * c.shape[1] < 1 << 62:
        c = c.astype(np.int64, copy=False)
        return pa.array(np.einsum("ij,ij->i", c, c)), pa.nulls(len(c), pa.string())
    exact = [sum(int(v) * int(v) for v in row) for row in c]
    return (pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
            pa.array([None if v < 1 << 63 else str(v) for v in exact], pa.string()))


def whiten(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error, deviation_digits."""
    batch_limits(rows.sparkSession)
    own = vectors_of(rows, scale)
    fit = store(own.select("x").distinct(), "fit-list")
    size = fit.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims, n = (size["dims"], size["n"]) if size else (0, 0)
    e, u, explained, error, sums = np.zeros(0), np.zeros((0, 0)), [], None, []
    if dims:
        fit = fit.filter(F.size("x") == dims)
        sums = dimension_sums(fit, dims)
        e, u, trace = components_of(polarised(fit, dims, n, sums), n, components)
        explained = [float(v / trace) if trace else None for v in e]
        error = identity_error(fit, dims, n, sums, e, u)
    k, names = len(e), [f.split()[0] for f in OUT.split(", ")]

    def whitened(part: pa.RecordBatch) -> pa.RecordBatch:
        m, c = part.num_rows, centred(matrices(part, dims), n, sums)
        each = pa.array(np.repeat(np.arange(m), k))
        short, digits = deviations(c)
        return pa.RecordBatch.from_arrays(
            [part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array([n] * (m * k), pa.int64()),
             short.take(each), pa.array(project(c, n, e, u).ravel(), pa.float64(), from_pandas=True),
             pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()), digits.take(each)], names=names)

    def bare(part: pa.RecordBatch) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.string())
        return pa.RecordBatch.from_arrays([part.column("vec_id"), *[pa.nulls(part.num_rows, t) for t in types]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = (batch.column("dims").to_numpy() == dims) & (k > 0)
            if fits.any():
                yield whitened(batch.filter(pa.array(fits)))
            if not fits.all():
                yield bare(batch.filter(pa.array(~fits)))

    return own.select("vec_id", "x", F.size("x").alias("dims")).mapInArrow(run, OUT)
