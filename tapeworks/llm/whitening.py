"""Whitening of embeddings: float32 eigenvectors of a distributed covariance, corrected in higher precision.

Entries become integers, ``floor(scale * c)``, so counts, sums and products are exact and the same in every run, however rows are dealt.
``fit`` takes each distinct vector once and needs three passes: sums, centred products, and the covariance of the whitened vectors as a check.

* Products: vectors are centred at the rounded mean, cut into limbs of ``LIMB`` bits so that every matrix product of a block is exact in
  double precision, and added up as integers.  The rest of the centring, less than one half a dimension, is corrected exactly.
* Eigenvectors: float32 ones of the scaled covariance are the start.  Iterations of matrix products in extended precision correct them
  (Ogita and Aishima 2018): from the defects ``R = I - X'X`` and ``S = X'AX`` follow the eigenvalues ``s_ii / (1 - r_ii)`` and the correction
  ``X E`` with ``e_ij = (s_ij + l_j r_ij) / (l_j - l_i)``, which converges quadratically.  Where eigenvalues lie closer than the defects tell apart, the
  correction only makes the vectors orthogonal (``r_ij / 2``) and the cluster is solved by itself (Ogita and Aishima 2019): the matrix of the cluster's
  vectors, less the cluster's mean eigenvalue, is diagonalised and its vectors are turned accordingly before the next iteration.
  What remains is the extended rounding over the relative gap of two eigenvalues: double precision from gaps of about 1e-3 on, 1e-10 at 1e-9.

Only the dims x dims matrix and one row a component come to the driver: 8 MB at 1,024 dimensions (``MAX_DIMS`` at most), whatever the number of vectors.

Rows are dropped whose vector is null or empty or holds null or non-finite entries, or has another length than most vectors of the table (ties: the longest).
Entries too large for a long take the nearest long; a deviation too large for a long is null.  Repeated rows and a null vec_id are results like any
other.  Components whose eigenvalue is zero within rounding can't be scaled to one and are left out, so equal vectors or an empty table give an
empty result.  Eigenvectors of equal eigenvalues are any orthogonal ones.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

SCALE = 256
COMPONENTS = 4
LIMB = 20
BLOCK = 1 << 13  # rows of a block: products of two limbs times the rows stay below 2^53
MAX_DIMS = 2048
ITERATIONS = 12
LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: ``(x - sums / n) @ vectors / sqrt(values)``."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # dims x components, unit columns
    values: np.ndarray  # eigenvalues, falling
    trace: float
    identity_error: float


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x (array of longs) of the rows that remain."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("c"))
    finite: Column = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = rows.filter(F.col("c").isNotNull() & (F.size("c") > 0) & F.coalesce(finite, F.lit(False)))
    sizes = usable.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = sizes["d"] if sizes else 0
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions; the covariance is solved on the driver up to {MAX_DIMS}")
    return usable.filter(F.size("c") == dims).select("vec_id", F.transform("c", lambda c: F.floor(c * float(scale))).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            x = batch.column("x").slice(at, BLOCK)
            yield x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _limbs(z: np.ndarray) -> list[np.ndarray]:
    """z = sum of limbs[k] * 2^(LIMB k), limbs as doubles below 2^LIMB in size."""
    out = []
    while True:
        if -(2**LIMB) < z.min() and z.max() < 2**LIMB:
            return [*out, z.astype(np.float64)]
        out.append((z & (2**LIMB - 1)).astype(np.float64))
        z = z >> LIMB


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre, in longs where that fits, else in Python integers."""
    top = max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, centre))
    if top <= LONG_MAX:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([str(v) for v in values]).cast(pa.decimal128(38, 0))


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for x in _blocks(batches):
            small = max(abs(int(x.min())), abs(int(x.max()))) <= LONG_MAX // BLOCK
            n, total = n + len(x), total + x.sum(axis=0, dtype=np.int64 if small else object).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total)), _decimals(total.tolist())], names=["i", "n", "s"])

    parts = distinct.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = sorted(parts.collect(), key=lambda r: r["i"])
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _products(distinct: DataFrame, centre: list[int]) -> tuple[list[int], np.ndarray]:
    """Exact sums of z and of z z' (Python integers) over z = x - centre; each task sends its own sums, which are added by place."""
    dims = len(centre)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = np.zeros(dims, object), {}  # total: by the power of 2^LIMB, in longs with the number of block products they hold
        done: dict[int, np.ndarray] = {}

        def put_by(power: int) -> None:
            done[power] = done.get(power, 0) + total.pop(power)[0].astype(object)

        for x in _blocks(batches):
            z = _centred(x, centre)
            limbs = _limbs(z)
            for a, za in enumerate(limbs):
                first = first + (za.sum(axis=0).astype(np.int64).astype(object) << (LIMB * a))
                for b, zb in enumerate(limbs):
                    exact = (za.T @ zb).astype(np.int64)
                    sums, blocks = total.get(a + b, (0, 0))
                    total[a + b] = (sums + exact, blocks + 1)
                    if blocks + 1 == 512:  # a block's sums are below 2^53
                        put_by(a + b)
        for power in list(total):
            put_by(power)
        for power, sums in done.items():
            places = [pa.array(np.full(len(u), v), pa.int32()) if v is not None else pa.array(u, pa.int32()) for u, v in ((upper[0], power), (upper[0], None), (upper[1], None))]
            yield pa.RecordBatch.from_arrays([*places, _decimals(sums[upper].tolist())], names=["k", "i", "j", "v"])
        if done:
            place = pa.array(range(dims), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([-1] * dims, pa.int32()), place, place, _decimals(first.tolist())], names=["k", "i", "j", "v"])

    parts = distinct.select("x").mapInArrow(run, "k int, i int, j int, v decimal(38,0)").groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    first, second = [0] * dims, np.zeros((dims, dims), object)
    for r in parts.collect():
        if r["k"] < 0:
            first[r["i"]] = int(r["v"])
        else:
            second[r["i"], r["j"]] += int(r["v"]) << (LIMB * r["k"])
    lower = np.tril_indices(dims, -1)
    second[lower] = second.T[lower]
    return first, second


def refined_eigenvectors(a: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix, correct to double precision."""
    wide = np.longdouble
    a = a.astype(wide)
    a = (a + a.T) / 2
    size = np.abs(a).max()
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    for _ in range(iterations):
        r = np.eye(len(a), dtype=wide) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # so that rounding over small gaps turns vectors but leaves them orthogonal
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        defect = 2 * (np.linalg.norm(off.astype(np.float64)) + np.linalg.norm(r.astype(np.float64)))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= max(defect, 64 * np.finfo(np.float64).eps * len(a))
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, wide(1), gap))
        x = x + x @ e
        x = _solve_clusters(a, x, near)
        if defect < 1e-15:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x) * size
    order = np.argsort(-values, kind="stable")
    x = x[:, order].astype(np.float64)
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values[order].astype(np.float64), x * sign


def _solve_clusters(a: np.ndarray, x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """x with the vectors of every cluster (chained by ``near``) turned to the eigenvectors of the matrix restricted to their span."""
    order = np.argsort(np.einsum("ij,ij->j", x, a @ x), kind="stable")
    cuts = [i for i in range(1, len(order)) if not near[order[i - 1], order[i]]]
    groups = [order[i:j] for i, j in zip([0, *cuts], [*cuts, len(order)]) if j - i > 1]
    out = x.copy()
    for g in groups:
        y = x[:, g]
        inner = y.T @ (a @ y)
        inner = inner - np.eye(len(g)) * (np.trace(inner) / len(g))  # what is left is small: double precision resolves the cluster
        size = np.abs(inner).max()
        if size:
            turn = np.linalg.eigh(((inner + inner.T) / 2 / size).astype(np.float64))[1].astype(a.dtype)
            out[:, g] = y @ turn
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct x of ``integer_vectors`` once; None where no component has a spread.  The distinct vectors are written to the shared folder."""
    spark = vectors.sparkSession
    path = f"{shared_folder(spark, 'whitening')}/distinct"
    vectors.select("x").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    n, sums = _sums(distinct)
    if not n:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    first, second = _products(distinct, centre)
    numerators = n * second - np.outer(np.array(first, object), np.array(first, object))  # n^2 V, exact
    wide = np.array([[np.longdouble(v) for v in row] for row in numerators]) / (np.longdouble(n) * n)
    values, x = refined_eigenvectors(wide)
    trace = float(np.trace(wide))
    used = int((values[:components] > len(centre) * np.finfo(np.float64).eps * max(values[0], 0)).sum())
    if not used:
        return None
    found = Whitening(n, tuple(sums), x[:, :used], values[:used], trace, 0.0)
    return Whitening(n, tuple(sums), found.vectors, found.values, trace, _identity_error(distinct, found))


def _project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened vectors: integers are centred exactly before anything is rounded."""
    centre = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    rest = np.array([(s - model.n * c) / model.n for s, c in zip(model.sums, centre)])
    return (_centred(x, centre).astype(np.float64) - rest) @ (model.vectors / np.sqrt(model.values))


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened distinct vectors less the identity, in two passes over them."""
    k = model.vectors.shape[1]

    def sums_of(about: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for x in _blocks(batches):
                y = _project(x, model)
                total = total + (y.sum(axis=0) if about is None else (y - about).T @ (y - about)).ravel()
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

        rows = distinct.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]) / model.n

    covariance = sums_of(sums_of(None)).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - sums)^2, exact; null beyond a long."""
    top = model.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, model.sums))
    if top * top * x.shape[1] <= LONG_MAX:
        d = x * model.n - np.array(model.sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    about = np.square(x * float(model.n) - np.array(model.sums, np.float64)).sum(axis=1)
    out: list[int | None] = [None] * len(x)
    for i in np.nonzero(about < 1.1 * LONG_MAX)[0].tolist():
        exact = sum((v * model.n - s) ** 2 for v, s in zip(x[i].tolist(), model.sums))
        out[i] = exact if exact <= LONG_MAX else None
    return out


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """One row a vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        k = model.vectors.shape[1]
        for batch in batches:
            at = 0
            for x in _blocks(iter([batch])):
                m = len(x)
                ids = batch.column("vec_id").slice(at, m)
                at += m
                columns = [ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                           pa.array(_deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(_project(x, model).ravel()),
                           pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.select("vec_id", "x").mapInArrow(run, schema)
