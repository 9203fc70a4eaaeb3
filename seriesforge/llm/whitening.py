"""Embedding whitening: leading eigenvectors of the covariance by spectrum slicing.

Entries become integers (``floor(64 c) + 1000000``), so that sums are exact whatever the order in which tasks
finish. Three passes over the distinct vectors, written once to the shared folder, give the sums, the covariance
(centred before multiplying) and the covariance of the whitened vectors; a task sends partial sums
of a size fixed by the dimension. The eigenproblem is solved on the driver from the one covariance matrix:

* the inertia of ``V - s I``, from its LDL^T factors, counts the eigenvalues above ``s``; bisection by counts
  isolates each of the leading ones,
* Rayleigh quotient iteration, started inside the interval, converges cubically,
* two counts beside the value found certify its number; where they don't, the interval is halved and tried again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET = 64, 1000000
LIMIT = float(1 << 61)              # entries whose 64-fold is beyond have no integer (differences must fit a long)
COMPONENTS = 16
MAX_LONG = (1 << 63) - 1


# ---------------------------------------------------------------------------------------------
# Eigenvalues by counts


def positives(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix: of the signs of D in P A P^T = L D L^T (Sylvester),
    with blocks of one or two, chosen by Bunch and Kaufman's rule."""
    a, count, k, n = matrix.astype(float, copy=True), 0, 0, len(matrix)
    alpha = (1 + 17 ** 0.5) / 8

    def swap(i, j):
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
    while k < n:
        col = np.abs(a[k + 1:, k])
        r = k + 1 + int(col.argmax()) if len(col) else k
        most = col[r - k - 1] if len(col) else 0.0
        size = 1
        if most > 0 and abs(a[k, k]) < alpha * most:
            row = np.abs(a[k:, r])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * most ** 2:
                if abs(a[r, r]) >= alpha * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        if size == 1:
            d = a[k, k]
            count += d > 0
            if d != 0:
                low = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(low, low / d)
        else:
            block = a[k:k + 2, k:k + 2].copy()
            count += 1                                  # such a block has one eigenvalue of each sign
            low = a[k + 2:, k:k + 2].copy()
            a[k + 2:, k + 2:] -= low @ np.linalg.solve(block, low.T)
        k += size
    return int(count)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns): the leading ``most`` of a covariance, fewer if its rank
    in double precision is lower. Eigenvalues that double precision can't tell apart come as an orthonormal basis of
    their common space."""
    dim = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if dim else 0.0
    if not norm > 0:
        return np.zeros(0), np.zeros((dim, 0))
    a = matrix / norm                                   # eigenvalues from 0 to 1
    eye, tiny = np.eye(dim), 4 * dim * np.finfo(float).eps
    counted: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counted:
            counted[s] = positives(a - s * eye)
        return counted[s]
    most = min(most, above(tiny))
    values, vectors = [], np.zeros((dim, 0))
    rng = np.random.default_rng(13)

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - vectors @ (vectors.T @ v)
        return v / np.linalg.norm(v)

    def refined(lo: float, hi: float):
        """Rayleigh quotient iteration from the middle of ``(lo, hi)``: (value, vector, residual)."""
        v, s = apart(rng.standard_normal(dim)), (lo + hi) / 2
        for step in range(12):
            try:
                w = np.linalg.solve(a - s * eye, v)
            except np.linalg.LinAlgError:               # the shift is the eigenvalue
                w = np.linalg.solve(a - (s + tiny * 1e-3) * eye, v)
            if not np.isfinite(w).all():
                break
            v = apart(w)
            residual = np.linalg.norm(a @ v - (v @ a @ v) * v)
            if step > 1:                                # two steps at the middle, so that the nearest one leads
                s = float(v @ a @ v)
            if residual < tiny / 4:
                break
        return float(v @ a @ v), v, residual
    while len(values) < most:
        k = len(values)                                 # looking for number k + 1
        hi = min((s for s in counted if above(s) <= k), default=1.0 + tiny)
        lo = max((s for s in counted if above(s) > k), default=0.0)
        if above(hi) > k:
            hi = 1.0 + tiny
        while True:
            if above(lo) == k + 1 and above(hi) == k:   # one eigenvalue inside
                value, v, residual = refined(lo, hi)
                near = max(tiny, 2 * residual)
                if lo - near <= value <= hi + near and residual < 1e-9 and above(value - near) >= k + 1 and above(value + near) <= k:
                    break
            if hi - lo <= 2 * tiny:                     # a cluster: any vector of its space that is left
                value, v, residual = refined(lo, hi)
                break
            middle = (lo + hi) / 2
            if above(middle) > k:
                lo = middle
            else:
                hi = middle
        values.append(value)
        vectors = np.c_[vectors, v]
    return np.array(values) * norm, vectors


# ---------------------------------------------------------------------------------------------
# Passes over the vectors


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` (long, may be null) and ``x`` (array of longs) of the rows whose vector can be used."""
    v = F.col("v")
    rows = df.select(F.col(common.quoted(id_col)).cast("long").alias("vec_id"),
                     F.col(common.quoted(vector_col)).cast("array<double>").alias("v"))
    usable = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(LIMIT / SCALE)), F.lit(False)))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & usable).select(
        "vec_id", F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(OFFSET)).alias("x"))


def _matrices(batches):
    """(batch, rows of one length as a matrix, their places) for every length in every batch."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("x"))
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        flat = column.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(ends)
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            yield batch, flat[ends[at][:, None] + np.arange(dim)], at


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: number of vectors and the exact sum of every entry."""
    def fn(batches):
        total: dict = {}
        for _, x, _ in _matrices(batches):
            have = total.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            high, low = x >> 32, x & 0xFFFFFFFF                       # neither overflows in a batch
            have[0] += len(x)
            have[1] = [s + (int(h) << 32) + int(w) for s, h, w in zip(have[1], high.sum(axis=0), low.sum(axis=0))]
        for dim, (n, sums) in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim, pa.int32()), "i": pa.array(range(dim), pa.int32()),
                                              "n": pa.array([n] * dim, pa.int64()), "s": [str(s) for s in sums]})
    parts = fit.mapInArrow(fn, "dim int, i int, n long, s string")
    rows = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["i"])):          # one row an entry of a vector
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


class _Centred:
    """Exact deviations from the mean: x - S/n = y - r/n with integers y = x - S div n, r = S mod n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def doubles(self, x: np.ndarray) -> np.ndarray:
        # entries are below 2^61 in size, so the difference holds in a long
        return (x - self.floor) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)^2 of every row as objects: whole numbers, None where a long can't hold it."""
        y = x - self.floor
        top = (float(np.abs(y).max(initial=0)) + 1) * self.n
        if top * top * x.shape[1] < float(1 << 62):
            d = y * self.n - self.rest
            return (d * d).sum(axis=1)
        d = y.astype(object) * self.n - self.rest.astype(object)
        return np.array([s if s <= MAX_LONG else None for s in (d * d).sum(axis=1)], object)


def _products(fit: DataFrame, project) -> dict[int, np.ndarray]:
    """By length: sum of z z^T over the fit list, z = ``project(length, x)``."""
    def fn(batches):
        total: dict = {}
        for _, x, _ in _matrices(batches):
            z = project(x.shape[1], x)
            total[x.shape[1]] = total.get(x.shape[1], 0.0) + z.T @ z
        for dim, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(len(i), dim), pa.int32()), "i": pa.array(i, pa.int32()),
                                              "j": pa.array(j, pa.int32()), "v": pa.array(m[i, j], pa.float64())})
    rows = (fit.mapInArrow(fn, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect())
    out: dict = {}
    for dim in {r["dim"] for r in rows}:
        own = [r for r in rows if r["dim"] == dim]
        m = np.zeros((max(r["j"] for r in own) + 1,) * 2)
        for r in own:
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
        out[dim] = m
    return out


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> dict:
    """A model for each length of vector: ``n``, the centring, the projection (component / sqrt(eigenvalue) as columns),
    ``explained`` and ``identity_error``. Its size depends on the length of the vectors alone."""
    unique = common.spread(common.save(vectors(df, id_col, vector_col).select("x").distinct(), "whitening-fit"))
    centred = {dim: _Centred(n, sums) for dim, (n, sums) in _sums(unique).items()}
    models = {}
    for dim, total in _products(unique, lambda dim, x: centred[dim].doubles(x)).items():
        v = total / centred[dim].n
        values, found = leading(v, components)
        models[dim] = {"n": centred[dim].n, "centred": centred[dim], "projection": found / np.sqrt(values),
                       "explained": values / np.trace(v) if len(values) else values, "values": values, "vectors": found}
    whole = _products(unique, lambda dim, x: centred[dim].doubles(x) @ models[dim]["projection"])
    for dim, m in models.items():
        k = m["projection"].shape[1]
        m["identity_error"] = float(np.abs(whole[dim] / m["n"] - np.eye(k)).max()) if k else 0.0
    return models


def whiten(df: DataFrame, models: dict | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``.

    Vectors that are null or empty, or hold null or non-finite entries (or entries of 2^55 and more, which have no
    integer form) are left out. Repeated rows and null ids stay rows; equal vectors get equal values and count once in
    the fit. Vectors of each length are a space of their own. A direction without variance in double precision has
    no component: a table with a single distinct vector, or an empty one, gives no rows. ``deviation`` is null where
    a long can't hold it.
    """
    models = fit(df, id_col, vector_col, components) if models is None else models

    def fn(batches):
        for batch, x, at in _matrices(batches):
            m = models.get(x.shape[1])
            k = m["projection"].shape[1] if m else 0
            if not k:
                continue
            rows = len(at)
            ids = batch.column(0).take(pa.array(np.repeat(at, k)))
            deviation = m["centred"].deviation(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, m["n"]), pa.int64()),
                 pa.array(np.repeat(deviation, k), pa.int64()), pa.array((m["centred"].doubles(x) @ m["projection"]).ravel(), pa.float64()),
                 pa.array(np.tile(m["explained"], rows), pa.float64()), pa.array(np.full(rows * k, m["identity_error"]), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return common.spread(vectors(df, id_col, vector_col)).mapInArrow(
        fn, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
