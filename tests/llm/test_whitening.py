"""Whitening against LAPACK and exact sums; spectra that are hard to slice."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from seriesforge.llm import whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("x", T.StringType()), T.StructField("component", T.StringType())])


@pytest.mark.parametrize("kind", ["spread", "equal", "tiny", "low rank", "close", "zero"])
def test_leading_eigenvalues(kind):
    rng = np.random.default_rng(3)
    for dim in (1, 2, 5, 17, 40):
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        w = {"spread": rng.random(dim) * 100, "equal": np.full(dim, 7.0), "tiny": 10.0 ** (-12 * rng.random(dim)),
             "low rank": np.where(np.arange(dim) < 3, 5.0 + rng.random(dim), 0.0), "close": 50 + 1e-9 * np.arange(dim), "zero": np.zeros(dim)}[kind]
        a = (q * w) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.leading(a, 16)
        want = np.linalg.eigvalsh(a)[::-1][:len(values)]
        assert len(values) >= min(16, int((w > 1e-12 * max(w.max(), 1e-300)).sum()) if w.max() > 0 else 0)
        scale = max(w.max(), 1e-300)
        assert np.abs(values - want).max(initial=0) <= 1e-13 * scale
        assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) <= 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a = rng.standard_normal((rng.integers(1, 12),) * 2)
        a = a + a.T
        if rng.random() < 0.3:
            np.fill_diagonal(a, 0)                      # needs blocks of two
        w = np.linalg.eigvalsh(a)
        if np.abs(w).min() > 1e-9:
            assert whitening.positives(a) == (w > 0).sum()


def rows(seed=2, n=300, dim=20):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)) * np.linspace(3, 0.3, dim)
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    out += [(1000 + i, base[i].tolist()) for i in range(50)]               # copies count once
    out += [(5, base[5].tolist()), (None, base[6].tolist()), (2000, None), (2001, [None] * dim), (2002, [float("nan")] * dim),
            (2003, [float("inf")] + [0.0] * (dim - 1)), (2004, [])]
    return out


def test_whitening_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in data], SCHEMA).repartition(6)
    got = whitening.whiten(df).collect()
    usable = [(i, v) for i, v in data if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = {i: [math.floor(64 * c) + 1000000 for c in v] for i, v in usable}
    unique = sorted({tuple(x) for x in xs.values()})
    n, sums = len(unique), [sum(c) for c in zip(*unique)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in unique])
    v = z.T @ z / n
    w, u = np.linalg.eigh(v)
    w, u = w[::-1], u[:, ::-1]
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert len(got) == 16 * len(usable) and set(by_id) == set(xs)
    signs = {}
    for i, own in by_id.items():
        dev = sum((n * a - s) ** 2 for a, s in zip(xs[i], sums))
        zi = np.array([float(Fraction(n * a - s, n)) for a, s in zip(xs[i], sums)])
        for r in own:
            k = r["component"] - 1
            want = zi @ u[:, k] / math.sqrt(w[k])
            sign = signs.setdefault(k, 1 if (want > 0) == (r["whitened"] > 0) else -1)
            assert abs(r["whitened"] * sign - want) < 1e-9 and r["n"] == n and r["deviation"] == dev
            assert abs(r["explained"] / (w[k] / w.sum()) - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_edge_cases(spark):
    frame = lambda data: spark.createDataFrame([(i, v, "", "") for i, v in data], SCHEMA)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0      # one distinct vector: no variance
    line = whitening.whiten(frame([(i, [float(i), -float(i), 5.0]) for i in range(4)])).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    # lengths are spaces of their own; large entries keep exact deviations, or none where a long can't hold them
    mixed = whitening.whiten(frame([(1, [0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [1e12, 0.0]), (5, [1e17, 0.0])])).collect()
    assert {(r["vec_id"], r["n"], r["deviation"]) for r in mixed if r["vec_id"] < 3} == {(1, 2, 64 ** 2), (2, 2, 64 ** 2)}
    assert [r["deviation"] for r in mixed if r["vec_id"] == 4] == [None] and not [r for r in mixed if r["vec_id"] == 5]
    exact = whitening.whiten(frame([(1, [0.0]), (2, [1e7])])).collect()
    assert {r["deviation"] for r in exact} == {(64 * 10 ** 7) ** 2}
