"""Elastic-net trend of one feature as plain aggregate expressions.

MLlib's ``LinearRegression`` (standardization on, intercept on) minimises, for one feature x and
label y,

    1/(2n) * sum((y - w*x - b)^2) + reg * (alpha*|w| + (1-alpha)/2 * w^2)

after scaling x and y by their population standard deviations. With one feature the optimum has a
closed form (soft-thresholding of the covariance):

    slope     = sign(c) * max(|c|/sx - reg*alpha, 0) / (sy + reg*(1-alpha)) * sy/sx
    intercept = mean(y) - slope * mean(x)

with c = covar_pop(y, x), sx = stddev_pop(x), sy = stddev_pop(y). Everything it needs is an
algebraic aggregate, so one ``groupBy(keys).agg(...)`` fits a model per key for any number of
keys in one shuffle, with partial aggregation before the exchange.

Degenerate series follow MLlib: a constant label gives slope 0 and intercept mean(y); a constant
feature (one distinct x, e.g. a single point) gives slope 0 and intercept mean(y); no training
rows give NULL coefficients.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trend_aggregate_exprs(x: Column, y: Column, train: Column | None, prefix: str) -> list[tuple[str, Column]]:
    """(name, aggregate) pairs (n, means, population moments) over training rows only, usable in
    ``agg`` or ``over(window)``.

    A row trains the model when ``train`` holds and both x and y are non-null; the other rows
    contribute NULL, which every aggregate below skips.
    """
    ok = x.isNotNull() & y.isNotNull()
    if train is not None:
        ok = ok & train
    xs = F.when(ok, x.cast("double"))
    ys = F.when(ok, y.cast("double"))
    return [
        (f"{prefix}n", F.count(xs)),
        (f"{prefix}x_mean", F.avg(xs)),
        (f"{prefix}y_mean", F.avg(ys)),
        (f"{prefix}x_sd", F.stddev_pop(xs)),
        (f"{prefix}y_sd", F.stddev_pop(ys)),
        (f"{prefix}xy_cov", F.covar_pop(ys, xs)),
    ]


def trend_aggregates(x: Column, y: Column, train: Column | None, prefix: str) -> list[Column]:
    """The aggregates of :func:`trend_aggregate_exprs`, aliased, for ``groupBy(...).agg``."""
    return [agg.alias(name) for name, agg in trend_aggregate_exprs(x, y, train, prefix)]


def trend_slope(prefix: str, reg: float, alpha: float) -> Column:
    n, sx, sy, c = (F.col(f"{prefix}{s}") for s in ("n", "x_sd", "y_sd", "xy_cov"))
    shrunk = F.greatest(F.try_divide(F.abs(c), sx) - F.lit(reg * alpha), F.lit(0.0))
    general = F.signum(c) * F.try_divide(shrunk, sy + F.lit(reg * (1.0 - alpha))) * F.try_divide(sy, sx)
    return (F.when(n == 0, F.lit(None).cast("double"))
            .when((sx == 0) | (sy == 0), F.lit(0.0))
            .otherwise(general))


def trend_intercept(prefix: str, slope: Column) -> Column:
    return F.col(f"{prefix}y_mean") - slope * F.col(f"{prefix}x_mean")


def moment_aggregates(xs: list[Column], y: Column, train: Column | None, prefix: str) -> list[Column]:
    """n, means and population covariances of several features and a label over the rows where all are present (and ``train``
    holds): ``n``, ``y``, ``yy``, and for features i <= j ``x{i}``, ``c{i}_{j}``, ``cy{i}``."""
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    if train is not None:
        ok = ok & train
    vs = [F.when(ok, x.cast("double")) for x in xs]
    label = F.when(ok, y.cast("double"))
    out = [F.count(label).alias(f"{prefix}n"), F.avg(label).alias(f"{prefix}y"), F.var_pop(label).alias(f"{prefix}yy")]
    for i, v in enumerate(vs):
        out += [F.avg(v).alias(f"{prefix}x{i}"), F.covar_pop(v, label).alias(f"{prefix}cy{i}")]
        out += [F.covar_pop(v, vs[j]).alias(f"{prefix}c{i}_{j}") for j in range(i, len(vs))]
    return out


def descent(p: int, prefix: str, reg: float, alpha: float, sweeps: int):
    """(coefficients, intercept of coefficients, means and label mean) of the elastic net from the moments of
    :func:`moment_aggregates`.

    In units of deviations the problem has correlations only: the update of one coordinate, the others held, is the closed form
    of one feature (soft threshold, then shrinkage), and ``sweeps`` rounds over all coordinates are a fold over
    arrays of ``p`` entries in the plan.
    """
    sd = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    m = lambda name: F.col(f"`{prefix}{name}`")
    sy, sds = sd(m("yy")), [sd(m(f"c{i}_{i}")) for i in range(p)]
    share = lambda c, a, b: F.coalesce(F.try_divide(c, a * b), F.lit(0.0))
    target = F.array(*[share(m(f"cy{i}"), sds[i], sy) for i in range(p)])
    corr = F.array(*[F.array(*[share(m(f"c{min(i, j)}_{max(i, j)}"), sds[i], sds[j]) if i != j else F.lit(0.0) for j in range(p)])
                     for i in range(p)])
    l1, l2 = F.try_divide(F.lit(reg * alpha), sy), F.try_divide(F.lit(reg * (1.0 - alpha)), sy)
    setup = F.struct(target.alias("b"), corr.alias("a"), l1.alias("l1"), l2.alias("l2"), F.array(*sds).alias("sd"))

    def update(s, w, i):
        left = F.element_at(s["b"], i) - F.aggregate(F.zip_with(F.element_at(s["a"], i), w, lambda a, v: a * v), F.lit(0.0), lambda t, v: t + v)
        shrunk = F.signum(left) * F.greatest(F.abs(left) - s["l1"], F.lit(0.0)) / (s["l2"] + 1.0)
        return F.when(F.element_at(s["sd"], i) > 0, shrunk).otherwise(F.lit(0.0))

    def sweep(s, w):
        return F.aggregate(F.sequence(F.lit(1), F.lit(p)), w, lambda acc, i: F.transform(
            acc, lambda v, k: F.when(k + 1 == i, update(s, acc, i)).otherwise(v)))
    start = F.array(*[F.lit(0.0) for _ in range(p)])
    folded = F.transform(F.array(setup), lambda s: F.transform(
        F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), start, lambda w, _: sweep(s, w)),
        lambda w, k: F.when(F.element_at(s["sd"], k + 1) > 0, w / F.element_at(s["sd"], k + 1)).otherwise(F.lit(0.0))))[0]
    zero = F.array(*[F.lit(0.0) for _ in range(p)])
    coefficients = (F.when(m("n") == 0, F.lit(None).cast("array<double>")).when(sy == 0, zero)
                    .otherwise(F.transform(folded, lambda w: w * sy)))

    def intercept(w, means, mean):
        return mean - F.aggregate(F.zip_with(w, means, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return coefficients, intercept
