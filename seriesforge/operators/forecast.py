"""Trend projections of yearly (or any ordered numeric period) series.

* :func:`fit_trend` — elastic-net linear trend per key as one aggregate (closed form, see
  :mod:`seriesforge.functions.stats`); equals MLlib ``LinearRegression`` on one feature.
* :func:`forecast_linear` — fit one or several horizons (training cut-offs) in the same aggregate,
  append the future periods per key, score every row.
* :func:`fit_elastic_net_by_key` — elastic net of several features for every key: one aggregate of moments a key, then
  coordinate descent inside the plan; :func:`forecast_elastic_net` scores with it.
* :func:`forecast_gbt` — one MLlib model of gradient-boosted trees for all keys, on standardised series; :func:`fit_gbt` keeps
  the model, to save it and to score other points (:class:`GbtForecast`).
* :func:`rmse` — root mean squared error per key.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import quoted, quoted_all, unused_names
from ..functions.stats import descent, moment_aggregates, trend_aggregates, trend_intercept, trend_slope
from .columns import HEADER

# The reference's regression settings (elastic-net regParam 0.3, mixing 0.8;
# boosted trees with 10 iterations and a vector indexer of at most 4 categories).
REG_PARAM = 0.3
ELASTIC_NET = 0.8
GBT_ITERATIONS = 10
MAX_CATEGORIES = 4
SWEEPS = 200                            # rounds of coordinate descent; correlated features take more


def future_points(df: DataFrame, period: str, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, the integer periods after the last one present, up to ``horizon`` inclusive.

    The aggregate also counts the periods: a max alone over a roll-up's grouping column would be
    re-planned as a separate aggregate of the raw input, so a plan that unions the series with
    its future points would read the input twice instead of sharing the roll-up's shuffle.
    """
    own = unused_names(df, "last", "periods")
    stats = df.groupBy(*quoted_all(keys)).agg(F.max(quoted(period)).alias(own["last"]), F.count(F.lit(1)).alias(own["periods"]))
    last = quoted(own["last"]).cast("int")
    # (periods > 0 always holds; referencing it keeps the count from being pruned.)
    seq = F.when((last < F.lit(horizon)) & (quoted(own["periods"]) > 0), F.sequence(last + 1, F.lit(horizon)))
    return stats.select(*quoted_all(keys), F.explode(seq).alias(period))


def fit_trend(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), train: Column | None = None,
              reg: float = REG_PARAM, alpha: float = ELASTIC_NET) -> DataFrame:
    """One row per key: ``n`` training rows, ``slope``, ``intercept``."""
    stats = df.groupBy(*quoted_all(keys)).agg(*trend_aggregates(quoted(x), quoted(y), train, "_"))
    slope = trend_slope("_", reg, alpha)
    return stats.select(*quoted_all(keys), F.col("_n").alias("n"), slope.alias("slope"),
                        trend_intercept("_", slope).alias("intercept"))


def _attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row as scalar
    subqueries: evaluated once (Catalyst merges subqueries over the same plan), no join."""
    return df.select("*", *[one_row.select(quoted(c)).scalar().alias(c) for c in one_row.columns])


def forecast_linear(series: DataFrame, x: str, y: str, cutoffs: int | Sequence[int],
                    keys: Sequence[str] = (), horizon: int | None = None,
                    reg: float = REG_PARAM, alpha: float = ELASTIC_NET,
                    names: Sequence[str] | None = None) -> DataFrame:
    """Score every row (and the future periods up to ``horizon``) with one trend per cut-off.

    The fits are one aggregate per key, partial before the shuffle, joined back to the rows null-safe,
    so a key with very many rows is split like any skewed join. For cut-off ``c`` the model trains on rows with ``x <= c``; all cut-offs
    are conditional aggregates of the same pass, so several horizons cost one shuffle, not one
    fit each. Future rows have NULL measures. Output: the series columns plus one prediction column
    per cut-off (``names``, default ``prediction`` for one cut-off, ``prediction<c>`` for several).
    """
    cutoffs = [cutoffs] if isinstance(cutoffs, int) else list(cutoffs)
    if names is None:
        names = ["prediction"] if len(cutoffs) == 1 else [f"prediction{c}" for c in cutoffs]
    keys = list(keys)
    cuts = range(len(cutoffs))
    own = unused_names(series, "last", "x", *[f"{n}{i}" for n in ("c", "slope", "icpt") for i in cuts], *[f"key{i}" for i in range(len(keys))])
    aggs = [F.max(quoted(x)).alias(own["last"])]
    for i, c in enumerate(cutoffs):
        aggs += trend_aggregates(quoted(x), quoted(y), quoted(x) <= F.lit(c), own[f"c{i}"] + "_")
    coef = []
    for i in cuts:
        slope = trend_slope(own[f"c{i}"] + "_", reg, alpha)
        coef += [slope.alias(own[f"slope{i}"]), trend_intercept(own[f"c{i}"] + "_", slope).alias(own[f"icpt{i}"])]
    fit = series.groupBy(*quoted_all(keys)).agg(*aggs).select(*quoted_all(keys), own["last"], *coef)     # one row per key
    coef_names = [c for c in fit.columns if c not in keys and c != own["last"]]
    if keys:
        # NULL is a key like any other; the planner may split a hot key's rows, fits are one row each
        scored = _join_keys(series, fit.drop(own["last"]), keys, [own[f"key{i}"] for i in range(len(keys))])
    else:
        # the coefficients as scalar subqueries of the one-row fit
        scored = _attach_scalars(series, fit.drop(own["last"]))
    if horizon is not None:
        # future rows come from the fit rows; observed rows keep their x as it is
        last = F.floor(own["last"]).cast("int")
        seq = F.when(last < F.lit(horizon), F.sequence(last + 1, F.lit(horizon)))
        futures = (fit.select(*quoted_all(keys), F.explode(seq).alias(own["x"]), *coef_names)
                   .withColumn(x, quoted(own["x"]).cast(dict(series.dtypes)[x])).drop(own["x"]))
        scored = scored.unionByName(futures, allowMissingColumns=True)
    preds = [_predicted(series, y, quoted(own[f"icpt{i}"]) + quoted(own[f"slope{i}"]) * quoted(x).cast("double"), n)
             for i, n in enumerate(names)]
    return scored.select(*quoted_all(series.columns), *preds)


def _join_keys(df: DataFrame, per_key: DataFrame, keys: Sequence[str], as_names: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``per_key`` (one row a key), joined null-safe."""
    rest = [c for c in per_key.columns if c not in keys]
    own = per_key.select(*[quoted(k).alias(n) for k, n in zip(keys, as_names)], *quoted_all(rest))
    on = F.lit(True)
    for k, n in zip(keys, as_names):
        on = on & quoted(k).eqNullSafe(quoted(n))
    return df.join(own, on).select(*quoted_all(df.columns), *quoted_all(rest))


def _predicted(series: DataFrame, y: str, value: Column, name: str) -> Column:
    """A prediction of ``y``: its metadata, with a display header that says so."""
    metadata = next((f.metadata or {} for f in series.schema.fields if f.name == y), {})
    if HEADER in metadata:
        metadata = {**metadata, HEADER: f"{metadata[HEADER]} (prediction)"}
    return value.alias(name, metadata=metadata) if metadata else value.alias(name)


def fit_elastic_net_by_key(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str] = (), train: Column | None = None,
                           reg: float = REG_PARAM, alpha: float = ELASTIC_NET, sweeps: int = SWEEPS) -> DataFrame:
    """One row per key: ``n`` training rows, ``coefficients`` (array, one a feature), ``intercept``.

    The elastic net of MLlib's ``LinearRegression`` (standardised, with intercept) for any number of keys in one plan: an
    aggregate of ``n``, means and covariances of the features and the label (partial before the shuffle, so a hot key is no
    matter), then ``sweeps`` rounds of coordinate descent on each key's moments, as array expressions. Rows with a NULL label
    or feature, or where ``train`` doesn't hold, are left out. A constant feature has coefficient 0, a constant label 0 for all;
    a key without training rows NULLs.
    """
    own = unused_names(df, "m")["m"] + "_"
    moments = df.groupBy(*quoted_all(keys)).agg(*moment_aggregates([quoted(f) for f in features], quoted(y), train, own))
    coefficients, intercept = descent(len(features), own, reg, alpha, sweeps)
    fitted = moments.select(*quoted_all(keys), quoted(f"{own}n").alias("n"), F.array(*[quoted(f"{own}x{i}") for i in range(len(features))]).alias(f"{own}means"),
                            quoted(f"{own}y").alias(f"{own}mean"), coefficients.alias("coefficients"))
    return fitted.select(*quoted_all(keys), "n", "coefficients", intercept(F.col("coefficients"), quoted(f"{own}means"), quoted(f"{own}mean")).alias("intercept"))


def forecast_elastic_net(series: DataFrame, features: Sequence[str], y: str, keys: Sequence[str] = (), train: Column | None = None,
                         reg: float = REG_PARAM, alpha: float = ELASTIC_NET, sweeps: int = SWEEPS, points: DataFrame | None = None,
                         name: str = "prediction") -> DataFrame:
    """The rows of ``series`` (or other ``points`` with its keys and features) with ``name``: the prediction of the model of
    their key fitted on ``series`` (see :func:`fit_elastic_net_by_key`). Points of a key without a model are left out; a NULL
    feature gives NULL."""
    rows = series if points is None else points
    own = unused_names(rows, "w", "b", *[f"key{i}" for i in range(len(keys))])
    fit = fit_elastic_net_by_key(series, features, y, keys, train, reg, alpha, sweeps)
    fit = fit.select(*quoted_all(keys), F.col("coefficients").alias(own["w"]), F.col("intercept").alias(own["b"]))
    scored = _join_keys(rows, fit, keys, [own[f"key{i}"] for i in range(len(keys))]) if keys else _attach_scalars(rows, fit)
    value = quoted(own["b"])
    for i, f in enumerate(features):
        value = value + quoted(own["w"])[i] * quoted(f).cast("double")
    return scored.select(*quoted_all(rows.columns), _predicted(series, y, value, name))


def rmse(scored: DataFrame, y: str, prediction: str = "prediction", keys: Sequence[str] = (),
         name: str = "rmse", rows: Column | None = None) -> DataFrame:
    """sqrt(mean((y - prediction)^2)) per key, over rows where both are present (and ``rows``
    holds, e.g. the test periods). ``rows`` is evaluated inside the aggregate rather than as a
    filter in front of it: a filter on a roll-up's period would be pushed into a second scan of
    the raw input, while the scored rows and the fit share one."""
    err = quoted(y).cast("double") - quoted(prediction)
    if rows is not None:
        err = F.when(rows, err)
    return scored.groupBy(*quoted_all(keys)).agg(F.sqrt(F.avg(err * err)).alias(name), F.count(err).alias("n"))


def _trained_stats(data: DataFrame, x: str, y: str, keys: Sequence[str], train: Column) -> DataFrame:
    """Per key: mean and deviation of the training label, and its trend in deviations per unit of x."""
    stats = data.groupBy(*quoted_all(keys)).agg(*trend_aggregates(quoted(x), quoted(y), train, "_"))
    sd = F.when(F.col("_y_sd") > 0, F.col("_y_sd")).otherwise(F.lit(1.0))
    slope = trend_slope("_", 0.0, 0.0)
    return stats.select(*[quoted(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col("_y_mean").alias("mean"),
                        sd.alias("sd"), F.coalesce(slope / sd, F.lit(0.0)).alias("trend"))


@dataclass
class GbtForecast:
    """Boosted trees fitted by :func:`fit_gbt`: the MLlib pipeline and, with keys, what scales each key's series (one row a key:
    ``key0..``, ``mean``, ``sd``, ``trend``)."""
    model: object
    x: str
    keys: tuple[str, ...]
    features: tuple[str, ...]
    stats: DataFrame | None

    def score(self, points: DataFrame, name: str = "prediction") -> DataFrame:
        """``points`` (any table with ``x``, the keys and the features) with their predictions. A key that was not there when the
        model was fitted, or had no training rows, gets NULL."""
        data, inputs = _inputs(points, self)
        scored = self.model.transform(data)
        value = F.col(inputs["prediction"])
        if self.keys:
            value = F.when(quoted(inputs["known"]), value * quoted(inputs["sd"]) + quoted(inputs["mean"]))
        return scored.select(*quoted_all(points.columns), value.alias(name))

    def save(self, path: str) -> None:
        """Write the model below ``path``: the pipeline by MLlib's writer, the keys as Parquet, names as one line of JSON."""
        path = path.rstrip("/")
        self.model.write().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        if self.stats is not None:
            self.stats.write.parquet(f"{path}/keys")
        about = json.dumps({"x": self.x, "keys": self.keys, "features": self.features})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")


def load_gbt(spark: SparkSession, path: str) -> GbtForecast:
    """A model saved by :meth:`GbtForecast.save`."""
    from pyspark.ml import PipelineModel

    path = path.rstrip("/")
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    stats = spark.read.parquet(f"{path}/keys") if about["keys"] else None
    return GbtForecast(PipelineModel.load(f"{path}/pipeline"), about["x"], tuple(about["keys"]), tuple(about["features"]), stats)


# Columns of the pipeline. (They are part of a saved model, so they can't give way to a caller's names: those are renamed.)
_GBT = {"x": "_x_feature", "trend": "_trend", "label": "_label", "features": "_features", "prediction": "_prediction",
        "raw": "_raw", "indexed": "_indexed"}


def _inputs(points: DataFrame, fitted: GbtForecast) -> tuple[DataFrame, dict[str, str]]:
    """``points`` with the pipeline's input columns, and the names of the scaling columns."""
    taken = {*_GBT.values(), *[f"_f{i}" for i in range(len(fitted.features))]} & {c.lower() for c in points.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} clash with the model's own: rename them")
    names = {**unused_names(points, "mean", "sd", "known", *[f"key{i}" for i in range(len(fitted.keys))]), "prediction": _GBT["prediction"]}
    data = points
    if fitted.keys:
        stats = fitted.stats.select(*[quoted(f"key{i}").alias(names[f"key{i}"]) for i in range(len(fitted.keys))],
                                    F.col("mean").alias(names["mean"]), F.col("sd").alias(names["sd"]), F.col("trend").alias(_GBT["trend"]),
                                    F.col("mean").isNotNull().alias(names["known"]))
        on = F.lit(True)
        for i, k in enumerate(fitted.keys):
            on = on & quoted(k).eqNullSafe(quoted(names[f"key{i}"]))
        data = points.join(stats, on, "left").fillna({_GBT["trend"]: 0.0, names["known"]: False})
    return _feature_columns(data, fitted.features).withColumn(_GBT["x"], quoted(fitted.x).cast("double")), names


def fit_gbt(series: DataFrame, x: str, y: str, train_until: int, keys: Sequence[str] = (), max_iter: int = GBT_ITERATIONS,
            seed: int = 42, max_categories: int = MAX_CATEGORIES, features: Sequence[str] = ()) -> GbtForecast:
    """Gradient-boosted trees on ``x``, trained on ``x <= train_until``, to score with and to save; see :func:`forecast_gbt`.
    The series should be cheap to read twice (a table, or checkpointed)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    from pyspark.ml.regression import GBTRegressor

    from ..session import materialize

    is_train = (quoted(x) <= F.lit(train_until)) & quoted(y).isNotNull()
    stats = materialize(_trained_stats(series, x, y, keys, quoted(x) <= F.lit(train_until))) if keys else None
    fitted = GbtForecast(None, x, tuple(keys), tuple(features), stats)
    data, names = _inputs(series.filter(is_train), fitted)
    label, inputs = quoted(y).cast("double"), [_GBT["x"]]
    if keys:
        label = (label - quoted(names["mean"])) / quoted(names["sd"])
        inputs.append(_GBT["trend"])
    stages = []
    if features:
        stages = [VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol=_GBT["raw"]),
                  VectorIndexer(inputCol=_GBT["raw"], outputCol=_GBT["indexed"], maxCategories=max_categories,
                                handleInvalid="keep")]
        inputs.append(_GBT["indexed"])
    stages += [VectorAssembler(inputCols=inputs, outputCol=_GBT["features"]),
               GBTRegressor(featuresCol=_GBT["features"], labelCol=_GBT["label"], predictionCol=_GBT["prediction"],
                            maxIter=max_iter, seed=seed)]
    fitted.model = Pipeline(stages=stages).fit(data.withColumn(_GBT["label"], label))
    return fitted


def forecast_gbt(series: DataFrame, x: str, y: str, train_until: int, keys: Sequence[str] = (),
                 max_iter: int = GBT_ITERATIONS, seed: int = 42, max_categories: int = MAX_CATEGORIES,
                 features: Sequence[str] = ()):
    """Gradient-boosted trees on ``x``, trained on ``x <= train_until``; returns
    ``(scored rows, fitted PipelineModel)``.

    ``x`` is always continuous, however few training periods there are; other numeric ``features``
    go through a vector indexer (at most ``max_categories`` values make one categorical). With
    keys, one MLlib model covers them all: each key's label is standardised with its training
    mean and deviation, its trend is a feature, and predictions are scaled back, so any number
    of keys with any levels fit one forest (a key without training rows gets NULL). Without keys the
    label is used as it is. MLlib trains distributed; rows with NULL label are left out of the fit.
    The series is checkpointed first (shared folder): all passes read that.
    """
    from ..session import materialize

    data = materialize(series)
    fitted = fit_gbt(data, x, y, train_until, keys, max_iter, seed, max_categories, features)
    return fitted.score(data), fitted.model


def score_gbt(model, points: DataFrame, x: str, features: Sequence[str] = ()) -> DataFrame:
    """Predictions of a model of :func:`forecast_gbt` (fitted without keys) for a table of chosen ``x``."""
    return GbtForecast(model, x, (), tuple(features), None).score(points)


def fit_elastic_net(df: DataFrame, features: Sequence[str], y: str, train: Column | None = None,
                    reg: float = REG_PARAM, alpha: float = ELASTIC_NET, max_iter: int = 100):
    """Elastic-net regression on several features by MLlib: a fitted model of one assembler and one
    regression. Rows with a NULL feature or label are left out. One feature needs no MLlib, see
    :func:`fit_trend`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df if train is None else df.filter(train)
    rows = _feature_columns(rows, features).withColumn("_label", quoted(y).cast("double"))
    rows = rows.dropna(subset=["_label", *[f"_f{i}" for i in range(len(features))]])
    stages = [VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_features"),
              LinearRegression(featuresCol="_features", labelCol="_label", predictionCol="_prediction",
                               regParam=reg, elasticNetParam=alpha, maxIter=max_iter)]
    return Pipeline(stages=stages).fit(rows)


def score_elastic_net(model, points: DataFrame, features: Sequence[str]) -> DataFrame:
    """Predictions of a model of :func:`fit_elastic_net` for any table with its features."""
    return model.transform(_feature_columns(points, features)).select(
        *quoted_all(points.columns), F.col("_prediction").alias("prediction"))


def _feature_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select("*", *[quoted(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
