"""Rejected lines, positions, several grains in one aggregate, gaps over any span, keyed elastic nets, saved models, headers
that follow their columns, bounds observed while writing."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

import seriesforge as sfg
from seriesforge.plans import queries as q

from .conftest import SMALL_SF


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


# ---------------------------------------------------------------------------------------------
# Rejected lines


def test_rejects_say_file_line_and_reason(spark, workdir):
    d = os.path.join(workdir, "in")
    write(f"{d}/a.csv", 'Period,Total\n"January 2000","1"\n"Janvier 2000","2"\n"March 2000","x"\n\n\nSOURCE: agency, data\n')
    write(f"{d}/b.csv", 'Period,Total\n"April 2000",""\n,"5"\n"May 2000","6","extra"\n,\n"June 2000",99999999999\n')
    rows, rejects = sfg.read_series_csv(spark, d, rejects=True)
    assert sorted(map(tuple, rows.collect())) == [(dt.date(2000, 1, 1), 1), (dt.date(2000, 5, 1), 6)]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, sfg.read_series_csv(spark, d).collect()))
    got = sorted((os.path.basename(r.file), r.line, r.reason) for r in rejects.collect())
    assert got == [("a.csv", '"Janvier 2000","2"', "unparsable period"), ("a.csv", '"March 2000","x"', "unparsable value"),
                   ("a.csv", "SOURCE: agency, data", "unparsable period and value"), ("b.csv", '"June 2000",99999999999', "unparsable value"),
                   ("b.csv", ",", "period and value"), ("b.csv", ",5", "period"), ("b.csv", "April 2000,", "value")]
    # any subset of the columns gives the same lines
    assert rejects.select("line").count() == 7 and rejects.groupBy("reason").count().count() == 6
    with pytest.raises(ValueError):
        sfg.read_series_csv(spark, d, not_null=False, rejects=True)


def test_rejects_of_clean_and_floating_files(spark, workdir):
    p = write(os.path.join(workdir, "f", "a.csv"), 'Period,Total\n"January 2000","1.5"\n"February 2000","NaN"\n')
    rows, rejects = sfg.read_series_csv(spark, p, value_type=DoubleType(), rejects=True)
    assert rows.count() == 1 and [(r.reason) for r in rejects.collect()] == ["value"]
    p = write(os.path.join(workdir, "g", "a.csv"), 'Period,Total\n"January 2000","1"\n')
    rows, rejects = sfg.read_series_csv(spark, p, rejects=True)
    assert rows.count() == 1 and rejects.count() == 0


# ---------------------------------------------------------------------------------------------
# Positions


@pytest.mark.parametrize("ascending", [True, False])
def test_positions_are_row_numbers(spark, ascending):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(1000)]        # a third of all rows share a key
    df = spark.createDataFrame(rows, "k int, v int").repartition(13)
    got = sfg.sorted_series(df, "k", ascending=ascending, position="place").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=not ascending)
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.place)] == order
    assert sorted(r.place for r in got) == list(range(1, 1001))


def test_positions_of_empty_and_clashing_frames(spark):
    df = spark.createDataFrame([], "k int, _part int, _row int")
    assert sfg.sorted_series(df, "k", position="position").count() == 0
    df = spark.createDataFrame([(2, 7, 8), (1, 5, 6)], "k int, _part int, _row int")
    assert sorted(map(tuple, sfg.sorted_series(df, "k", position="position").collect())) == [(1, 5, 6, 1), (2, 7, 8, 2)]


def test_published_order_is_read_back(spark, workdir):
    df = spark.createDataFrame([((i * 37) % 500, f"t{i}\nx") for i in range(500)], "k int, text string").repartition(9)
    for conf in ("1", "8"):
        old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true" if conf == "1" else "false")
        try:
            path = sfg.publish_chart(df, workdir, f"c{conf}", order_by=["k"])
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        data, _ = sfg.read_chart(spark, workdir, f"c{conf}", schema=df.schema, position="position")
        assert data.where("position <> k + 1").count() == 0 and data.count() == 500
    assert len([f for f in os.listdir(f"{path}/data") if f.endswith(".csv")]) > 1


# ---------------------------------------------------------------------------------------------
# Several grains, headers


def test_grains_equal_roll_ups(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), dt.date(rng.randrange(2000, 2004), rng.randrange(1, 13), 5), rng.choice([None, 1, 2])) for _ in range(300)]
    df = sfg.with_headers(spark.createDataFrame(rows, "k string, d date, v int"), {"d": "Day", "v": "Value", "k": "Key"})
    grains = sfg.rollup_grains(df, "d", ["month", "quarter", "year"], {"v": "v"}, keys=["k"])
    for grain, header in (("month", "Month"), ("quarter", "Quarter"), ("year", "Year")):
        want, got = sfg.rollup_series(df, "d", grain, {"v": "v"}, keys=["k"]), sfg.grain_of(grains, grain)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        for frame in (got, want):
            headers = [sfg.column_metadata(frame, c).get("header") for c in frame.columns]
            assert headers == ["Key", header, "Value"]
    with pytest.raises(ValueError):
        sfg.rollup_grains(df, "d", ["year", "year"], {"v": "v"})


def test_dashboard_is_one_aggregate_and_one_more_shuffle(spark):
    from seriesforge.plans.shape import executed_shape
    one, grains = executed_shape(q.gold_monthly(spark, SMALL_SF, cutoff=None)), executed_shape(q.dashboard_grains(spark, SMALL_SF))
    assert grains["shuffles"] == one["shuffles"] + 1 and grains["scans"] == one["scans"]
    plan = q.dashboard_grains(spark, SMALL_SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Expand [") == 1


def test_headers_follow_totals_and_forecasts(spark):
    df = spark.createDataFrame([(y, y * 2, y * 3) for y in range(2000, 2010)], "year int, a bigint, b bigint")
    df = sfg.with_headers(sfg.with_metadata_all(df, "unit", "000s"), {"a": "A"})
    total = sfg.with_total(df, "t", ["a", "b"])
    assert sfg.column_metadata(total, "t") == {"unit": "000s"}                 # shared by the parts; headers are their own
    scored = sfg.forecast_linear(df, "year", "a", 2005, horizon=2012)
    assert sfg.column_metadata(scored, "prediction") == {"unit": "000s", "header": "A (prediction)"}
    assert sfg.column_metadata(scored, "a")["header"] == "A"
    assert sfg.column_metadata(sfg.with_total(spark.range(1).selectExpr("id a", "id b"), "t", ["a", "b"]), "t") == {}


# ---------------------------------------------------------------------------------------------
# Gaps over any span


def brute_gaps(rows):
    out = set()
    by_key = {}
    for k, d in rows:
        if d is not None:
            by_key.setdefault(k, set()).add(d.year * 12 + d.month - 1)
    for k, months in by_key.items():
        out |= {(k, dt.date(m // 12, m % 12 + 1, 1)) for m in range(min(months), max(months) + 1) if m not in months}
    return out


def test_gaps_over_any_span(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), dt.date(rng.randrange(1998, 2003), rng.randrange(1, 13), rng.randrange(1, 29))) for _ in range(60)]
    rows += [("year end", dt.date(1999, 11, 3)), ("year end", dt.date(2000, 2, 9)), ("none", dt.date(2000, 1, 1)), ("none", dt.date(2000, 2, 1)),
             ("single", dt.date(2000, 1, 31)), ("no date", None), ("inside", dt.date(2000, 3, 1)), ("inside", dt.date(2000, 5, 1))]
    df = spark.createDataFrame(rows, "k string, d date").withColumnRenamed("k", "_m")
    got = [tuple(r) for r in sfg.calendar_gaps_all(df, "d", ["_m"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_gaps(rows)
    overall = [r[0] for r in sfg.calendar_gaps_all(df, "d").collect()]
    assert {("all", m) for m in overall} == brute_gaps([("all", d) for _, d in rows]) and len(overall) == len(set(overall))
    assert sfg.calendar_gaps_all(df.limit(0), "d", ["_m"]).count() == 0 and sfg.calendar_gaps_all(df.limit(0), "d").count() == 0


# ---------------------------------------------------------------------------------------------
# Elastic nets of several features by key


@pytest.mark.parametrize("alpha", [0.0, 0.8, 1.0])
@pytest.mark.parametrize("reg", [0.0, 0.3, 40.0])
def test_elastic_net_by_key_equals_mllib(spark, alpha, reg):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(4)
    rows = []
    for key in ("a", "b", None):
        for i in range(60):
            x1, x2 = 1990 + i // 4, 1 + i % 4
            x3 = 0.5 * x1 + float(rng.normal())
            rows.append((key, x1, x2, x3, 100.0 + 7 * x1 - 30 * x2 + 2 * x3 + float(rng.normal()) * 20))
    df = spark.createDataFrame(rows, "k string, x1 int, x2 int, x3 double, y double")
    fits = {r.k: r for r in sfg.fit_elastic_net_by_key(df, ["x1", "x2", "x3"], "y", ["k"], reg=reg, alpha=alpha, sweeps=400).collect()}
    vec = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features")
    for key in ("a", "b", None):
        own = vec.transform(df.where(F.col("k").eqNullSafe(F.lit(key))))
        model = LinearRegression(featuresCol="features", labelCol="y", regParam=reg, elasticNetParam=alpha, maxIter=2000, tol=1e-12).fit(own)
        assert np.abs(np.array(fits[key].coefficients) - model.coefficients.toArray()).max() < 1e-6 * (1 + np.abs(model.coefficients.toArray()).max())
        assert fits[key].n == 60


def test_elastic_net_by_key_edges(spark):
    rows = [("const x", 1.0, 2.0, 5.0), ("const x", 1.0, 3.0, 7.0), ("const x", 1.0, 4.0, 9.0), ("const y", 1.0, 2.0, 5.0), ("const y", 2.0, 1.0, 5.0),
            ("one", 1.0, 1.0, 3.0), ("none", None, 1.0, 3.0), ("none", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, `x.1` double, w double, y double")
    got = {r.k: r for r in sfg.fit_elastic_net_by_key(df, ["x.1", "w"], "y", ["k"], reg=0.0).collect()}
    assert got["const x"].coefficients == pytest.approx([0.0, 2.0]) and got["const x"].intercept == pytest.approx(1.0)
    assert got["const y"].coefficients == [0.0, 0.0] and got["const y"].intercept == 5.0
    assert got["one"].coefficients == [0.0, 0.0] and got["one"].intercept == 3.0
    assert got["none"].n == 0 and got["none"].coefficients is None and got["none"].intercept is None
    points = spark.createDataFrame([("const x", 1.0, 10.0), ("const x", 1.0, None), ("new", 1.0, 1.0)], "k string, `x.1` double, w double")
    scored = sfg.forecast_elastic_net(df, ["x.1", "w"], "y", ["k"], reg=0.0, points=points).collect()
    assert sorted([(r.w, r.prediction and round(r.prediction, 6)) for r in scored], key=str) == [(10.0, 21.0), (None, None)]
    alone = sfg.forecast_elastic_net(df.where("k = 'const x'"), ["x.1", "w"], "y", reg=0.0).collect()
    assert [round(r.prediction, 6) for r in alone] == [5.0, 7.0, 9.0]


# ---------------------------------------------------------------------------------------------
# Saved models, reserved names


def test_saved_models_score_like_the_fitted_ones(spark, workdir):
    rows = [(k, y, y % 4, (100.0 + 10 * (y % 4)) * s) for k, s in (("a", 1.0), ("b", 1000.0), (None, 7.0)) for y in range(2000, 2012)]
    df = spark.createDataFrame(rows, "k string, year int, season int, v double")
    fitted = sfg.fit_gbt(df, "year", "v", 2007, keys=["k"], features=["season"])
    fitted.save(os.path.join(workdir, "model"))
    loaded = sfg.load_gbt(spark, os.path.join(workdir, "model"))
    assert (loaded.x, loaded.keys, loaded.features) == ("year", ("k",), ("season",))
    points = spark.createDataFrame([("a", 2030, 1), ("b", 2030, 2), (None, 2030, 3), ("new", 2030, 1)], "k string, year int, season int")
    a, b = ({r.k: r.prediction for r in m.score(points).collect()} for m in (fitted, loaded))
    assert a == b and a["new"] is None
    assert [round(a[k], 6) for k in ("a", "b", None)] == [110.0, 120000.0, 910.0]
    with pytest.raises(Exception):
        fitted.save(os.path.join(workdir, "model"))               # a saved model is not overwritten
    with pytest.raises(ValueError):
        fitted.score(points.withColumn("_trend", F.lit(1)))


def test_callers_may_use_names_like_the_operators_own(spark):
    rows = [("a", y, m, float(y), 1) for y in (2000, 2001) for m in (1, 2, 3)]
    df = spark.createDataFrame(rows, "_key0 string, year int, m int, _slope0 double, _last int")
    yearly = df.groupBy("_key0", "year").agg(F.sum("_slope0").alias("_slope0"), F.max("_last").alias("_last"))
    scored = sfg.forecast_linear(yearly, "year", "_slope0", 2001, keys=["_key0"], horizon=2003)
    assert scored.count() == 4 and scored.columns == ["_key0", "year", "_slope0", "_last", "prediction"]
    assert sfg.future_points(yearly.withColumnRenamed("_key0", "_periods"), "year", 2003, keys=["_periods"]).count() == 2
    monthly = df.select("_key0", F.make_date("year", "m", F.lit(1)).alias("_known"), F.col("m").alias("_divisor"), F.col("m").alias("_m"))
    assert sfg.impute_year(monthly, "_known", 2001, ["_divisor", "_m"], keys=["_key0"]).where("imputed").count() == 9
    assert sfg.calendar_gaps(monthly, "_known", 2001, keys=["_key0"]).count() == 9


def test_thresholds_in_date_form_on_text_columns(spark):
    df = spark.createDataFrame([("2000-01-0",), ("2000-01-01",), ("zz",)], "t string")
    got = df.select(sfg.split_label("t", "2000-01-01", dtype="string").alias("s"), sfg.known_until("t", "2000-01-01", "t", dtype="string").alias("k"))
    assert [tuple(r) for r in got.collect()] == [("train", "2000-01-0"), ("train", "2000-01-01"), ("test", None)]


# ---------------------------------------------------------------------------------------------
# Publishing


def jobs_of(spark, action):
    sc = spark.sparkContext
    group = f"count-{random.random()}"
    sc.setJobGroup(group, "jobs of one action")
    try:
        action()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setJobGroup(None, None)


def test_bounds_are_observed_while_writing(spark, workdir):
    df = spark.createDataFrame([(y, 1) for y in range(2000, 2010)], "year int, n int").repartition(4)
    plain = jobs_of(spark, lambda: sfg.publish_chart(df, workdir, "plain", order_by=["year"]))
    bounds = jobs_of(spark, lambda: sfg.publish_chart(df, workdir, "bounds", order_by=["year"], x_title="{min}..{max}", bounds_col="year"))
    assert bounds == plain                              # nothing is read again for the titles
    assert sfg.read_chart(spark, workdir, "bounds")[1].first().xtitle == "2000..2009"
    sfg.publish_chart(df.limit(0), workdir, "empty", x_title="{min}..{max}", bounds_col="year")
    assert sfg.read_chart(spark, workdir, "empty")[1].first().xtitle == ".."


def test_texts_like_the_null_marker_come_back(spark, workdir):
    texts = ["\\N", "\\\\N", "\\\\\\N", "N", "\\N\n", " \\N", "", None, "a\\N"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sfg.publish_chart(df, workdir, "marked", order_by=["id"])
    data, _ = sfg.read_chart(spark, workdir, "marked", schema=df.schema)
    assert [r.text for r in data.orderBy("id").collect()] == texts


def test_an_empty_key_is_an_error_and_null_is_none(spark, workdir):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    sfg.publish_chart(df, workdir, "keyed", partition_by=["k"])
    data, _ = sfg.read_chart(spark, workdir, "keyed", schema=df.schema)
    assert sorted(((r.k, r.v) for r in data.collect()), key=str) == [("a", 1), (None, 2)]
    with pytest.raises(Exception, match="can't name a chart"):
        sfg.publish_chart(df.union(spark.createDataFrame([("", 3)], "k string, v int")), workdir, "keyed", partition_by=["k"])
    assert sfg.read_chart(spark, workdir, "keyed", schema=df.schema)[0].count() == 2      # the old version stands
