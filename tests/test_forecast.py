import pytest
from pyspark.sql import functions as F

from seriesforge import fit_trend, forecast_gbt, forecast_linear, future_points, rmse

from .golden import FITS, YEARLY


def yearly(spark, until=2021):
    return spark.createDataFrame([(y, t) for y, (_, _, t) in YEARLY.items() if y <= until], "year int, pax bigint")


@pytest.mark.parametrize("reg,last,slope,intercept", FITS)
def test_closed_form_matches_reference_fits(spark, reg, last, slope, intercept):
    fit = fit_trend(yearly(spark), "year", "pax", train=F.col("year") <= last, reg=reg).first()
    assert fit.n == last - 2000 + 1
    assert fit.slope == pytest.approx(slope, abs=1e-5)
    assert fit.intercept == pytest.approx(intercept, abs=0.05)


def test_closed_form_matches_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = yearly(spark)
    for reg, last in [(0.3, 2019), (0.3, 2021), (5000.0, 2019), (0.0, 2021)]:
        train = df.filter(F.col("year") <= last)
        lr = LinearRegression(maxIter=100, regParam=reg, elasticNetParam=0.8, labelCol="pax")
        model = lr.fit(VectorAssembler(inputCols=["year"], outputCol="features").transform(train))
        fit = fit_trend(df, "year", "pax", train=F.col("year") <= last, reg=reg).first()
        assert fit.slope == pytest.approx(model.coefficients[0], rel=1e-6, abs=1e-6)
        assert fit.intercept == pytest.approx(model.intercept, rel=1e-6)


def test_degenerate_series_keyed(spark):
    rows = [("line", y, 10 * y) for y in range(2000, 2010)] + [("flat", y, 7) for y in range(2000, 2010)]
    rows += [("one", 2005, 42), ("future_only", 2030, None)]
    df = spark.createDataFrame(rows, "k string, year int, v bigint")
    fits = {r.k: r for r in fit_trend(df, "year", "v", keys=["k"], reg=0.0).collect()}
    assert fits["line"].slope == pytest.approx(10.0) and fits["line"].intercept == pytest.approx(0.0, abs=1e-6)
    assert (fits["flat"].slope, fits["flat"].intercept) == (0.0, 7.0)
    assert (fits["one"].slope, fits["one"].intercept) == (0.0, 42.0)
    assert fits["future_only"].n == 0 and fits["future_only"].slope is None


def test_forecast_linear_futures_and_horizons(spark):
    df = yearly(spark)
    out = forecast_linear(df, "year", "pax", [2019, 2021], horizon=2026, names=["p2019", "p2021"])
    rows = {r.year: r for r in out.collect()}
    assert sorted(rows) == list(range(2000, 2027))
    assert rows[2026].pax is None
    assert rows[2020].p2019 == pytest.approx(879939.1, abs=0.1)
    assert rows[2026].p2019 == pytest.approx(952406.3, abs=0.1)
    # the 2021 horizon on the imputed year (406269 instead of five months' 203136)
    imputed = df.withColumn("pax", F.when(F.col("year") == 2021, F.lit(406269)).otherwise(F.col("pax")))
    two = {r.year: r.p2021 for r in forecast_linear(imputed, "year", "pax", [2019, 2021], horizon=2026,
                                                     names=["p2019", "p2021"]).collect()}
    assert two[2020] == pytest.approx(728309.1, abs=0.1) and two[2026] == pytest.approx(733532.1, abs=0.1)
    one = forecast_linear(df.filter("year <= 2019"), "year", "pax", 2019, horizon=2026, reg=0.5)
    p = {r.year: r.prediction for r in one.collect()}
    assert p[2020] == pytest.approx(879938.7, abs=0.1) and p[2026] == pytest.approx(952405.8, abs=0.1)


def test_forecast_keyed_null_key_and_no_cross_product(spark):
    rows = [(k, y, (i + 1) * y) for i, k in enumerate(["a", "b", None]) for y in range(2000, 2005)]
    df = spark.createDataFrame(rows, "k string, year int, v bigint")
    out = forecast_linear(df, "year", "v", 2004, keys=["k"], horizon=2006, reg=0.0)
    assert out.count() == 3 * 7
    got = {(r.k, r.year): r.prediction for r in out.collect()}
    assert got[(None, 2006)] == pytest.approx(3 * 2006, rel=1e-9)
    assert got[("b", 2005)] == pytest.approx(2 * 2005, rel=1e-9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_future_points_and_rmse(spark):
    df = spark.createDataFrame([("a", 2000, 1), ("a", 2003, 1), ("b", 2010, 1)], "k string, year int, v int")
    fut = {(r.k, r.year) for r in future_points(df, "year", 2005, keys=["k"]).collect()}
    assert fut == {("a", 2004), ("a", 2005)}
    scored = spark.createDataFrame([("a", 3.0, 1.0), ("a", 1.0, 1.0), ("b", None, 2.0)], "k string, y double, prediction double")
    r = {x.k: (x.rmse, x.n) for x in rmse(scored, "y", keys=["k"]).collect()}
    assert r["a"][0] == pytest.approx(2 ** 0.5) and r["a"][1] == 2 and r["b"] == (None, 0)


def test_gbt_reference_shape(spark):
    df = yearly(spark, 2019)
    scored, model = forecast_gbt(df, "year", "pax", train_until=2015, seed=1)
    p = {r.year: r.prediction for r in scored.collect()}
    # trees don't extrapolate: every later year gets the last training year's leaf
    assert all(p[y] == pytest.approx(803579.0) for y in (2016, 2017, 2018, 2019))
    test = scored.filter("year > 2015")
    assert rmse(test, "pax").first().rmse == pytest.approx(82875.608, abs=1e-3)
    assert len(model.stages) == 2       # one continuous feature: no indexer


def test_empty_test_split_is_tolerated(spark):
    # Q19: a gold table cut before 2020 has no row after 2019; scoring and RMSE still work
    df = yearly(spark, 2019)
    scored = forecast_linear(df, "year", "pax", 2019)
    err = rmse(scored, "pax", rows=F.col("year") > 2019).first()
    assert err.n == 0 and err.rmse is None
    assert forecast_linear(df.filter("year > 2019"), "year", "pax", 2019).count() == 0


def test_gbt_year_is_continuous_with_few_years(spark):
    for first in (2013, 2010):                  # 3 and 6 training years
        df = spark.createDataFrame([(y, 100 * y) for y in range(first, 2020)], "year int, v bigint")
        scored, _ = forecast_gbt(df, "year", "v", train_until=2015)
        p = {r.year: r.prediction for r in scored.collect()}
        assert all(p[y] == pytest.approx(100 * min(y, 2015)) for y in range(first, 2020))


def test_gbt_many_keys_with_distinct_levels(spark):
    rows = [(k, y, 1000 * k + 3 * (y - 2000) + (y % 2)) for k in range(200) for y in range(2000, 2010)]
    df = spark.createDataFrame(rows + [(None, 2001, 5), (999, 2012, 7)], "k int, year int, v bigint")
    scored, _ = forecast_gbt(df, "year", "v", train_until=2009, keys=["k"])
    assert rmse(scored.filter("k < 200"), "v").first().rmse < 5        # levels span 200,000
    odd = {r.k: r.prediction for r in scored.filter("k is null or k = 999").collect()}
    assert odd[None] == pytest.approx(5.0, abs=2) and odd[999] is None


def test_gbt_indexed_extra_feature(spark):
    df = spark.createDataFrame([(y, y % 2, 50 * (y % 2)) for y in range(2000, 2012)], "year int, odd int, v bigint")
    scored, model = forecast_gbt(df, "year", "v", train_until=2009, features=["odd"])
    assert len(model.stages) == 4
    assert all(r.prediction == pytest.approx(r.v, abs=1) for r in scored.collect())


def test_keyed_forecast_keeps_fractional_periods(spark):
    df = spark.createDataFrame([("a", 2000.5, 1.0), ("a", 2001.5, 2.0), ("a", 2002.5, 3.0)], "k string, x double, y double")
    got = sorted((r.x, r.y, round(r.prediction, 6)) for r in
                 forecast_linear(df, "x", "y", 2010, keys=["k"], horizon=2004, reg=0.0).collect() if r.y is not None)
    assert got == [(2000.5, 1.0, 1.0), (2001.5, 2.0, 2.0), (2002.5, 3.0, 3.0)]
    future = [r.x for r in forecast_linear(df, "x", "y", 2010, keys=["k"], horizon=2004, reg=0.0).collect() if r.y is None]
    assert sorted(future) == [2003.0, 2004.0]


def test_scoring_chosen_years_with_a_fitted_model(spark):
    from seriesforge import score_gbt
    _, model = forecast_gbt(yearly(spark, 2019), "year", "pax", train_until=2015, seed=1)
    points = spark.createDataFrame([(2003,), (2040,)], "year int")
    got = {r.year: r.prediction for r in score_gbt(model, points, "year").collect()}
    assert got[2003] == pytest.approx(YEARLY[2003][2]) and got[2040] == pytest.approx(803579.0)


def test_elastic_net_of_several_features(spark):
    from seriesforge import fit_elastic_net, score_elastic_net
    rows = [(float(a), float((a * 7) % 11), 3.0 * a - 2.0 * ((a * 7) % 11) + 5.0) for a in range(40)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "`a.b` double, c double, y double")
    model = fit_elastic_net(df, ["a.b", "c"], "y", reg=0.0)
    got = score_elastic_net(model, spark.createDataFrame([(100.0, 4.0)], "`a.b` double, c double"), ["a.b", "c"]).first()
    assert got.prediction == pytest.approx(300.0 - 8.0 + 5.0, abs=1e-6)
    # one feature: the closed form and this agree
    one = fit_elastic_net(yearly(spark), ["year"], "pax", train=F.col("year") <= 2019)
    fit = fit_trend(yearly(spark), "year", "pax", train=F.col("year") <= 2019).first()
    assert one.stages[-1].coefficients[0] == pytest.approx(fit.slope, rel=1e-6)
