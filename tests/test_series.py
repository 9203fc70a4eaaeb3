import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesforge import (before_filter, between_filter, combine_series, drop_columns, global_sums,
                         known_until, latest, require_not_null, rollup_series, sorted_series,
                         split_at, union_series)
from seriesforge.operators.series import count_where, with_total

from .golden import YEARLY


def d(y, m, day=1):
    return dt.date(y, m, day)


def series(spark, name, months, start=100):
    return spark.createDataFrame([(m, start + i) for i, m in enumerate(months)], f"month date, {name} int")


def test_rollup_grains(spark):
    rows = [(d(2000, m, 15), 1, 10) for m in range(1, 13)] + [(d(2001, 1, 3), 2, 20)]
    df = spark.createDataFrame(rows, "day date, a int, b int")
    monthly = rollup_series(df, "day", "month", {"a": "a", "b": "b"})
    assert monthly.count() == 13 and monthly.columns == ["month", "a", "b"]
    assert monthly.filter(F.col("month") == d(2001, 1)).first().b == 20
    q = {r.period: r.a for r in rollup_series(df, "day", "quarter", {"a": "a"}).collect()}
    assert q == {"2000-Q1": 3, "2000-Q2": 3, "2000-Q3": 3, "2000-Q4": 3, "2001-Q1": 2}
    y = rollup_series(df, "day", "year", {"a": "a", "n": F.count(F.lit(1))})
    assert dict(y.dtypes) == {"year": "int", "a": "bigint", "n": "bigint"}
    assert {r.year: (r.a, r.n) for r in y.collect()} == {2000: (12, 12), 2001: (2, 1)}


def test_rollup_keyed_and_timestamps(spark):
    df = spark.createDataFrame([("x", dt.datetime(2000, 1, 31, 23, 0), 1), ("x", dt.datetime(2000, 2, 1, 0, 0), 2),
                                ("y", dt.datetime(2000, 1, 2, 0, 0), 5), (None, dt.datetime(2000, 1, 2), 7)],
                               "k string, ts timestamp_ntz, v int")
    got = {(r.k, r.month): r.v for r in rollup_series(df, "ts", "month", {"v": "v"}, keys=["k"]).collect()}
    assert got == {("x", d(2000, 1)): 1, ("x", d(2000, 2)): 2, ("y", d(2000, 1)): 5, (None, d(2000, 1)): 7}


def test_combine_series_coalesces_key_and_nulls_total(spark):
    left = series(spark, "internationalPax", [d(2000, 1), d(2000, 2), d(2000, 3)])
    right = series(spark, "domesticPax", [d(2000, 2), d(2000, 3), d(2000, 4)], start=10)
    out = combine_series(left, right, "month", total="pax", parts=["internationalPax", "domesticPax"])
    rows = {r.month: (r.internationalPax, r.domesticPax, r.pax) for r in out.collect()}
    assert rows == {d(2000, 1): (100, None, None), d(2000, 2): (101, 10, 111),
                    d(2000, 3): (102, 11, 113), d(2000, 4): (None, 12, None)}
    zero = combine_series(left, right, "month", total="pax", missing_as_zero=True)
    assert {r.month: r.pax for r in zero.collect()}[d(2000, 4)] == 12


def test_combine_series_cutoff_is_pushed_into_both_inputs(spark, workdir):
    series(spark, "a", [d(1999, 11), d(1999, 12), d(2000, 1)]).write.parquet(workdir + "/l")
    series(spark, "b", [d(1999, 10), d(1999, 12), d(2000, 2)]).write.parquet(workdir + "/r")
    left, right = spark.read.parquet(workdir + "/l"), spark.read.parquet(workdir + "/r")
    out = combine_series(left, right, "month", total="t", before="2000-01-01")
    # right-only 1999-10 keeps its month (coalesced key); 2000 months are cut on both sides
    assert sorted(r.month for r in out.collect()) == [d(1999, 10), d(1999, 11), d(1999, 12)]
    plan = out._jdf.queryExecution().sparkPlan().toString()   # physical plan before AQE stages
    assert plan.count("LessThan(month,2000-01-01)") == 2       # one per scan


def test_count_where_matches_outer_join(spark):
    rows = [(d(2000, 1, 5), True), (d(2000, 1, 9), False), (d(2000, 2, 1), True), (d(2000, 3, 1), False)]
    df = spark.createDataFrame(rows, "day date, dom boolean")
    one = with_total(rollup_series(df, "day", "month", {"intl": count_where(~F.col("dom")),
                                                      "dom": count_where(F.col("dom"))}), "t", ["intl", "dom"])
    two = combine_series(rollup_series(df.filter(~F.col("dom")), "day", "month", {"intl": F.count(F.lit(1))}),
                         rollup_series(df.filter(F.col("dom")), "day", "month", {"dom": F.count(F.lit(1))}),
                         "month", total="t", parts=["intl", "dom"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


def test_int_overflow_is_an_error_not_a_wrap(spark):
    df = spark.createDataFrame([(d(2000, 1), 2**31 - 1, 1), (d(2000, 2), 1, 1)], "month date, a int, b int")
    with pytest.raises(Exception):
        with_total(df, "t", ["a", "b"]).collect()
    got = {r.month: r.t for r in with_total(df, "t", ["a", "b"], on_overflow="null").collect()}
    assert got == {d(2000, 1): None, d(2000, 2): 2}


def test_quality_filters(spark):
    df = spark.createDataFrame([(d(2000, 1), 1), (None, 2), (d(2000, 3), None)], "month date, v int")
    assert require_not_null(df, ["month", "v"]).count() == 1
    df = series(spark, "v", [d(1999, 12), d(2000, 1), d(2020, 1), d(2021, 12, 31)])
    assert before_filter(df, "month", "2020-01-01").count() == 2
    assert between_filter(df, "month", "2020-01-01", "2021-12-31").count() == 2
    lo, hi = split_at(df.withColumn("y", F.year("month")), "y", 2000)
    assert (lo.count(), hi.count()) == (2, 2)


def test_known_until_and_sorts(spark):
    df = spark.createDataFrame([(y, t) for y, (_, _, t) in YEARLY.items()], "year int, pax bigint")
    out = df.select("year", known_until("year", 2019, "pax").alias("paxInModel2019"))
    got = {r.year: r.paxInModel2019 for r in out.collect()}
    assert got[2019] == 930952 and got[2020] is None
    assert [r.year for r in sorted_series(df, "year").collect()] == sorted(YEARLY)
    assert [r.year for r in latest(df, "year", 3).collect()] == [2021, 2020, 2019]


def test_union_fills_missing_columns(spark):
    df = spark.createDataFrame([(2019, 5)], "year int, pax bigint")
    fut = spark.createDataFrame([(2020,), (2021,)], "year int")
    out = union_series(df, fut)
    assert out.columns == ["year", "pax"]
    assert sorted((r.year, r.pax) for r in out.collect()) == [(2019, 5), (2020, None), (2021, None)]


def test_drop_ignores_missing_and_prunes_scan(spark, workdir):
    df = spark.createDataFrame([("P", 1930, 1.0, 2.0)], "President string, Year int, GDP double, Receipts double")
    path = workdir + "/t"
    df.write.parquet(path)
    out = drop_columns(spark.read.parquet(path), ["President", "Receipts", "Nope"])
    assert out.columns == ["Year", "GDP"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "President" not in plan.split("ReadSchema")[-1]


def test_global_sums_one_row_even_when_empty(spark):
    df = spark.createDataFrame([], "pax int")
    r = global_sums(df, {"pax": "pax", "n": F.count(F.lit(1))}).collect()
    assert len(r) == 1 and r[0].pax is None and r[0].n == 0


def test_sort_splits_a_hot_value_and_is_deterministic(spark):
    # a third of the rows share one year; the range partitioner can split them on the tie-breakers
    rows = [(2000 if i % 3 == 0 else 2001 + i % 50, f"k{i:05d}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "year int, key string, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sorted_series(df, "year")
        sizes = [n for n in out.rdd.glom().map(len).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2000          # the 2000 rows of year 2000 are not all in one partition
    got = [(r.year, r.key) for r in out.collect()]
    assert got == sorted(got)
    top = latest(df, "year", 5).collect()
    assert [r.key for r in top] == [r.key for r in latest(df, "year", 5).collect()]


def test_bounds_follow_the_column_type(spark):
    import datetime

    from seriesforge import before_filter, between_filter, split_at
    q = spark.createDataFrame([("2000-Q1",), ("2000-Q3",), ("2001-Q1",)], "period string")
    assert before_filter(q, "period", "2000-Q3").count() == 1 and split_at(q, "period", "2000-Q3")[0].count() == 2
    t = spark.createDataFrame([(datetime.datetime(1999, 12, 31, 15),), (datetime.datetime(2000, 1, 1),)], "t timestamp")
    assert between_filter(t, "t", "1999-01-01", "1999-12-31").count() == 1
    assert between_filter(t, "t", datetime.date(1999, 1, 1), datetime.date(1999, 12, 31)).count() == 1
    assert before_filter(t, "t", "2000-01-01").count() == 1


def test_names_with_dots_blanks_and_percent(spark):
    from seriesforge import combine_series, global_sums, latest, require_not_null, rollup_series, sorted_series
    df = spark.createDataFrame([("2000-01-05", 1.5, "a"), ("2000-02-05", None, "b")], "`D.a y` string, `G.D.P.` double, `k %` string")
    df = df.selectExpr("cast(`D.a y` as date) as `D.a y`", "`G.D.P.`", "`k %`")
    assert require_not_null(df, ["G.D.P."]).count() == 1
    assert global_sums(df, {"s.": "G.D.P."}).first()[0] == 1.5
    r = rollup_series(df, "D.a y", "month", {"s.": "G.D.P."}, keys=["k %"], period_name="m.")
    assert latest(sorted_series(r, "m."), "m.", 1).first()["k %"] == "b"
    both = combine_series(r, r.withColumnRenamed("s.", "t."), ["m.", "k %"], total="x.", parts=["s.", "t."], before="2000-02-01")
    assert both.count() == 1 and both.first()["x."] == 3.0
