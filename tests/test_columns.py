import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesforge import (bounds, column_bounds, column_metadata, rollup_series, with_headers,
                         with_metadata, with_metadata_all)


def frame(spark):
    return spark.createDataFrame([(dt.date(2000, 1, 1), 5, 1.5), (dt.date(2001, 6, 1), 7, 98.4)],
                                 "month date, pax int, `G.D.P.` double")


def test_headers_set_in_one_projection(spark):
    df = with_headers(frame(spark), {"month": "Month", "pax": "Passengers", "G.D.P.": "GDP"})
    assert column_metadata(df, "month") == {"header": "Month"}
    assert column_metadata(df, "G.D.P.") == {"header": "GDP"}
    assert df.columns == ["month", "pax", "G.D.P."]
    # one Project node for all columns, not one per column
    assert df._jdf.queryExecution().analyzed().toString().count("Project") == 1


def test_metadata_merge_keeps_existing_keys(spark):
    df = with_metadata(frame(spark), {"pax": {"unit": "000s"}})
    df = with_headers(df, {"pax": "Passengers"})
    assert column_metadata(df, "pax") == {"unit": "000s", "header": "Passengers"}
    df = with_headers(df, {"pax": "Pax"})   # overwrite one key, keep the other
    assert column_metadata(df, "pax") == {"unit": "000s", "header": "Pax"}


def test_metadata_all_columns(spark):
    df = with_metadata_all(frame(spark), "source", "bts")
    assert all(f.metadata == {"source": "bts"} for f in df.schema.fields)


def test_metadata_survives_rename_filter_sort_and_roll_ups_but_not_other_aggregates(spark):
    df = with_headers(frame(spark), {"pax": "Passengers", "month": "Month"})
    kept = df.withColumnRenamed("pax", "p").filter("p > 0").orderBy("month")
    assert column_metadata(kept, "p") == {"header": "Passengers"}
    agg = rollup_series(df, "month", "year", {"pax": "pax"})
    assert column_metadata(agg, "pax") == {"header": "Passengers"} and column_metadata(agg, "year") == {"header": "Year"}
    assert column_metadata(df.agg(F.sum("pax").alias("pax")), "pax") == {}


def test_name_resolution(spark):
    df = frame(spark)
    assert column_metadata(df, "PAX") == {}          # case-insensitive like Spark's default
    with pytest.raises(KeyError):
        column_metadata(df, "nope")
    with pytest.raises(KeyError):
        with_headers(df, {"nope": "x"})


def test_bounds_single_job_and_odd_names(spark):
    df = frame(spark)
    assert bounds(df, "month") == (dt.date(2000, 1, 1), dt.date(2001, 6, 1))
    assert bounds(df, "G.D.P.") == (1.5, 98.4)
    assert column_bounds(df, "pax").columns == ["min_value", "max_value"]
