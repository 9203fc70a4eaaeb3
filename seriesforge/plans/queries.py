"""The registered queries: every operator of the library run over the driver tables.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over whole tables. The market
series mirror the reference's two traffic files: orders of customers in one home region
(``domestic``) and of all others (``international``), counted per month. Queries that exercise a
sink (CSV files, gold table, chart bundle) write below the session's shared folder first and
return the read-back frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.columns import column_bounds, with_headers, with_metadata_all
from ..operators.forecast import (fit_gbt, forecast_elastic_net, forecast_gbt, forecast_linear, future_points, load_gbt,
                                  rmse)
from ..operators.impute import calendar_gaps, calendar_gaps_all, impute_year
from ..operators.series import (before_filter, between_filter, combine_series, count_where,
                                drop_columns, global_sums, grain_of, known_until, latest, require_not_null,
                                rollup_grains, rollup_series, sorted_series, split_label, union_series, with_total)
from ..session import materialize, scratch_path
from ..sources.csv import read_series_csv, read_table_csv, write_series_csv
from ..sources.publish import publish_chart, read_chart
from ..sources.tables import driver_table, load_table, save_table

# Parameters of the registered queries (the oracle SQL uses the same values).
HOME_REGION = "AMERICA"
GOLD_CUTOFF = "2001-01-01"          # monthly gold table keeps months before this date
COMBINE_BEFORE = "1998-07-01"       # combine_before keeps months before this date
CUTOFF_DATE = "1998-01-01"
RANGE_LOW, RANGE_HIGH = "1999-01-01", "1999-12-31"
IMPUTE_YEAR = 2001
KNOWN_UNTIL = 1999
SPLIT_YEAR = 1998
HORIZON = 2007
TRAIN_UNTIL = 2000
HORIZONS = (1999, 2000)
IMPUTED_HORIZONS = (1999, 2001)     # the later model trains on the imputed partial year
RMSE_TRAIN_UNTIL = 1998
GBT_TRAIN_UNTIL = 1999               # five training years
LATEST_N = 15
MONEY = DecimalType(18, 2)
MONEY_SUM = DecimalType(38, 2)
SCORE = DecimalType(38, 4)
SCORE_DIGITS = 4


def money_sum(c: str):
    """Exact sum of a money column (two decimals) — same value in any engine."""
    return F.sum(F.col(c).cast(MONEY)).cast(MONEY_SUM)


def score(c):
    return F.round(c, SCORE_DIGITS).cast(SCORE)


# ---------------------------------------------------------------------------------------------
# Shared inputs


def orders_market(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's segment and region, and the ``domestic`` flag.

    orders ⋈ customer is the one large join: a sort-merge join on the customer key whose skewed
    keys AQE splits; the planner broadcasts a side only when its size is under the broadcast
    threshold (at sf0.1 the customer table is), and so for nation and region, from their file sizes.
    """
    o = driver_table(spark, sf, "orders")
    c = driver_table(spark, sf, "customer")
    n, r = driver_table(spark, sf, "nation"), driver_table(spark, sf, "region")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority",
                     "c_mktsegment", "r_name", (F.col("r_name") == F.lit(HOME_REGION)).alias("domestic")))


def gold_monthly(spark: SparkSession, sf: str, cutoff: str | None = GOLD_CUTOFF) -> DataFrame:
    """C1: the international and domestic monthly order series, combined on month, with total,
    cut before ``cutoff`` (unsorted; sort once at the end).

    Both series come from the same table, so they are built by one conditional aggregate (one
    scan, one shuffle): a series with no order in a month is NULL there, as after a full outer
    join. The cut is a month start, so it is applied to the raw order date, where it reaches the
    Parquet scan, instead of to the derived month.
    """
    m = orders_market(spark, sf)
    if cutoff is not None:
        m = before_filter(m, "o_orderdate", cutoff)
    g = rollup_series(m, "o_orderdate", "month", {"international": count_where(~F.col("domestic")),
                                                 "domestic": count_where(F.col("domestic"))})
    return with_total(g, "total", ["international", "domestic"])


MEASURES3 = {"international": "international", "domestic": "domestic", "total": "total"}


def yearly_gold(spark: SparkSession, sf: str, cutoff: str | None = None) -> DataFrame:
    return rollup_series(gold_monthly(spark, sf, cutoff), "month", "year", MEASURES3)


def segment_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly orders and urgent orders per market segment."""
    return rollup_series(orders_market(spark, sf), "o_orderdate", "month",
                         {"n_orders": F.count(F.lit(1)),
                          "n_urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT")},
                         keys=["c_mktsegment"])


def region_yearly(spark: SparkSession, sf: str) -> DataFrame:
    return rollup_series(orders_market(spark, sf), "o_orderdate", "year",
                         {"n_orders": F.count(F.lit(1))}, keys=["r_name"])


def segment_imputed(spark: SparkSession, sf: str, method: str) -> DataFrame:
    return impute_year(segment_monthly(spark, sf), "month", IMPUTE_YEAR, ["n_orders", "n_urgent"],
                       keys=["c_mktsegment"], method=method, copies={"n_orders_reported": "n_orders"})


# ---------------------------------------------------------------------------------------------
# Registered queries


def q_combine_monthly(spark, sf):
    df = gold_monthly(spark, sf)
    df = with_headers(df, {"month": "Month", "international": "International orders",
                           "domestic": "Domestic orders", "total": "Orders"})
    return sorted_series(df, "month")


def _orders_and_shipments(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Orders per month and status, and shipped lines per month and status, over whole tables:
    orders have a status that lines lack, lines ship after the last order."""
    left = rollup_series(driver_table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "o_orderdate",
                         "month", {"orders": F.count(F.lit(1))}, keys=["status"])
    right = rollup_series(driver_table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "status"), "l_shipdate",
                          "month", {"shipments": F.count(F.lit(1))}, keys=["status"])
    return left, right


def q_outer_join_series(spark, sf):
    """J1 on two sources; each side has (month, status) pairs the other lacks. Both roll-ups leave
    their rows hash-partitioned on the join columns, so the full outer join reuses that."""
    left, right = _orders_and_shipments(spark, sf)
    return combine_series(left, right, ["month", "status"], total="total", parts=["orders", "shipments"])


def q_combine_before(spark, sf):
    """C1's cut on a composite key: both sides cut before the join, on the period."""
    left, right = _orders_and_shipments(spark, sf)
    return combine_series(left, right, ["status", "month"], total="total", parts=["orders", "shipments"],
                          missing_as_zero=True, before=COMBINE_BEFORE, period="month")


def q_quoted_names(spark, sf):
    """Names with dots, blanks and percent signs through roll-up, filter, imputation, forecast and sort."""
    df = orders_market(spark, sf).withColumnsRenamed({"o_totalprice": "Total.Price", "c_mktsegment": "Market Seg.%",
                                                      "o_orderdate": "Order.Date"})
    df = require_not_null(df, ["Total.Price", "Market Seg.%"])
    df = before_filter(df, "Order.Date", GOLD_CUTOFF)
    monthly = rollup_series(df, "Order.Date", "month", {"No. %": F.count(F.lit(1))}, keys=["Market Seg.%"], period_name="Mo.")
    full = impute_year(monthly, "Mo.", IMPUTE_YEAR, ["No. %"], keys=["Market Seg.%"], flag=None)
    yearly = rollup_series(full, "Mo.", "year", {"No. %": "No. %"}, keys=["Market Seg.%"], period_name="Yr.")
    scored = forecast_linear(yearly, "Yr.", "No. %", TRAIN_UNTIL, keys=["Market Seg.%"], horizon=HORIZON, names=["Pred. %"])
    scored = scored.withColumn("Pred. %", score(F.col("`Pred. %`")))
    return sorted_series(scored, "Market Seg.%", "Yr.")


def q_monthly_rollup(spark, sf):
    return rollup_series(orders_market(spark, sf), "o_orderdate", "month",
                         {"n_orders": F.count(F.lit(1)), "revenue": money_sum("o_totalprice")},
                         keys=["r_name"])


def q_quarterly_rollup(spark, sf):
    return _quarterly(gold_monthly(spark, sf))


def _quarterly(gold: DataFrame) -> DataFrame:
    df = rollup_series(gold, "month", "quarter", MEASURES3)
    df = with_headers(df, {"period": "Quarter", "total": "Orders",
                           "international": "International orders", "domestic": "Domestic orders"})
    return sorted_series(df, "period")


def q_yearly_rollup(spark, sf):
    df = with_headers(yearly_gold(spark, sf, GOLD_CUTOFF), {"year": "Year", "total": "Orders"})
    return sorted_series(df, "year")


def q_yearly_rollup_provenance(spark, sf):
    imputed = segment_imputed(spark, sf, "spread")
    return rollup_series(imputed, "month", "year",
                         {"n_orders_reported": "n_orders_reported", "n_orders": "n_orders",
                          "n_urgent": "n_urgent"}, keys=["c_mktsegment"])


def q_global_sums(spark, sf):
    li = driver_table(spark, sf, "lineitem")
    return global_sums(li, {"n_lines": F.count(F.lit(1)),
                            "total_quantity": F.sum(F.col("l_quantity").cast("bigint")),
                            "total_price": money_sum("l_extendedprice")})


def q_column_bounds(spark, sf):
    b = column_bounds(driver_table(spark, sf, "orders"), "o_orderdate")
    return b.select(F.to_date("min_value").alias("min_value"), F.to_date("max_value").alias("max_value"))


def q_quality_not_null(spark, sf):
    o = driver_table(spark, sf, "orders")
    raw = o.select(F.when(F.col("o_orderstatus") != "P", F.trunc(F.to_date("o_orderdate"), "month")).alias("month"),
                   F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("value"))
    clean = require_not_null(raw, ["month", "value"])
    return rollup_series(clean, "month", "month", {"n_orders": F.count(F.lit(1)), "revenue": money_sum("value")})


def q_cutoff_filter(spark, sf):
    o = before_filter(driver_table(spark, sf, "orders"), "o_orderdate", CUTOFF_DATE)
    return rollup_series(o, "o_orderdate", "month", {"n_orders": F.count(F.lit(1))})


def q_range_filter(spark, sf):
    o = between_filter(driver_table(spark, sf, "orders"), "o_orderdate", RANGE_LOW, RANGE_HIGH)
    return rollup_series(o, "o_orderdate", "month", {"n_orders": F.count(F.lit(1))})


def q_project_drop(spark, sf):
    o = drop_columns(driver_table(spark, sf, "orders"),
                     ["o_custkey", "o_orderstatus", "o_orderpriority", "o_comment"])
    return sorted_series(o.withColumn("o_orderdate", F.to_date("o_orderdate")), "o_orderkey")


def q_case_known_range(spark, sf):
    y = yearly_gold(spark, sf)
    return y.select("year", "total", known_until("year", KNOWN_UNTIL, "total").alias("known_total"))


def q_train_test_split(spark, sf):
    """Both sides of the split in one aggregate (two filtered aggregates would read twice)."""
    y = yearly_gold(spark, sf).withColumn("split", split_label("year", SPLIT_YEAR))
    return (y.filter(F.col("split").isNotNull()).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_years"), F.sum("total").alias("total")))


def q_sorted_series(spark, sf):
    return sorted_series(q_monthly_rollup(spark, sf).select("r_name", "month", "n_orders"), "r_name", "month", position="position")


def q_latest_n(spark, sf):
    return latest(gold_monthly(spark, sf, cutoff=None), "month", LATEST_N)


def q_union_missing_columns(spark, sf):
    # The yearly series feeds both sides of the union; computed once, then read twice.
    y = materialize(yearly_gold(spark, sf))
    return union_series(y, future_points(y, "year", HORIZON))


def q_future_years(spark, sf):
    return future_points(region_yearly(spark, sf), "year", HORIZON, keys=["r_name"])


def q_calendar_gaps(spark, sf):
    return calendar_gaps(segment_monthly(spark, sf), "month", IMPUTE_YEAR, keys=["c_mktsegment"])


def q_csv_month_ingest(spark, sf):
    series = rollup_series(driver_table(spark, sf, "orders"), "o_orderdate", "month",
                           {"orders": F.count(F.lit(1))})
    path = scratch_path(spark, "csv-month")
    write_series_csv(series, path, "month", "orders")
    # The published files end with blank lines and a source line, in the same file as the data.
    lines = spark.read.text(path)
    path = scratch_path(spark, "csv-month-footer")
    # header lines come first in a file, so every output file starts with one of its own
    body = lines.where(~F.col("value").startswith("month,"))
    head = spark.createDataFrame([("month,orders",)], "value string")
    foot = spark.createDataFrame([("",), ("",), ("SOURCE: orders table, monthly counts",)], "value string")
    # a month column is a few hundred lines: one file
    parts = [d.withColumn("at", F.lit(i)) for i, d in enumerate((head, body, foot))]
    (parts[0].union(parts[1]).union(parts[2]).coalesce(1).sortWithinPartitions("at").select("value").write.text(path))
    # Read with the schema's generic name, then rename to the series name (metadata follows).
    return read_series_csv(spark, path, value_type=LongType()).withColumnRenamed("value", "orders")


CSV_HEADER_NAMES = ["Nation.Key", "Nation Name", "Customers %", "Balance (USD)"]
CSV_TYPED_SCHEMA = StructType([
    StructField("nation_key", IntegerType()), StructField("nation", StringType()),
    StructField("customers", LongType()), StructField("balance", MONEY_SUM)])


def q_csv_header_ingest(spark, sf):
    n = driver_table(spark, sf, "nation")
    c = driver_table(spark, sf, "customer")
    per_nation = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"),
                                             money_sum("c_acctbal").alias("balance"))
    table = n.join(per_nation, n.n_nationkey == per_nation.c_nationkey, "left").select(
        F.col("n_nationkey").alias(CSV_HEADER_NAMES[0]), F.col("n_name").alias(CSV_HEADER_NAMES[1]),
        F.coalesce("customers", F.lit(0)).alias(CSV_HEADER_NAMES[2]), F.col("balance").alias(CSV_HEADER_NAMES[3]))
    path = scratch_path(spark, "csv-table")
    table.write.option("header", True).csv(path)
    return read_table_csv(spark, path, schema=CSV_TYPED_SCHEMA)


def q_gold_roundtrip(spark, sf):
    """Save the monthly gold table partitioned by year (later reads of a year slice prune to one
    directory), load it, save a change of that same table over itself, load it, roll it up by year."""
    gold = gold_monthly(spark, sf, cutoff=None).withColumn("y", F.year("month"))
    path = save_table(gold, scratch_path(spark, "gold-monthly"), partition_by=["y"])
    changed = load_table(spark, path).withColumn("total", F.col("total") + 1)
    save_table(changed, path, partition_by=["y"], keep=1)
    return rollup_series(load_table(spark, path), "month", "year", MEASURES3)


def q_chart_data_export(spark, sf):
    chart = _quarterly(gold_monthly(spark, sf, cutoff=None))
    out = scratch_path(spark, "charts")
    publish_chart(chart, out, "orders-per-quarter", order_by=["period"], title="Orders per quarter",
                  x_title="Period from {min} to {max}", y_title="Orders", bounds_col="period")
    data, _ = read_chart(spark, out, "orders-per-quarter", schema=chart.schema, position="position")
    return data


def q_chart_text_roundtrip(spark, sf):
    """Whole texts (line breaks, quotes, outer blanks) and times of events through a chart's CSV, with rows of other kinds for
    what CSV can't tell apart by itself: NULL, empty texts and texts like the NULL marker."""
    time = F.lit(None).cast("timestamp_ntz")
    docs = driver_table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text", time.alias("ts"))
    turns = driver_table(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 100000 + F.col("turn")).alias("id"),
        F.concat(F.lit('  "'), F.col("text"), F.lit('"\r\n ')).alias("text"), time.alias("ts"))
    events = driver_table(spark, sf, "events").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    odd = driver_table(spark, sf, "nation").select(F.explode(F.array(
        F.struct(F.lit("null").alias("kind"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("empty").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit("marker").alias("kind"), F.concat(F.repeat(F.lit("\\"), F.col("n_nationkey") + 1), F.lit("N")).alias("text")))).alias("o"),
        F.col("n_nationkey").cast("bigint").alias("id")).select("o.kind", "id", "o.text", time.alias("ts"))
    text = docs.unionByName(turns).unionByName(events).unionByName(odd)
    out = scratch_path(spark, "charts")
    publish_chart(text, out, "texts", order_by=["kind", "id"])
    data, _ = read_chart(spark, out, "texts", schema=text.schema)
    return data.select("kind", "id", F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("digest"),
                       F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


CHART_TITLE = "Orders per year"
CHART_X_TITLE = "Year {min} - {max}"
CHART_Y_TITLE = "Orders (count)"
CHART_HEADERS = {"month": "Month", "international": "International orders",
                 "domestic": "Domestic orders", "total": "Orders"}


CHART_SOURCE = "orders"


def q_chart_descriptor(spark, sf):
    """Headers are set once, on the monthly series; the yearly chart's descriptor has them from there."""
    # one entry on every column first, then headers merged on top (both kept in the descriptor)
    monthly = with_headers(with_metadata_all(gold_monthly(spark, sf, cutoff=None), "source", CHART_SOURCE), CHART_HEADERS)
    chart = rollup_series(monthly, "month", "year", MEASURES3)
    out = scratch_path(spark, "charts")
    publish_chart(chart, out, "orders-per-year", order_by=["year"], title=CHART_TITLE,
                  x_title=CHART_X_TITLE, y_title=CHART_Y_TITLE, bounds_col="year")
    _, desc = read_chart(spark, out, "orders-per-year")
    return desc.select(F.posexplode("columns").alias("position", "col"), "title", "xtitle", "ytitle", "xscale") \
               .select("position", F.col("col.key").alias("key"), F.col("col.header").alias("header"),
                       F.col("col.source").alias("source"), "title", "xtitle", "ytitle", "xscale")


def q_impute_year(spark, sf):
    return segment_imputed(spark, sf, "spread")


def q_impute_year_mean(spark, sf):
    return segment_imputed(spark, sf, "mean")


def q_forecast_linear(spark, sf):
    scored = forecast_linear(region_yearly(spark, sf), "year", "n_orders", TRAIN_UNTIL,
                             keys=["r_name"], horizon=HORIZON)
    return scored.withColumn("prediction", score(F.col("prediction")))


def q_forecast_two_horizons(spark, sf):
    names = [f"prediction_{c}" for c in HORIZONS]
    scored = forecast_linear(region_yearly(spark, sf), "year", "n_orders", list(HORIZONS),
                             keys=["r_name"], horizon=HORIZON, names=names)
    return scored.select("r_name", "year", "n_orders",
                         known_until("year", KNOWN_UNTIL, "n_orders").alias(f"known_{KNOWN_UNTIL}"),
                         *[score(F.col(n)).alias(n) for n in names])


def q_rmse_by_key(spark, sf):
    scored = forecast_linear(region_yearly(spark, sf), "year", "n_orders", RMSE_TRAIN_UNTIL, keys=["r_name"])
    test_years = F.col("year") > RMSE_TRAIN_UNTIL
    return rmse(scored, "n_orders", keys=["r_name"], rows=test_years).withColumn("rmse", score(F.col("rmse")))


def gold_all_imputed(spark: SparkSession, sf: str) -> DataFrame:
    """The combined monthly series without cut-off, its partial last year filled in (spread rule),
    with the reported total kept apart (NULL on imputed months)."""
    return impute_year(gold_monthly(spark, sf, cutoff=None), "month", IMPUTE_YEAR, ["international", "domestic", "total"],
                       copies={"total_reported": "total"})


def q_impute_gold_all(spark, sf):
    return gold_all_imputed(spark, sf)


def q_forecast_imputed_horizons(spark, sf):
    """Yearly sums of the imputed series, one trend on the years up to 1999 and one including
    the imputed year, both scored on every year up to the horizon."""
    yearly = rollup_series(gold_all_imputed(spark, sf), "month", "year",
                           {"total_reported": "total_reported", "total": "total",
                            "international": "international", "domestic": "domestic"})
    names = [f"prediction_{c}" for c in IMPUTED_HORIZONS]
    scored = forecast_linear(yearly, "year", "total", list(IMPUTED_HORIZONS), horizon=HORIZON, names=names)
    out = drop_columns(scored, ["international", "domestic"]).withColumn(
        f"known_{KNOWN_UNTIL}", known_until("year", KNOWN_UNTIL, "total"))
    for n in names:
        out = out.withColumn(n, score(F.col(n)))
    return with_headers(out, {"year": "Year", "total_reported": "Reported orders", "total": "Orders",
                              f"known_{KNOWN_UNTIL}": f"Orders used in model {KNOWN_UNTIL}"})


DASHBOARD = ("month", "quarter", "year")


def dashboard_grains(spark: SparkSession, sf: str) -> DataFrame:
    """All three grains of the gold series from one aggregate (grouping sets over its months)."""
    return rollup_grains(gold_monthly(spark, sf, cutoff=None), "month", DASHBOARD, MEASURES3)


def q_chart_dashboard(spark, sf):
    """One gold table, three charts (month, quarter, year), each its own bundle; the bundles are
    read back and summarised as (chart, rows, orders)."""
    grains = materialize(dashboard_grains(spark, sf))      # read by three charts: computed once
    out = scratch_path(spark, "dashboard")
    summaries = []
    for grain in DASHBOARD:
        chart = grain_of(grains, grain)
        key = chart.columns[0]
        publish_chart(chart, out, f"orders-per-{grain}", order_by=[key], title=f"Orders per {grain}",
                      x_title="From {min} to {max}", bounds_col=key)
        data, _ = read_chart(spark, out, f"orders-per-{grain}", schema=chart.schema)
        summaries.append(data.agg(F.lit(grain).alias("chart"), F.count(F.lit(1)).alias("n_rows"),
                                  F.sum("total").alias("total")))
    result = summaries[0]
    for other in summaries[1:]:
        result = result.unionByName(other)
    return result


def q_rollup_grains(spark, sf):
    """Orders and revenue per region in months, quarters and years, from one aggregate."""
    return rollup_grains(orders_market(spark, sf), "o_orderdate", DASHBOARD,
                         {"n_orders": F.count(F.lit(1)), "revenue": money_sum("o_totalprice")}, keys=["r_name"])


def q_csv_rejects(spark, sf):
    """Monthly counts per priority as CSV files in which some months, some numbers and some of both are unreadable, some cells are
    empty, and which end in a source line: the lines the reader accepts and those it rejects, with the reason."""
    series = materialize(rollup_series(driver_table(spark, sf, "orders"), "o_orderdate", "month", {"orders": F.count(F.lit(1))},
                                       keys=["o_orderpriority"]))
    # the last digit of a count says what becomes of its line
    digit, good = F.col("orders") % 10, F.date_format("month", "MMMM yyyy")
    month = F.when(digit.isin(1, 3), F.date_format("month", "yyyy/MM")).when(digit == 5, F.lit("")).otherwise(good)
    number = F.when(digit.isin(2, 3), F.lit("n/a")).when(digit == 7, F.lit("")).otherwise(F.col("orders").cast("string"))
    body = series.select(F.lit(1).alias("at"), F.concat(F.lit('"'), month, F.lit('","'), number, F.lit('"')).alias("value"))
    foot = series.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(2).alias("at"), F.explode(F.array(F.lit(""), F.concat(F.lit("SOURCE: "), "o_orderpriority", F.lit(", months")))).alias("value"))
    head = spark.range(1).select(F.lit(0).alias("at"), F.lit("month,orders").alias("value"))
    path = scratch_path(spark, "csv-rejects")
    # some hundred lines: one file, the header first
    head.union(body).union(foot).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    rows, rejects = read_series_csv(spark, path, value_name="orders", value_type=LongType(), rejects=True)
    return rows.select(F.lit("row").alias("kind"), "month", "orders", F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("reason"),
                       F.lit(True).alias("from_file")).unionByName(rejects.select(
                           F.lit("reject").alias("kind"), F.lit(None).cast("date").alias("month"), F.lit(None).cast("bigint").alias("orders"),
                           "line", "reason", F.col("file").contains("csv-rejects").alias("from_file")))


def q_calendar_gaps_all(spark, sf):
    """Months without an order between the first and the last of each nation and priority, over all years, and none for
    segments, which order every month."""
    market = driver_table(spark, sf, "orders").join(driver_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fine = F.concat_ws(" ", F.col("c_nationkey").cast("string"), "o_orderpriority", "o_orderstatus")
    series = market.select(F.explode(F.array(fine, "c_mktsegment")).alias("series"), "o_orderdate")
    return calendar_gaps_all(series, "o_orderdate", ["series"])


QUARTER_TRAIN_UNTIL = 1999
RIDGE = 50.0


def region_quarters(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per region and quarter, with year and quarter as numbers."""
    q = rollup_series(orders_market(spark, sf), "o_orderdate", "quarter", {"n_orders": F.count(F.lit(1))}, keys=["r_name"])
    return q.select("r_name", F.substring("period", 1, 4).cast("int").alias("year"), F.substring("period", 7, 1).cast("int").alias("quarter"), "n_orders")


def q_forecast_elastic_net(spark, sf):
    """Two features, one model a region: ridge and elastic net from the same moments, scored on every quarter."""
    series = region_quarters(spark, sf)
    train = F.col("year") <= QUARTER_TRAIN_UNTIL
    ridge = forecast_elastic_net(series, ["year", "quarter"], "n_orders", ["r_name"], train, reg=RIDGE, alpha=0.0)
    return ridge.withColumn("prediction", score(F.col("prediction")))


def q_forecast_gbt(spark, sf):
    scored, _ = forecast_gbt(region_yearly(spark, sf), "year", "n_orders", GBT_TRAIN_UNTIL, keys=["r_name"])
    return scored.withColumn("prediction", score(F.col("prediction")))


def q_forecast_gbt_global(spark, sf):
    """One series, five training years: trees give each its own value and the last one ever after."""
    y = yearly_gold(spark, sf).select("year", "total")
    scored, _ = forecast_gbt(y, "year", "total", GBT_TRAIN_UNTIL)
    return scored.withColumn("prediction", score(F.col("prediction")))


SEASONAL_FEATURES = ["quarter"]


def seasonal_series(spark: SparkSession, sf: str) -> DataFrame:
    """Per region, year and quarter the product of all orders of the region and all orders of the quarter: a label of which a
    tree has to find that it depends on the quarter alone, in every region on another scale."""
    cells = materialize(region_quarters(spark, sf))
    by_region = cells.groupBy("r_name").agg(F.sum("n_orders").alias("of_region"))
    by_quarter = cells.groupBy("quarter").agg(F.sum("n_orders").alias("of_quarter"))
    return cells.join(by_region, "r_name").join(by_quarter, "quarter").select(
        "r_name", "year", "quarter", (F.col("of_region") * F.col("of_quarter")).alias("label"))


def q_forecast_gbt_indexed(spark, sf):
    """Trees on an indexed category: four values of the quarter, one split chain, every region on its own scale. The label
    is the same in all years, so the prediction must be the label itself, in the years after the training too."""
    scored, _ = forecast_gbt(seasonal_series(spark, sf), "year", "label", GBT_TRAIN_UNTIL, keys=["r_name"], features=SEASONAL_FEATURES)
    return scored.withColumn("prediction", score(F.col("prediction")))


SCORE_YEARS = (2017, 2021)


def q_score_saved_model(spark, sf):
    """Two models fitted, saved, loaded and scored on chosen years: one series, and one of all regions' series with their
    scales. ``same``: the loaded model gives what the fitted one gives."""
    years = spark.range(SCORE_YEARS[0], SCORE_YEARS[1] + 1).select(F.col("id").cast("int").alias("year"))
    total = materialize(yearly_gold(spark, sf).select("year", "total"))
    seasonal = materialize(seasonal_series(spark, sf))
    keyed = (driver_table(spark, sf, "region").select("r_name", F.explode(F.sequence(F.lit(SCORE_YEARS[0]), F.lit(SCORE_YEARS[1]))).alias("year"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter")))
    out = []
    for name, fitted, table in (("total", fit_gbt(total, "year", "total", GBT_TRAIN_UNTIL), years),
                                ("region", fit_gbt(seasonal, "year", "label", GBT_TRAIN_UNTIL, keys=["r_name"], features=SEASONAL_FEATURES), keyed)):
        path = scratch_path(spark, f"model-{name}")
        fitted.save(path)
        both = load_gbt(spark, path).score(fitted.score(table, "fitted"), "loaded")
        out.append(both.select(F.lit(name).alias("model"), (F.col("r_name") if name == "region" else F.lit(None).cast("string")).alias("r_name"), "year",
                               (F.col("quarter") if name == "region" else F.lit(None).cast("int")).alias("quarter"),
                               score(F.col("loaded")).alias("prediction"), F.col("loaded").eqNullSafe(F.col("fitted")).alias("same")))
    return out[0].unionByName(out[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "combine_monthly": q_combine_monthly,
    "outer_join_series": q_outer_join_series,
    "combine_before": q_combine_before,
    "quoted_names": q_quoted_names,
    "monthly_rollup": q_monthly_rollup,
    "quarterly_rollup": q_quarterly_rollup,
    "yearly_rollup": q_yearly_rollup,
    "yearly_rollup_provenance": q_yearly_rollup_provenance,
    "global_sums": q_global_sums,
    "column_bounds": q_column_bounds,
    "quality_not_null": q_quality_not_null,
    "cutoff_filter": q_cutoff_filter,
    "range_filter": q_range_filter,
    "project_drop": q_project_drop,
    "case_known_range": q_case_known_range,
    "train_test_split": q_train_test_split,
    "sorted_series": q_sorted_series,
    "latest_n": q_latest_n,
    "union_missing_columns": q_union_missing_columns,
    "future_years": q_future_years,
    "calendar_gaps": q_calendar_gaps,
    "csv_month_ingest": q_csv_month_ingest,
    "csv_header_ingest": q_csv_header_ingest,
    "gold_roundtrip": q_gold_roundtrip,
    "chart_data_export": q_chart_data_export,
    "chart_text_roundtrip": q_chart_text_roundtrip,
    "chart_descriptor": q_chart_descriptor,
    "impute_year": q_impute_year,
    "impute_year_mean": q_impute_year_mean,
    "forecast_linear": q_forecast_linear,
    "forecast_two_horizons": q_forecast_two_horizons,
    "rmse_by_key": q_rmse_by_key,
    "forecast_gbt": q_forecast_gbt,
    "forecast_gbt_global": q_forecast_gbt_global,
    "impute_gold_all": q_impute_gold_all,
    "forecast_imputed_horizons": q_forecast_imputed_horizons,
    "chart_dashboard": q_chart_dashboard,
    "rollup_grains": q_rollup_grains,
    "csv_rejects": q_csv_rejects,
    "calendar_gaps_all": q_calendar_gaps_all,
    "forecast_elastic_net": q_forecast_elastic_net,
    "forecast_gbt_indexed": q_forecast_gbt_indexed,
    "score_saved_model": q_score_saved_model,
}
