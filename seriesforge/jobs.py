"""The composite jobs a user of the reference runs, as functions over files (and a command line).

Each job is a few calls to the operators; they take the caller's session and paths, read whole
inputs, and publish chart bundles / gold tables with Spark writers::

    python -m seriesforge.jobs traffic-charts --international I.csv --domestic D.csv --out charts/
    python -m seriesforge.jobs traffic-charts --gold gold/ --out charts/
    python -m seriesforge.jobs traffic-gold --international I.csv --domestic D.csv --gold gold/ [--impute-year 2021]
    python -m seriesforge.jobs traffic-projection --gold gold/ --out charts/ --cutoffs 2019 2021 --horizon 2026
    python -m seriesforge.jobs traffic-gbt --gold gold/ --out charts/ --train-until 2015
    python -m seriesforge.jobs gdp-history --input usa_gdp.csv --out charts/
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.columns import with_headers
from .operators.forecast import forecast_gbt, forecast_linear, rmse
from .operators.impute import impute_year
from .functions.names import quoted
from .operators.series import combine_series, drop_columns, grain_of, known_until, rollup_grains, rollup_series
from .session import materialize
from .sources.csv import read_series_csv, read_table_csv
from .sources.publish import publish_chart
from .sources.tables import load_table, save_table

INTERNATIONAL, DOMESTIC, TOTAL, REPORTED = "internationalPax", "domesticPax", "pax", "paxBts"
MEASURES = (INTERNATIONAL, DOMESTIC, TOTAL)
HEADERS = {"month": "Month", "period": "Quarter", "year": "Year", TOTAL: "Passengers",
           INTERNATIONAL: "International Passengers", DOMESTIC: "Domestic Passengers",
           REPORTED: "Reported passengers"}


def traffic_gold(spark: SparkSession, international: str | Sequence[str], domestic: str | Sequence[str],
                 before: str | None = None) -> DataFrame:
    """C1: two monthly files → ``month, internationalPax, domesticPax, pax`` (optionally cut)."""
    intl = read_series_csv(spark, international).withColumnRenamed("value", INTERNATIONAL)
    dom = read_series_csv(spark, domestic).withColumnRenamed("value", DOMESTIC)
    return combine_series(intl, dom, "month", total=TOTAL, parts=[INTERNATIONAL, DOMESTIC], before=before)


def period_chart(gold: DataFrame, grain: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    """C2 / C3: roll a monthly gold table up to ``grain`` and set the display headers."""
    # a saved gold table also has its partition column, which is no part of the chart
    df = gold.select("month", *[m for m in measures if m in gold.columns]) if grain == "month" else rollup_series(gold, "month", grain, {m: m for m in measures})
    return with_headers(df, {c: HEADERS[c] for c in df.columns if c in HEADERS})


def traffic_charts(gold: DataFrame, out: str, grains: Sequence[str] = ("month", "quarter", "year"),
                   title: str = "Traffic per {grain}", y_title: str = "Passengers") -> dict:
    """C7: one chart per grain, each its own bundle; returns {grain: published version path}. All grains
    come from one aggregate, checkpointed once and read by every chart."""
    paths = {}
    measures = {m: m for m in MEASURES if m in gold.columns}
    charts = materialize(rollup_grains(with_headers(gold, {c: HEADERS[c] for c in gold.columns if c in HEADERS}), "month", grains, measures))
    for grain in grains:
        chart = grain_of(charts, grain)
        key = chart.columns[0]
        paths[grain] = publish_chart(
            chart, out, f"traffic-{grain}", order_by=[key], title=title.format(grain=grain),
            x_title=("Period from {min} to {max}" if grain != "year" else "Year {min} - {max}"),
            y_title=y_title, bounds_col=key, x_scale="time" if grain == "month" else "labels")
    return paths


def save_traffic_gold(gold: DataFrame, path: str, impute: int | None = None) -> str:
    """C4 / C5: save the gold table (partitioned by year), optionally with the missing months of
    year ``impute`` filled in and the reported total kept as ``paxBts``."""
    if impute is not None:
        gold = impute_year(gold, "month", impute, list(MEASURES), copies={REPORTED: TOTAL})
    return save_table(gold.withColumn("y", F.year("month")), path, partition_by=["y"])


def traffic_projection(spark: SparkSession, gold_path: str, cutoffs: Sequence[int], horizon: int,
                       reg: float = 0.3, alpha: float = 0.8, prediction_header: str = "Trend to {cutoff}",
                       known_header: str = "Passengers to {cutoff}") -> DataFrame:
    """C8 / C9: yearly sums of the gold table, one linear trend per cut-off, scored up to the
    horizon, plus the totals each first model was trained on. The headers of the new columns name their ``{cutoff}``."""
    gold = load_table(spark, gold_path)
    measures = [m for m in (REPORTED, *MEASURES) if m in gold.columns]
    yearly = rollup_series(gold, "month", "year", {m: m for m in measures})
    names = [f"prediction{c}" for c in cutoffs]
    scored = forecast_linear(yearly, "year", TOTAL, list(cutoffs), horizon=horizon, reg=reg, alpha=alpha,
                             names=names)
    scored = drop_columns(scored, [INTERNATIONAL, DOMESTIC]).withColumn(
        f"paxInModel{cutoffs[0]}", known_until("year", cutoffs[0], TOTAL))
    headers = {"year": "Year", TOTAL: "Passengers", REPORTED: "BTS passengers",
               f"paxInModel{cutoffs[0]}": known_header.format(cutoff=cutoffs[0])}
    headers.update({n: prediction_header.format(cutoff=c) for n, c in zip(names, cutoffs)})
    return with_headers(scored, headers)


def traffic_gbt(spark: SparkSession, gold_path: str, train_until: int, seed: int = 42):
    """C10: boosted trees on the yearly totals; returns (scored yearly rows, RMSE row of the test years)."""
    yearly = rollup_series(load_table(spark, gold_path), "month", "year", {m: m for m in MEASURES})
    scored, _ = forecast_gbt(yearly, "year", TOTAL, train_until, seed=seed)
    return scored, rmse(scored, TOTAL, rows=F.col("year") > train_until)


def gdp_history(spark: SparkSession, path: str, keep: Sequence[str] = ("Year", "G.D.P.")) -> DataFrame:
    """C6: a header-named table (BOM, CRLF, names with dots / spaces / %), every column but
    ``keep`` dropped, typed (year INT, value DOUBLE), sorted by year."""
    df = read_table_csv(spark, path)
    year, value = keep
    df = df.select(quoted(year).try_cast("int").alias(year), quoted(value).try_cast("double").alias(value))
    return with_headers(df, {year: year, value: value}).orderBy(quoted(year))


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m seriesforge.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("traffic-charts")
    a.add_argument("--gold"), a.add_argument("--international"), a.add_argument("--domestic")
    a.add_argument("--out", required=True), a.add_argument("--before", default="2020-01-01")
    a.add_argument("--title", default="Traffic per {grain}"), a.add_argument("--y-title", default="Passengers")
    g = sub.add_parser("traffic-gold")
    g.add_argument("--international", required=True), g.add_argument("--domestic", required=True)
    g.add_argument("--gold", required=True), g.add_argument("--before"), g.add_argument("--impute-year", type=int)
    f = sub.add_parser("traffic-projection")
    f.add_argument("--gold", required=True), f.add_argument("--out", required=True)
    f.add_argument("--cutoffs", type=int, nargs="+", required=True), f.add_argument("--horizon", type=int, required=True)
    f.add_argument("--reg", type=float, default=0.3), f.add_argument("--y-title", default="Passengers")
    b = sub.add_parser("traffic-gbt")
    b.add_argument("--gold", required=True), b.add_argument("--out", required=True)
    b.add_argument("--train-until", type=int, required=True)
    h = sub.add_parser("gdp-history")
    h.add_argument("--input", required=True), h.add_argument("--out", required=True)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"seriesforge-{args.job}").getOrCreate()
    if args.job == "traffic-charts":
        if not args.gold and not (args.international and args.domestic):
            p.error("traffic-charts needs --gold, or --international and --domestic")
        gold = (load_table(spark, args.gold) if args.gold else
                traffic_gold(spark, args.international, args.domestic, args.before))
        print(traffic_charts(gold, args.out, title=args.title, y_title=args.y_title))
    elif args.job == "traffic-gold":
        print(save_traffic_gold(traffic_gold(spark, args.international, args.domestic, args.before),
                                args.gold, args.impute_year))
    elif args.job == "traffic-projection":
        chart = traffic_projection(spark, args.gold, args.cutoffs, args.horizon, reg=args.reg)
        print(publish_chart(chart, args.out, "traffic-projection", order_by=["year"],
                            title="Traffic per year", x_title="Year {min} - {max}",
                            y_title=args.y_title, bounds_col="year"))
    elif args.job == "traffic-gbt":
        scored, err = traffic_gbt(spark, args.gold, args.train_until)
        print(err.first())
        print(publish_chart(with_headers(scored, {"year": "Year", TOTAL: "Passengers", "prediction": "Prediction"}),
                            args.out, "traffic-gbt", order_by=["year"], x_title="Year {min} - {max}",
                            bounds_col="year"))
    elif args.job == "gdp-history":
        print(publish_chart(gdp_history(spark, args.input), args.out, "gdp-history", order_by=["Year"],
                            title="US GDP", x_title="Year {min} - {max}", bounds_col="Year"))


if __name__ == "__main__":
    main()
