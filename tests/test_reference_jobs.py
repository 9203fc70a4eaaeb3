"""The reference's air-traffic jobs, end to end, on files shaped like its two monthly inputs.

Monthly values are spread so that every year sums to the reference's yearly totals
(``golden.YEARLY``); everything the jobs report depends only on those sums, so the chain must
reproduce the reference's golden numbers (SURVEY §5.3): row counts of the gold tables, roll-ups,
the imputation of 2021, both linear projections and the boosted-tree error.
"""

import json
import os

import pytest
from pyspark.sql import functions as F

import seriesforge as sfg

from .golden import MEAN_2021, SPREAD_2021, YEARLY
from .test_sources import MONTHS

MEASURES = ["internationalPax", "domesticPax", "pax"]


def monthly_file(path, which):
    """``which`` = 0 domestic, 1 international; 2000-01 .. 2021-05 plus the source footer."""
    lines = ["Period,Total"]
    for year, totals in sorted(YEARLY.items()):
        n = 5 if year == 2021 else 12
        t = totals[which]
        for m in range(1, n + 1):
            lines.append(f'"{MONTHS[m - 1]} {year}","{t // n + (t % n if m == 1 else 0)}"')
    text = "\n".join(lines) + "\n\n\nSOURCE: Bureau of Statistics, T-100 Market and Segment"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.fixture
def gold_all(spark, workdir):
    dom = sfg.read_series_csv(spark, monthly_file(os.path.join(workdir, "dom.csv"), 0)).withColumnRenamed("value", "domesticPax")
    intl = sfg.read_series_csv(spark, monthly_file(os.path.join(workdir, "intl.csv"), 1)).withColumnRenamed("value", "internationalPax")
    return sfg.combine_series(intl, dom, "month", total="pax", parts=["internationalPax", "domesticPax"])


def test_monthly_quarterly_yearly_charts(spark, gold_all, workdir):
    assert gold_all.count() == 257
    gold = sfg.combine_series(*[gold_all.select("month", c) for c in ("internationalPax", "domesticPax")],
                              "month", total="pax", before="2020-01-01")
    assert gold.count() == 240
    quarterly = sfg.rollup_series(gold, "month", "quarter", {c: c for c in MEASURES})
    assert quarterly.count() == 80 and quarterly.filter("period = '2000-Q1'").count() == 1
    yearly = sfg.rollup_series(gold, "month", "year", {c: c for c in MEASURES})
    got = {r.year: (r.domesticPax, r.internationalPax, r.pax) for r in yearly.collect()}
    assert got == {y: t for y, t in YEARLY.items() if y < 2020}
    # gold table round trip, then the yearly chart with headers and bounds in the title
    path = sfg.save_table(sfg.sorted_series(gold, "month"), os.path.join(workdir, "airtrafficmonth"))
    loaded = sfg.load_table(spark, path)
    chart = sfg.with_headers(sfg.rollup_series(loaded, "month", "year", {c: c for c in MEASURES}),
                             {"year": "Year", "pax": "Passengers", "internationalPax": "International Passengers",
                              "domesticPax": "Domestic Passengers"})
    out = os.path.join(workdir, "charts")
    sfg.publish_chart(chart, out, "yearly", order_by=["year"], title="Air passenger traffic per year",
                      x_title="Year {min} - {max}", y_title="Passengers (000s)", bounds_col="year")
    data, desc = sfg.read_chart(spark, out, "yearly", schema=chart.schema)
    assert data.count() == 20
    d = json.loads(desc.toJSON().first())
    assert d["xtitle"] == "Year 2000 - 2019"
    assert {c["key"]: c["header"] for c in d["columns"]}["pax"] == "Passengers"


@pytest.mark.parametrize("method,expected", [("spread", SPREAD_2021), ("mean", MEAN_2021)])
def test_imputation_of_2021(spark, gold_all, method, expected):
    imputed = sfg.impute_year(gold_all, "month", 2021, MEASURES, method=method, copies={"paxBts": "pax"})
    assert imputed.count() == 264
    rows = imputed.filter("imputed").collect()
    assert len(rows) == 7 and all({m: r[m] for m in MEASURES} == expected for r in rows)
    latest = sfg.latest(imputed, "month", 15).collect()
    assert len(latest) == 15 and latest[0].month.month == 12 and latest[0].paxBts is None


def test_two_horizon_projection_and_boosted_trees(spark, gold_all):
    imputed = sfg.impute_year(gold_all, "month", 2021, MEASURES, copies={"paxBts": "pax"})
    yearly = sfg.rollup_series(imputed, "month", "year", {c: c for c in MEASURES + ["paxBts"]})
    got = {r.year: (r.pax, r.paxBts) for r in yearly.collect()}
    assert got[2021] == (406269, 203136) and got[2019] == (930952, 930952)
    scored = sfg.forecast_linear(yearly, "year", "pax", [2019, 2021], horizon=2026,
                                 names=["prediction2019", "prediction2021"])
    scored = scored.withColumn("paxInModel2019", sfg.known_until("year", 2019, "pax"))
    p = {r.year: r for r in scored.collect()}
    assert sorted(p) == list(range(2000, 2027))
    assert p[2020].prediction2019 == pytest.approx(879939.1, abs=0.1)
    assert p[2026].prediction2019 == pytest.approx(952406.3, abs=0.1)
    assert p[2020].prediction2021 == pytest.approx(728309.1, abs=0.1)
    assert p[2026].prediction2021 == pytest.approx(733532.1, abs=0.1)
    assert p[2020].paxInModel2019 is None and p[2026].pax is None
    # linear projection of the gold table (cut before 2020), regParam 0.5
    gold_yearly = yearly.filter("year < 2020")
    lin = {r.year: r.prediction for r in
           sfg.forecast_linear(gold_yearly, "year", "pax", 2019, horizon=2026, reg=0.5).collect()}
    assert lin[2020] == pytest.approx(879938.7, abs=0.1) and lin[2026] == pytest.approx(952405.8, abs=0.1)
    # boosted trees: train <= 2015, test 2016..2019
    gbt, _ = sfg.forecast_gbt(gold_yearly, "year", "pax", train_until=2015, seed=2)
    err = sfg.rmse(gbt, "pax", rows=F.col("year") > 2015).first()
    assert err.n == 4 and err.rmse == pytest.approx(82875.608, abs=1e-3)


def test_jobs_module_end_to_end(spark, workdir):
    from seriesforge import jobs
    intl = monthly_file(os.path.join(workdir, "I.csv"), 1)
    dom = monthly_file(os.path.join(workdir, "D.csv"), 0)
    out = os.path.join(workdir, "charts")
    paths = jobs.traffic_charts(jobs.traffic_gold(spark, intl, dom, before="2020-01-01"), out)
    assert set(paths) == {"month", "quarter", "year"}
    counts = {g: sfg.read_chart(spark, out, f"traffic-{g}")[0].count() for g in paths}
    assert counts == {"month": 240, "quarter": 80, "year": 20}
    gold = jobs.save_traffic_gold(jobs.traffic_gold(spark, intl, dom), os.path.join(workdir, "gold_all"), impute=2021)
    proj = {r.year: r for r in jobs.traffic_projection(spark, gold, [2019, 2021], 2026).collect()}
    assert proj[2021].pax == 406269 and proj[2021].paxBts == 203136 and proj[2021].paxInModel2019 is None
    assert proj[2026].prediction2021 == pytest.approx(733532.1, abs=0.1)
    cut = jobs.save_traffic_gold(jobs.traffic_gold(spark, intl, dom, before="2020-01-01"), os.path.join(workdir, "gold"))
    _, err = jobs.traffic_gbt(spark, cut, 2015, seed=1)
    assert err.first().rmse == pytest.approx(82875.608, abs=1e-3)


def test_gdp_history_job_and_cli(spark, workdir):
    from seriesforge import jobs
    text = ("﻿President,Year,Receipts,Outlays,Surplus,G.D.P.,Receipts %,Outlays %,Surplus %\r\n"
            "C One,1930,4.1,3.3,0.7,98.4,4.1,3.4,0.8\r\nH Two,1931,3.1,3.6,-0.5,84.8,3.7,4.2,-0.5\r\n"
            "F Three,2026,5.0,6.1,-1.1,31000.5,16.1,19.7,-3.6\r\nH Two,999,1,1,1,1,1,1,1\r\n")
    path = os.path.join(workdir, "gdp.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    df = jobs.gdp_history(spark, path)
    assert df.columns == ["Year", "G.D.P."]
    assert [r.Year for r in df.collect()] == [999, 1930, 1931, 2026]      # numeric, not text, order
    jobs.main(["gdp-history", "--input", path, "--out", os.path.join(workdir, "out")])
    data, desc = sfg.read_chart(spark, os.path.join(workdir, "out"), "gdp-history")
    assert data.count() == 4 and desc.first().xtitle == "Year 999 - 2026"


def test_traffic_cli(spark, workdir, capsys):
    from seriesforge import jobs
    intl = monthly_file(os.path.join(workdir, "I.csv"), 1)
    dom = monthly_file(os.path.join(workdir, "D.csv"), 0)
    out, gold = os.path.join(workdir, "charts"), os.path.join(workdir, "gold")
    jobs.main(["traffic-charts", "--international", intl, "--domestic", dom, "--out", out])
    jobs.main(["traffic-gold", "--international", intl, "--domestic", dom, "--gold", gold, "--impute-year", "2021"])
    jobs.main(["traffic-projection", "--gold", gold, "--out", out, "--cutoffs", "2019", "2021", "--horizon", "2026"])
    data, desc = sfg.read_chart(spark, out, "traffic-projection")
    assert data.count() == 27 and desc.first().xtitle == "Year 2000 - 2026"
    assert sfg.read_chart(spark, out, "traffic-quarter")[0].count() == 80
    printed = capsys.readouterr().out
    assert "traffic-year" in printed and gold in printed
