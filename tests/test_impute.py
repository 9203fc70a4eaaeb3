import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesforge import calendar_gaps, impute_year, rollup_series

from .golden import MEAN_2021, SPREAD_2021, YEARLY

MEASURES = ["pax", "internationalPax", "domesticPax"]


def partial_year(spark, months=5):
    """Five known months of 2021 whose sums are the real 2021 totals, plus a full 2020."""
    dom, intl, tot = YEARLY[2021]
    rows = []
    for m in range(1, months + 1):
        # spread the year totals over the known months, remainder in the first month
        share = lambda v: v // months + (v % months if m == 1 else 0)
        rows.append((dt.date(2021, m, 1), share(tot), share(intl), share(dom)))
    d20, i20, t20 = YEARLY[2020]
    for m in range(1, 13):
        rows.append((dt.date(2020, m, 1), t20 // 12, i20 // 12, d20 // 12))
    return spark.createDataFrame(rows, "month date, pax int, internationalPax int, domesticPax int")


@pytest.mark.parametrize("method,expected", [("spread", SPREAD_2021), ("mean", MEAN_2021)])
def test_reference_values(spark, method, expected):
    df = partial_year(spark)
    out = impute_year(df, "month", 2021, MEASURES, method=method, copies={"paxBts": "pax"})
    assert out.count() == 12 + 12
    imputed = out.filter("imputed").orderBy("month").collect()
    assert [r.month for r in imputed] == [dt.date(2021, m, 1) for m in range(6, 13)]
    for r in imputed:
        assert {m: r[m] for m in MEASURES} == expected
        assert r.paxBts is None
    assert dict(out.dtypes)["pax"] == "bigint" and dict(out.dtypes)["month"] == "date"
    year = rollup_series(out, "month", "year", {"pax": "pax", "paxBts": "paxBts"}).filter("year = 2021").first()
    assert year.paxBts == YEARLY[2021][2]
    if method == "spread":
        assert year.pax == 406269


def test_real_gaps_and_keys(spark):
    rows = [("full", dt.date(2021, m, 1), 10) for m in range(1, 13)]
    rows += [("gap", dt.date(2021, m, 1), 12) for m in range(1, 13) if m not in (2, 7)]
    rows += [("old", dt.date(2020, 1, 1), 5)]
    rows += [(None, dt.date(2021, 1, 1), 6)]
    df = spark.createDataFrame(rows, "k string, month date, v bigint")
    gaps = {(r.k, r.month) for r in calendar_gaps(df, "month", 2021, keys=["k"]).collect()}
    assert ("gap", dt.date(2021, 2, 1)) in gaps and ("gap", dt.date(2021, 7, 1)) in gaps
    assert not any(k == "full" or k == "old" for k, _ in gaps)
    assert len([g for g in gaps if g[0] is None]) == 11
    out = impute_year(df, "month", 2021, ["v"], keys=["k"])
    imp = {(r.k, r.month): r.v for r in out.filter("imputed").collect()}
    # 10 known months of 12 → 120 / 2 missing months each
    assert imp[("gap", dt.date(2021, 2, 1))] == 60 and imp[("gap", dt.date(2021, 7, 1))] == 60
    assert not any(k in ("full", "old") for k, _ in imp)     # full year / no data: nothing added
    assert imp[(None, dt.date(2021, 12, 1))] == 0            # 6 div 11 (integer division)
    mean = impute_year(df, "month", 2021, ["v"], keys=["k"], method="mean")
    assert {r.v for r in mean.filter("imputed AND k = 'gap'").collect()} == {12}


def test_fractional_measures_use_true_division(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(dt.date(2021, 1, 1), 1.0, Decimal("10.50"))], "month date, a double, b decimal(10,2)")
    out = impute_year(df, "month", 2021, ["a", "b"], flag=None)
    r = out.filter(F.col("month") == dt.date(2021, 2, 1)).first()
    assert abs(r.a - 1.0 / 11) < 1e-12 and float(r.b) == 0.95


def test_empty_input_adds_nothing(spark):
    df = spark.createDataFrame([], "month date, v int")
    assert impute_year(df, "month", 2021, ["v"]).count() == 0


def test_integral_sums_do_not_overflow_the_measure(spark):
    df = spark.createDataFrame([(dt.date(2021, m, 1), 300_000_000) for m in range(1, 12)], "month date, v int")
    got = impute_year(df, "month", 2021, ["v"]).filter("imputed").collect()
    assert [r.v for r in got] == [3_300_000_000]
