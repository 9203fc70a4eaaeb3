"""Property tests: the Spark operators against a brute-force model on random small inputs."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seriesforge import fit_trend, impute_year

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

series_strategy = st.dictionaries(
    keys=st.sampled_from(["a", "b", "c"]),
    values=st.dictionaries(st.integers(1, 12), st.integers(0, 10_000), min_size=0, max_size=12),
    min_size=1, max_size=3)


def brute_impute(data, method):
    out = {}
    for key, months in data.items():
        k = len(months)
        divisor = 12 - k if method == "spread" else k
        if k == 0 or divisor <= 0:
            continue
        total = sum(months.values())
        for m in range(1, 13):
            if m not in months:
                out[(key, m)] = int(total / divisor)   # truncation toward zero
    return out


@SETTINGS
@given(data=series_strategy, method=st.sampled_from(["spread", "mean"]))
def test_impute_matches_brute_force(spark, data, method):
    rows = [(key, dt.date(2021, m, 1), v) for key, months in data.items() for m, v in months.items()]
    rows.append(("z", dt.date(2020, 6, 1), 5))                       # another year: never touched
    df = spark.createDataFrame(rows, "k string, month date, v bigint")
    out = impute_year(df, "month", 2021, ["v"], keys=["k"], method=method)
    got = {(r.k, r.month.month): r.v for r in out.filter("imputed").collect()}
    assert got == brute_impute(data, method)
    assert out.filter("NOT imputed").count() == len(rows)            # originals kept whole


@SETTINGS
@given(points=st.lists(st.tuples(st.integers(1990, 2030), st.integers(-10_000, 10_000)), min_size=2, max_size=30))
def test_unpenalised_trend_is_least_squares(spark, points):
    df = spark.createDataFrame(points, "x int, y bigint")
    fit = fit_trend(df, "x", "y", reg=0.0).first()
    xs = np.array([p[0] for p in points], dtype=float)
    ys = np.array([p[1] for p in points], dtype=float)
    if np.ptp(xs) == 0 or np.ptp(ys) == 0:                           # constant feature or label
        assert fit.slope == 0.0 and fit.intercept == pytest.approx(ys.mean(), abs=1e-6)
        return
    slope, intercept = np.polyfit(xs, ys, 1)
    assert fit.slope == pytest.approx(slope, rel=1e-6, abs=1e-6)
    assert fit.intercept == pytest.approx(intercept, rel=1e-6, abs=1e-3)


months_strategy = st.dictionaries(st.integers(0, 35), st.integers(0, 1000), max_size=36)


@SETTINGS
@given(left=months_strategy, right=months_strategy, cut=st.one_of(st.none(), st.integers(0, 36)))
def test_combine_matches_brute_force_outer_join(spark, left, right, cut):
    from seriesforge import combine_series

    def month(i):
        return dt.date(2000 + i // 12, i % 12 + 1, 1)

    lf = spark.createDataFrame([(month(i), v) for i, v in left.items()], "month date, a bigint")
    rf = spark.createDataFrame([(month(i), v) for i, v in right.items()], "month date, b bigint")
    before = None if cut is None else month(cut).isoformat()
    out = combine_series(lf, rf, "month", total="t", parts=["a", "b"], before=before)
    got = {r.month: (r.a, r.b, r.t) for r in out.collect()}
    want = {}
    for i in set(left) | set(right):
        if cut is not None and i >= cut:
            continue
        a, b = left.get(i), right.get(i)
        want[month(i)] = (a, b, a + b if a is not None and b is not None else None)
    assert got == want
