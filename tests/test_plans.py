"""Plan shape of the registered queries and the driver contract."""

import pytest

import __spark_entry__ as se
from seriesforge.plans.queries import QUERIES

from .conftest import SMALL_SF


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_contract_keys(spark):
    assert set(se.oracle_sql()) <= set(se.queries())
    assert set(QUERIES) <= set(se.queries()) and set(QUERIES) - set(se.oracle_sql()) == {"forecast_gbt"}
    df = se.entry(spark)
    assert df.columns == ["month", "international", "domestic", "total"]
    assert df.count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "forecast_gbt"])
def test_no_python_udfs_no_cartesian(spark, name):
    plan = physical(QUERIES[name](spark, SMALL_SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, f"{name}: {node}"


def test_flagship_single_scan_and_pushdown(spark):
    plan = physical(se.queries()["combine_monthly"](spark, SMALL_SF))
    assert plan.count("orders.parquet") == 1
    assert "LessThan(o_orderdate,2001-01-01T00:00)" in plan
    assert "o_totalprice" not in plan   # pruned from the scan


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_two_horizons_scan_once(spark):
    plan = final_plan(se.queries()["forecast_two_horizons"](spark, SMALL_SF))
    # one scan of orders: rows, fits and future years share the roll-up's shuffle. No window holds a
    # whole key: the fits are partial aggregates, joined back
    assert plan.count("orders.parquet") == 1
    assert "Window" not in plan


def test_imputation_has_no_join(spark):
    plan = physical(se.queries()["impute_year"](spark, SMALL_SF))
    # the calendar is generated per key (sequence / filter / explode), not anti-joined
    assert "LeftAnti" not in plan and "SortMergeJoin" not in plan


DRIVER_TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_each_table_scanned_at_most_once(spark, name):
    from seriesforge.plans.shape import executed_shape
    shape = executed_shape(QUERIES[name](spark, SMALL_SF))
    assert all(n == 1 for t, n in shape["scans"].items() if t in DRIVER_TABLES), shape["scans"]
    assert not any(j.startswith(("BroadcastNestedLoopJoin", "CartesianProduct")) for j in shape["joins"])


def test_operators_build_without_running_jobs(spark):
    """Building the lazy operators runs nothing: no collect, count or schema-inference job."""
    import seriesforge as sfg
    from pyspark.sql import functions as F
    from seriesforge.sources.tables import driver_table
    o = driver_table(spark, SMALL_SF, "orders")     # resolved before the job group starts
    sc = spark.sparkContext
    sc.setJobGroup("lazy-build", "operators must not run jobs while building")
    try:
        m = sfg.rollup_series(o, "o_orderdate", "month", {"n": F.count(F.lit(1)), "p": "o_totalprice"})
        y = sfg.rollup_series(o, "o_orderdate", "year", {"n": F.count(F.lit(1))}, keys=["o_orderstatus"])
        c = sfg.combine_series(m.select("month", "n"), m.select("month", "p"), "month", total="t",
                               parts=["n", "p"], before="1999-01-01")
        i = sfg.impute_year(m, "month", 1998, ["n"])
        g = sfg.calendar_gaps(m, "month", 1998)
        f = sfg.forecast_linear(y, "year", "n", [1997, 1998], keys=["o_orderstatus"], horizon=2005)
        u = sfg.forecast_linear(y.filter("o_orderstatus = 'F'"), "year", "n", 1998, horizon=2005)
        r = sfg.rmse(f, "n", prediction="prediction1998", keys=["o_orderstatus"])
        h = sfg.with_headers(c, {"t": "Total"})
        d = sfg.chart_descriptor(h, bounds_col="month", x_title="{min}..{max}")
        _ = [x.schema for x in (m, y, c, i, g, f, u, r, h, d)]
        assert list(sc.statusTracker().getJobIdsForGroup("lazy-build")) == []
    finally:
        sc.setJobGroup(None, None)


def test_flagship_plan_at_scale(spark):
    """With every table too large for the planner to broadcast (as at 100 TB), the flagship is one
    sort-merge join (orders ⋈ customer); the planner broadcasts the two dimensions by their file size."""
    from seriesforge.plans.shape import executed_shape
    conf = {"spark.sql.autoBroadcastJoinThreshold": "4096", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        shape = executed_shape(se.queries()["combine_monthly"](spark, SMALL_SF.replace("0.001", "0.01")))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert shape["joins"] == {"SortMergeJoin Inner": 1, "BroadcastHashJoin Inner": 2}
    assert shape["broadcasts"] == 2 and all(n == 1 for n in shape["scans"].values())
    assert shape["shuffles"] == 4     # orders and customer for the join, the aggregate, the sort
