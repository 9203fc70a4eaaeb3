"""A hot key (a third of all orders on one customer) is split by AQE, and results stay whole."""

import datetime as dt
import random

import __spark_entry__ as se


def write_tables(spark, d):
    random.seed(7)
    spark.createDataFrame([(0, "AFRICA"), (1, "AMERICA")], "r_regionkey int, r_name string") \
        .write.parquet(f"{d}/region.parquet")
    spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int") \
        .write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(c, f"C{c}", c % 4, 0.0, "BUILDING") for c in range(200)],
                          "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string") \
        .write.parquet(f"{d}/customer.parquet")
    rows = []
    for k in range(30000):
        cust = 1 if k % 3 == 0 else random.randrange(200)       # customer 1 holds a third
        day = dt.datetime(1999, 1, 1) + dt.timedelta(days=random.randrange(800))
        rows.append((k, cust, "O", 1.0, day, "1-URGENT"))
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                                "o_orderdate timestamp_ntz, o_orderpriority string") \
        .repartition(8).write.parquet(f"{d}/orders.parquet")
    return rows


def test_hot_customer_is_split_and_counts_are_whole(spark, workdir):
    rows = write_tables(spark, workdir)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = se.queries()["combine_monthly"](spark, workdir)
        got = {r.month: (r.international, r.domestic, r.total) for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan
    want = {}
    for _, cust, _, _, day, _ in rows:
        if day >= dt.datetime(2001, 1, 1):
            continue
        month = dt.date(day.year, day.month, 1)
        domestic = (cust % 4) % 2 == 1        # nation n → region n % 2; region 1 is the home region
        i, d = want.get(month, (0, 0))
        want[month] = (i + (not domestic), d + domestic)
    assert {m: (i or None, d or None, (i + d) if i and d else None) for m, (i, d) in want.items()} == got
