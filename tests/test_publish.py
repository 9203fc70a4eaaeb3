import json
import os

from pyspark.sql import functions as F

import pytest

from seriesforge import chart_descriptor, latest_version, publish_chart, read_chart, with_headers


def chart(spark):
    df = spark.createDataFrame([(y, 1000 + y) for y in range(2000, 2020)], "year int, pax bigint")
    return with_headers(df, {"year": "Year", "pax": "Passengers"})


def descriptor(df, **kw):
    return json.loads(chart_descriptor(df, **kw).first().value)


def test_descriptor_defaults_and_overlay(spark):
    df = chart(spark)
    df = df.withColumn("raw", df.pax + 0)    # computed: no metadata (a plain copy would keep it)
    d = descriptor(df)
    assert (d["title"], d["xtitle"], d["ytitle"], d["xscale"]) == ("", "X", "Y", "labels")
    assert d["columns"] == [{"header": "Year", "key": "year"}, {"header": "Passengers", "key": "pax"},
                            {"header": "raw", "key": "raw"}]


def test_descriptor_bounds_in_titles(spark):
    d = descriptor(chart(spark), title="Traffic", x_title="Year {min} - {max}", y_title="Pax (000s)",
                   x_scale="time", bounds_col="year")
    assert d["xtitle"] == "Year 2000 - 2019" and d["xscale"] == "time" and d["title"] == "Traffic"
    with pytest.raises(ValueError):
        chart_descriptor(chart(spark), x_scale="log")


def test_descriptor_skips_ml_metadata(spark):
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["year"], outputCol="features").transform(chart(spark))
    assert "ml_attr" not in json.dumps(descriptor(df))
    assert "ml_attr" in json.dumps(descriptor(df, include_ml=True))


def test_publish_twice_and_read_latest(spark, workdir):
    out = os.path.join(workdir, "bundles")            # does not exist yet
    df = chart(spark)
    p1 = publish_chart(df, out, "yearly", order_by=["year"], title="v1")
    p2 = publish_chart(df.filter("year >= 2010"), out, "yearly", order_by=["year"], title="v2")
    assert p1 != p2 and os.path.isdir(p1 + "/data")   # the old version stays intact
    assert latest_version(spark, out, "yearly") == p2
    data, desc = read_chart(spark, out, "yearly", schema=df.schema)
    assert data.count() == 10 and dict(data.dtypes) == {"year": "int", "pax": "bigint"}
    assert desc.first().title == "v2"
    # several charts side by side do not replace each other
    publish_chart(df, out, "other")
    assert read_chart(spark, out, "yearly")[0].count() == 10


def test_csv_gives_back_what_it_got(spark, workdir):
    import datetime
    rows = [(1, " a "), (2, ""), (3, None), (4, 'say "hi", \\ ok'), (5, "two\nlines\r\nthree\rfour"), (6, "\t"), (7, '"')]
    stamp = datetime.datetime(2020, 1, 2, 3, 4, 5, 123456)
    df = spark.createDataFrame([(i, t, stamp) for i, t in rows], "id int, text string, at timestamp")
    df = df.withColumn("ntz", F.col("at").cast("timestamp_ntz"))
    publish_chart(df, workdir, "texts", order_by=["id"])
    back, _ = read_chart(spark, workdir, "texts", schema=df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_concurrent_publishes_and_keep(spark, workdir):
    from concurrent.futures import ThreadPoolExecutor

    from seriesforge import latest_version
    df = chart(spark)
    with ThreadPoolExecutor(8) as pool:
        paths = list(pool.map(lambda i: publish_chart(df, workdir, "c", title=f"t{i}"), range(8)))
    assert len(set(paths)) == 8 and latest_version(spark, workdir, "c") in paths
    last = publish_chart(df, workdir, "c", keep=2)
    assert latest_version(spark, workdir, "c") == last
    assert len([x for x in os.listdir(f"{workdir}/c") if x.startswith("v")]) == 2


def test_ordered_parts_concatenate_in_order(spark, workdir):
    df = spark.range(0, 5000).selectExpr("cast(id as int) as year", "id as pax").repartition(7)
    path = publish_chart(df, workdir, "big", order_by=["year"])
    years = []
    for f in sorted(x for x in os.listdir(path + "/data") if x.startswith("part-")):
        years += [int(ln.split(",")[0]) for ln in open(os.path.join(path, "data", f)).read().splitlines()[1:]]
    assert years == list(range(5000))


def test_scratch_paths_live_in_the_shared_folder(spark):
    from seriesforge.session import scratch_path, shared_dir
    base = shared_dir(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(base.rstrip("/")) and b.startswith(base.rstrip("/"))


def test_one_chart_per_key(spark, workdir):
    rows = [(k, y, i * 100 + y) for i, k in enumerate(["AA", "BB", "CC"]) for y in range(2000, 2010)]
    df = with_headers(spark.createDataFrame(rows, "carrier string, year int, pax bigint").repartition(4),
                      {"pax": "Passengers"})
    path = publish_chart(df, workdir, "per-carrier", order_by=["year"], partition_by=["carrier"],
                         x_title="{min}-{max}", bounds_col="year")
    dirs = sorted(d for d in os.listdir(path + "/data") if not d.startswith(("_", ".")))
    assert dirs == ["carrier=AA", "carrier=BB", "carrier=CC"]
    for d in dirs:
        years = []
        for f in sorted(x for x in os.listdir(f"{path}/data/{d}") if x.startswith("part-")):
            years += [int(ln.split(",")[0]) for ln in open(f"{path}/data/{d}/{f}").read().splitlines()[1:]]
        assert years == list(range(2000, 2010))
    data, desc = read_chart(spark, workdir, "per-carrier", schema=df.schema)
    assert data.filter("carrier = 'BB' AND year = 2005").first().pax == 2105
    d = desc.first()
    assert d.xtitle == "2000-2009" and [c.key for c in d.columns] == ["year", "pax"]


def test_cluster_without_shared_folder_is_an_error():
    from seriesforge.session import shared_dir

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = Conf({"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    Context.setCheckpointDir = lambda self, d: None
    assert shared_dir(Session()) == "hdfs:///shared/ckpt"


def test_empty_chart_keeps_every_descriptor_key(spark, workdir):
    df = spark.createDataFrame([], "year int, pax bigint")
    d = descriptor(df, x_title="Year {min} - {max}", bounds_col="year")
    assert d["xtitle"] == "Year  - " and set(d) == {"title", "xtitle", "xscale", "ytitle", "columns"}
    path = publish_chart(df, workdir, "empty", order_by=["year"], bounds_col="year", x_title="{min}")
    data, desc = read_chart(spark, workdir, "empty", schema=df.schema)
    assert data.count() == 0 and desc.first().xtitle == ""
    assert path.endswith(latest_version(spark, workdir, "empty").split("/")[-1])
