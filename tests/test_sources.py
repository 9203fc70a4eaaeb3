import datetime as dt
import os

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from seriesforge.sources import versions
from seriesforge import load_table, read_series_csv, read_table_csv, save_table, write_series_csv

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]


def write(path, text, encoding="utf-8", newline="\n"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text.replace("\n", newline))
    return path


def monthly_lines(start_year, n, base=100):
    out = []
    for i in range(n):
        y, m = start_year + i // 12, i % 12
        out.append(f'"{MONTHS[m]} {y}","{base + i}"')
    return out


def test_series_clean_binds_by_position(spark, workdir):
    p = write(os.path.join(workdir, "clean.csv"), "Period,Total\n" + "\n".join(monthly_lines(2000, 17)) + "\n")
    df = read_series_csv(spark, p, value_name="pax")
    assert df.columns == ["month", "pax"]
    rows = df.orderBy("month").collect()
    assert len(rows) == 17
    assert rows[0]["month"] == dt.date(2000, 1, 1) and rows[0]["pax"] == 100
    assert rows[-1]["month"] == dt.date(2001, 5, 1) and rows[-1]["pax"] == 116
    assert dict(df.dtypes) == {"month": "date", "pax": "int"}


def test_series_footer_is_removed(spark, workdir):
    text = ("Period,Total\n" + "\n".join(monthly_lines(2000, 17)) +
            "\n\n\nSOURCE: Bureau of Statistics, T-100 Market and Segment")
    p = write(os.path.join(workdir, "footer.csv"), text)
    raw = read_series_csv(spark, p, value_name="pax", not_null=False)
    assert raw.filter(F.col("month").isNull()).count() == 1   # the source line
    assert read_series_csv(spark, p, value_name="pax").count() == 17


def test_bad_cells_become_null_then_filtered(spark, workdir):
    text = 'Period,Total\n"January 2000","10"\n"Febtober 2000","11"\n"March 2000","n/a"\n"April 2000",""\n'
    p = write(os.path.join(workdir, "bad.csv"), text)
    df = read_series_csv(spark, p, value_name="pax")
    assert [(r.month, r.pax) for r in df.collect()] == [(dt.date(2000, 1, 1), 10)]


def test_many_files_one_scan(spark, workdir):
    d = os.path.join(workdir, "many")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "Period,Total\n" + "\n".join(monthly_lines(2000, 12)) + "\n")
    write(os.path.join(d, "b.csv"), "Period,Total\n" + "\n".join(monthly_lines(2001, 12)) + "\n")
    assert read_series_csv(spark, d).count() == 24
    assert read_series_csv(spark, [os.path.join(d, "a.csv"), os.path.join(d, "b.csv")]).count() == 24


def test_table_with_bom_crlf_and_odd_names(spark, workdir):
    text = "﻿President,Year,G.D.P.,Receipts %\nA One,1930,98.4,4.1\nB Two,1931,84.8,3.7\n"
    p = write(os.path.join(workdir, "gdp.csv"), text, newline="\r\n")
    untyped = read_table_csv(spark, p)
    assert untyped.columns == ["President", "Year", "G.D.P.", "Receipts %"]
    assert all(t == "string" for _, t in untyped.dtypes)
    assert untyped.select("`G.D.P.`").collect()[1][0] == "84.8"
    schema = StructType([StructField("president", StringType()), StructField("year", IntegerType()),
                         StructField("gdp", DoubleType()), StructField("receipts_pct", DoubleType())])
    typed = read_table_csv(spark, p, schema=schema).orderBy("year")
    rows = typed.collect()
    assert [r.year for r in rows] == [1930, 1931]
    assert rows[0].receipts_pct == 4.1 and rows[1].gdp == 84.8


def test_write_then_read_series_roundtrip(spark, workdir):
    df = spark.createDataFrame([(dt.date(2000, m, 1), m * 10) for m in range(1, 13)], "month date, pax int")
    out = os.path.join(workdir, "out")
    write_series_csv(df, out, "month", "pax")
    back = read_series_csv(spark, out, value_name="pax")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    first = [ln for f in sorted(os.listdir(out)) if f.endswith(".csv")
             for ln in open(os.path.join(out, f))][:2]
    assert first[0].strip().replace('"', '') == "Period,Total" and first[1].startswith('"January 2000"')


def test_gold_table_roundtrip_keeps_metadata(spark, workdir):
    from seriesforge import with_headers
    df = with_headers(spark.createDataFrame([(dt.date(2000, 1, 1), 5)], "month date, pax int"), {"pax": "Passengers"})
    path = save_table(df, os.path.join(workdir, "gold"))
    back = load_table(spark, path)
    assert back.collect() == df.collect()
    assert back.schema["pax"].metadata == {"header": "Passengers"}
    save_table(df.withColumn("pax", F.lit(7)), path)   # overwrite
    assert load_table(spark, path).first().pax == 7


def test_partitioned_gold_table_prunes_year_slices(spark, workdir):
    rows = [(dt.date(y, m, 1), y * 100 + m) for y in (2019, 2020, 2021) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "month date, pax int").withColumn("y", F.year("month"))
    path = save_table(df, os.path.join(workdir, "gold"), partition_by=["y"])
    newest = versions.newest(spark, path)
    assert sorted(x for x in os.listdir(newest) if x.startswith("y=")) == ["y=2019", "y=2020", "y=2021"]
    one = load_table(spark, path).filter("y = 2021")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(y" in plan and "(y#" in plan
    assert one.count() == 12 and one.agg(F.min("pax")).first()[0] == 202101


def test_partitioned_write_is_clustered(spark, workdir):
    rows = [(dt.date(2000 + i % 4, 1 + i % 12, 1), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "month date, pax int").withColumn("y", F.year("month")).repartition(16)
    path = save_table(df, os.path.join(workdir, "clustered"), partition_by=["y"])
    newest = versions.newest(spark, path)
    files = [f for d in os.listdir(newest) if d.startswith("y=")
             for f in os.listdir(os.path.join(newest, d)) if f.endswith(".parquet")]
    assert len(files) < 16 * 4            # not one file per task per year
    assert load_table(spark, path).count() == 4000


def test_saving_over_a_table_that_the_plan_reads(spark, workdir):
    path = os.path.join(workdir, "gold")
    save_table(spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), path)
    save_table(load_table(spark, path).withColumn("v", F.col("v") + 1), path, keep=1)
    assert sorted(map(tuple, load_table(spark, path).collect())) == [(1, 11), (2, 21)]
    assert len([x for x in os.listdir(path) if x.startswith("v")]) == 1
    with pytest.raises(FileExistsError):
        save_table(spark.range(1), path, mode="error")


def test_failed_save_leaves_the_old_version(spark, workdir):
    path = os.path.join(workdir, "gold")
    save_table(spark.createDataFrame([(1, 10)], "k int, v int"), path)
    broken = load_table(spark, path).select("k", F.raise_error(F.lit("no")).cast("int").alias("v"))
    with pytest.raises(Exception):
        save_table(broken, path)
    assert load_table(spark, path).collect()[0].v == 10


def test_copied_and_moved_tables_stand_on_their_own(spark, workdir):
    import shutil
    g, copy, moved = (os.path.join(workdir, n) for n in ("g", "my copy", "moved"))
    save_table(spark.createDataFrame([(1, 10)], "k int, v int"), g)
    save_table(load_table(spark, g).withColumn("v", F.lit(11)), g)
    shutil.copytree(g, copy)
    save_table(load_table(spark, copy).withColumn("v", F.lit(99)), copy, keep=1)
    assert load_table(spark, g).first().v == 11 and load_table(spark, copy).first().v == 99
    assert len([x for x in os.listdir(g) if x.startswith("v")]) == 2          # nothing of the original went
    os.rename(g, moved)
    assert load_table(spark, moved).first().v == 11
    save_table(load_table(spark, moved).withColumn("v", F.col("v") + 1), moved, keep=1)
    assert load_table(spark, moved).first().v == 12 and load_table(spark, copy).first().v == 99


def test_two_saves_from_one_version_keep_both_changes_apart(spark, workdir):
    from seriesforge import ConcurrentSaveError, table_version
    path = os.path.join(workdir, "gold")
    save_table(spark.createDataFrame([(1, 0)], "k int, v int"), path)
    a, b = (load_table(spark, path).withColumn("v", F.col("v") + n) for n in (1, 10))
    base = table_version(spark, path)
    save_table(a, path)
    with pytest.raises(ConcurrentSaveError):
        save_table(b, path)                                  # planned on a version that is not the newest any more
    assert load_table(spark, path).first().v == 1
    with pytest.raises(ConcurrentSaveError):
        save_table(b.checkpoint(), path, based_on=base)      # its input files can't be seen, the caller says it
    save_table(load_table(spark, path).withColumn("v", F.col("v") + 10), path)
    assert load_table(spark, path).first().v == 11
    save_table(spark.createDataFrame([(1, 5)], "k int, v int"), path)         # builds on nothing: a plain overwrite
    assert load_table(spark, path).first().v == 5


def test_writers_at_the_same_time_claim_one_number(spark, workdir):
    from seriesforge import ConcurrentSaveError
    root = os.path.join(workdir, "t")
    one, two, three = (versions.begin(spark, root) for _ in range(3))
    for claim, v in ((one, 1), (two, 2), (three, 3)):
        spark.range(v).write.parquet(claim.path)
    versions.publish(spark, one)
    with pytest.raises(ConcurrentSaveError):
        versions.publish(spark, two)
    assert not os.path.exists(two.path) and versions.newest(spark, root) == one.path
    versions.publish(spark, three, retry=True)               # takes the next number
    assert versions.newest(spark, root) == three.path and load_table(spark, root).count() == 3


def test_pointers_name_versions_of_their_root_only(spark, workdir):
    root = os.path.join(workdir, "t")
    save_table(spark.range(2), root)
    write(os.path.join(root, "_versions", "0000000007"), "../elsewhere")
    with pytest.raises(ValueError):
        load_table(spark, root)
    write(os.path.join(root, "_versions", "0000000007"), "")                  # a writer died while claiming
    assert load_table(spark, root).count() == 2
    save_table(spark.range(5), root)
    assert load_table(spark, root).count() == 5 and "0000000008" in os.listdir(os.path.join(root, "_versions"))


def test_error_mode_sees_a_plain_folder(spark, workdir):
    path = os.path.join(workdir, "plain")
    spark.range(3).write.parquet(path)
    with pytest.raises(FileExistsError):
        save_table(spark.range(1), path, mode="error")
    assert load_table(spark, path).count() == 3
    fresh = os.path.join(workdir, "fresh")
    save_table(spark.range(1), fresh, mode="error")
    assert load_table(spark, fresh).count() == 1
