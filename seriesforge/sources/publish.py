"""Chart bundles: the data set plus a JSON descriptor built from column metadata.

Layout below ``out`` (any Hadoop-compatible file system the executors share)::

    <out>/<chart_id>/v<stamp>/data/part-*.csv     header row; parts in sort order
    <out>/<chart_id>/v<stamp>/metadata/part-*     one line: the descriptor JSON
    <out>/<chart_id>/_versions/<number>           the version's pointer, one line

Every publish writes a new version directory and only then its pointer, so readers never
see a half-written bundle and the previous version stays intact until the new one is complete.
Each chart id is its own bundle, so several charts of one job don't replace each other. All
writes are Spark writes, committed per task: a lost executor only reruns its tasks.

Descriptor (fixed key names of the chart format)::

    {"title": ..., "xtitle": ..., "xscale": "labels" | "time", "ytitle": ...,
     "columns": [{"header": <name>, "key": <name>, ...column metadata}, ...]}

Column metadata overlays the defaults, so a ``header`` entry replaces the column name.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.names import quoted, unused_names
from ..operators.series import tie_breakers, with_position
from . import versions

# Fixed values of the descriptor format.
TITLE, X_TITLE, X_SCALE, Y_TITLE, COLUMNS, HEADER, KEY = (
    "title", "xtitle", "xscale", "ytitle", "columns", "header", "key")
SCALE_LABELS, SCALE_TIME = "labels", "time"
# CSV that gives back what it got: outer blanks, quotes, line breaks, empty text apart from NULL,
# microseconds. A text that consists of backslashes and the NULL marker gets one more backslash.
CSV_OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "nullValue": "\\N", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
# Metadata MLlib attaches to feature / prediction columns; not chart hints.
ML_METADATA_KEYS = ("ml_attr",)


def descriptor_columns(schema: StructType, include_ml: bool = False) -> list[dict]:
    """The ``columns`` array: defaults from the name, then every metadata entry on top."""
    out = []
    for f in schema.fields:
        entry = {HEADER: f.name, KEY: f.name}
        for k, v in (f.metadata or {}).items():
            if include_ml or k not in ML_METADATA_KEYS:
                entry[k] = v
        out.append(entry)
    return out


def _fill_bounds(template: str, lo: Column, hi: Column) -> Column:
    """``template`` with ``{min}`` / ``{max}`` replaced by the bounds as text (empty text when
    the chart has no rows, so the descriptor keeps every key)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.replace(F.replace(F.lit(template), F.lit("{min}"), text(lo)), F.lit("{max}"), text(hi))


def chart_descriptor(df: DataFrame, title: str = "", x_title: str = "X", y_title: str = "Y",
                     x_scale: str = SCALE_LABELS, bounds_col: str | None = None,
                     include_ml: bool = False, bounds: tuple | None = None) -> DataFrame:
    """One-row DataFrame ``(value STRING)`` holding the descriptor JSON.

    ``x_title`` / ``title`` may contain ``{min}`` and ``{max}``: they are filled with the bounds of
    ``bounds_col`` by one aggregate in the same plan (no driver round trip), or with ``bounds`` = (min, max) as texts
    where they are known already. The column list comes from the schema alone.
    """
    if x_scale not in (SCALE_LABELS, SCALE_TIME):
        raise ValueError(f"x_scale must be {SCALE_LABELS!r} or {SCALE_TIME!r}, got {x_scale!r}")
    columns_json = json.dumps(descriptor_columns(df.schema, include_ml), ensure_ascii=False)
    if bounds is None and bounds_col is not None:
        base = df.agg(F.min(quoted(bounds_col)).alias("_lo"), F.max(quoted(bounds_col)).alias("_hi"))
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        base = df.sparkSession.range(1)
        lo, hi = (F.lit(b) for b in bounds or ("", ""))
    head = F.to_json(F.struct(_fill_bounds(title, lo, hi).alias(TITLE),
                              _fill_bounds(x_title, lo, hi).alias(X_TITLE),
                              F.lit(x_scale).alias(X_SCALE),
                              F.lit(y_title).alias(Y_TITLE)))
    # Close the titles object, then add the columns array built from the schema.
    body = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"),
                    F.lit(f',"{COLUMNS}":{columns_json}}}'))
    return base.select(head.alias("_head")).select(body.alias("value"))


_MARKED = r"^\\+N\z"               # the NULL marker as text, however often it was marked


def _texts(df: DataFrame, change) -> DataFrame:
    """``df`` with ``change`` made to the texts that read like the NULL marker."""
    return df.select(*[F.when(quoted(f.name).rlike(_MARKED), change(quoted(f.name))).otherwise(quoted(f.name)).alias(f.name)
                       if isinstance(f.dataType, StringType) else quoted(f.name) for f in df.schema.fields])


def _marked(df: DataFrame) -> DataFrame:
    return _texts(df, lambda c: F.concat(F.lit("\\"), c))


def _unmarked(df: DataFrame) -> DataFrame:
    return _texts(df, lambda c: F.substr(c, F.lit(2)))


def _named_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys become directory names, which can't tell an empty text from NULL: an empty one is an error."""
    named = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name in keys}
    empty = lambda c: F.raise_error(F.lit(f"an empty text in {c!r} can't name a chart of its own"))
    return df.select(*[F.when(quoted(c) == "", empty(c)).otherwise(quoted(c)).alias(c) if c in named else quoted(c)
                       for c in df.columns])


def publish_chart(df: DataFrame, out: str, chart_id: str = "chart", order_by: Sequence[str] = (),
                  title: str = "", x_title: str = "X", y_title: str = "Y",
                  x_scale: str = SCALE_LABELS, bounds_col: str | None = None,
                  include_ml: bool = False, partition_by: Sequence[str] = (), keep: int | None = None) -> str:
    """Write ``df`` and its descriptor as a new version of chart ``chart_id``; returns its path.

    Data order: with ``order_by`` the frame is range-partitioned and sorted, so part files are in
    order (AQE folds a small chart into one file). ``keep`` removes older versions once this one is
    the newest, all but that many.

    ``partition_by`` (series keys) publishes one chart per key: ``data/<key>=<value>/part-*.csv``,
    each directory holding one key's rows in ``order_by`` order across its part files. The
    descriptor lists the columns a per-key file holds (the keys are in the directory names).
    """
    spark = df.sparkSession
    root = f"{out.rstrip('/')}/{chart_id}"
    claim = versions.begin(spark, root)
    path = claim.path
    data = df
    writer_keys = list(partition_by)
    if writer_keys:
        # Range-partition on (keys, order, other columns): each task covers a contiguous slice,
        # so it writes into few key directories, part files within a directory are in order, and
        # a key holding a large share of the rows is spread over several tasks.
        ordering = [quoted(c) for c in writer_keys + list(order_by)]
        ordering += tie_breakers(df, writer_keys + list(order_by))
        data = data.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    elif order_by:
        data = data.orderBy(*[quoted(c) for c in order_by], *tie_breakers(df, list(order_by)))
    # Title bounds are observed while the rows are written: nothing is read twice, and only two values come back.
    seen = Observation()
    if bounds_col is not None:
        text = lambda c: c.cast("string")
        data = data.observe(seen, text(F.min(quoted(bounds_col))).alias("lo"), text(F.max(quoted(bounds_col))).alias("hi"))
    writer = _named_keys(_marked(data), writer_keys).write.options(**CSV_OPTIONS, emptyValue='""')
    if writer_keys:
        writer = writer.partitionBy(*writer_keys)
    writer.csv(f"{path}/data")
    bounds = (seen.get["lo"], seen.get["hi"]) if bounds_col is not None else None
    described = df.drop(*writer_keys) if writer_keys else df
    (chart_descriptor(described, title, x_title, y_title, x_scale, None, include_ml, bounds)
     .coalesce(1).write.text(f"{path}/metadata"))
    versions.publish(spark, claim, keep, retry=True)        # a chart doesn't build on the one before
    return path


def _typed_reader(spark: SparkSession, schema: StructType | None):
    reader = spark.read.options(**CSV_OPTIONS, emptyValue="")
    if schema is None or any(isinstance(f.dataType, StringType) for f in schema.fields):
        reader = reader.option("multiLine", True)       # a text may hold line breaks
    if schema is not None:
        reader = reader.schema(StructType([StructField(f.name, f.dataType, True) for f in schema.fields]))
    return reader


def latest_version(spark: SparkSession, out: str, chart_id: str = "chart") -> str:
    """Path of the newest complete version (one aggregate; a single string comes back)."""
    path = versions.newest(spark, f"{out.rstrip('/')}/{chart_id}")
    if path is None:
        raise FileNotFoundError(f"no published version of chart {chart_id!r} under {out!r}")
    return path


def read_chart(spark: SparkSession, out: str, chart_id: str = "chart",
               schema: StructType | None = None, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(data, descriptor) of the newest version. Data columns are typed when ``schema`` is given
    (as written: the chart frame's own schema), else strings. The descriptor is parsed JSON. ``position`` names a column for the
    place (from 1) of each row in the published order: by file name, then by place in the file."""
    path = latest_version(spark, out, chart_id)
    data = _typed_reader(spark, schema).csv(f"{path}/data")
    descriptor = spark.read.json(f"{path}/metadata")
    if position is not None:
        names = data.columns
        own = unused_names(data, "file", "start", "row")
        # rows of one stretch of a file are in one task, in their order
        data = data.select("*", F.col("_metadata.file_path").alias(own["file"]), F.col("_metadata.file_block_start").alias(own["start"]),
                           F.monotonically_increasing_id().alias(own["row"]))
        data = with_position(data.orderBy(*[quoted(own[c]) for c in ("file", "start", "row")]), position)
        data = data.select(*[quoted(c) for c in [*names, position]])
    return _unmarked(data), descriptor
