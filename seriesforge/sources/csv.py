"""CSV ingestion with a typed schema and simple quality rules.

Monthly series files look like::

    Period,Total
    "January 2000","41552"
    ...
    <blank lines>
    SOURCE: <agency>, <dataset>

The header names differ from the schema names, so columns bind **by position** (explicit schema,
``enforceSchema``). Unparsable cells become NULL (permissive mode), blank lines vanish, and the
source footer turns into an all-NULL row that the not-null rule removes; with ``rejects`` the reader also says
which lines it removed, from which file, and why. Paths may be lists or
globs: one scan reads them all in parallel, split by ``spark.sql.files.maxPartitionBytes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegerType, StringType, StructField, StructType

from ..functions.names import quoted
from ..operators.series import require_not_null

# How the monthly files spell their periods.
MONTH_TEXT_FORMAT = "MMMM yyyy"
BOM = "﻿"


def series_schema(date_name: str = "month", value_name: str = "value",
                  value_type: DataType = IntegerType()) -> StructType:
    return StructType([StructField(date_name, DateType(), True), StructField(value_name, value_type, True)])


CORRUPT = "_corrupt_line"
REJECT_COLUMNS = ("file", "line", "reason")


def read_series_csv(spark: SparkSession, paths: str | Sequence[str], value_name: str = "value",
                    date_name: str = "month", date_format: str = MONTH_TEXT_FORMAT,
                    value_type: DataType = IntegerType(), not_null: bool = True,
                    rejects: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Read ``period, value`` CSV files into ``(date_name DATE, value_name value_type)``.

    With ``rejects`` returns (rows, rejected lines): the rows as without it, and a frame ``file, line, reason`` with every
    line the not-null rule removes. ``reason`` is ``period``, ``value`` or ``period and value`` (what is missing),
    with ``unparsable`` in front if the line holds something else in its place; ``line`` is the line as it stands in the file,
    or for a line that parses (its cells are empty) its cells as CSV. Blank lines are no lines. A line with more cells than
    the schema whose period and value are good is a row. Each of the two frames is one scan of the files.
    """
    if rejects and not not_null:
        raise ValueError("rejects are the rows that the not-null rule removes")
    schema = series_schema(date_name, value_name, value_type)
    reader = (spark.read.option("header", True).option("enforceSchema", True)
              .option("dateFormat", date_format).option("mode", "PERMISSIVE"))
    paths = paths if isinstance(paths, str) else list(paths)
    df = reader.schema(schema).csv(paths)
    if not rejects:
        return require_not_null(df, [date_name, value_name]) if not_null else df
    raw = (reader.schema(schema.add(CORRUPT, StringType())).option("columnNameOfCorruptRecord", CORRUPT).csv(paths)
           .withColumn("_file", F.col("_metadata.file_path")))
    period, value, corrupt = quoted(date_name), quoted(value_name), F.col(CORRUPT)
    no_value = value.isNull()
    if value_type.typeName() in ("float", "double"):
        no_value = no_value | F.isnan(value)
    what = (F.when(period.isNull() & no_value, F.lit("period and value")).when(period.isNull(), F.lit("period"))
            .when(no_value, F.lit("value")))
    cells = F.to_csv(F.struct(F.date_format(period, date_format).alias(date_name), value.alias(value_name)))
    removed = raw.where(what.isNotNull()).select(
        F.col("_file").alias("file"), F.coalesce(corrupt, cells).alias("line"),
        F.concat(F.when(corrupt.isNotNull(), F.lit("unparsable ")).otherwise(F.lit("")), what).alias("reason"))
    return require_not_null(df, [date_name, value_name]), removed


def read_table_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | None = None,
                   **options) -> DataFrame:
    """Read CSV files with a header line.

    With ``schema`` the columns bind by position and are typed (bad cells → NULL). Without one,
    every column is a STRING named after the header; a UTF-8 byte-order mark in front of the first
    name is removed.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", True)
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    if schema is None and df.columns and df.columns[0].startswith(BOM):
        df = df.withColumnRenamed(df.columns[0], df.columns[0][len(BOM):])
    return df


def write_series_csv(df: DataFrame, path: str, date_col: str, value_col: str,
                     date_format: str = MONTH_TEXT_FORMAT, header: tuple[str, str] = ("Period", "Total"),
                     mode: str = "errorifexists") -> None:
    """Write a series in the monthly-file layout (quoted cells, month names), in parallel."""
    (df.select(F.date_format(F.col(date_col), date_format).alias(header[0]),
               F.col(value_col).cast("string").alias(header[1]))
       .write.mode(mode).option("header", True).option("quoteAll", True).csv(path))
