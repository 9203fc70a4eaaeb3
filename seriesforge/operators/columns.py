"""Column metadata (display headers and other chart hints) and scalar column bounds.

Headers live in each field's Spark metadata, so they travel with the DataFrame through renames,
filters, sorts, unions and Parquet round trips, and the library's roll-ups, totals and forecasts hand them on. Other
aggregates and computed columns start with empty metadata: set headers as the last step before publishing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..functions.names import quoted

HEADER = "header"


def _field(df: DataFrame, name: str) -> StructField:
    """Resolve a top-level column like Spark does: exact name first, then case-insensitively
    unless ``spark.sql.caseSensitive`` is on. Unknown or ambiguous names raise ``KeyError``."""
    fields = df.schema.fields
    for f in fields:
        if f.name == name:
            return f
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    if not case_sensitive:
        hits = [f for f in fields if f.name.lower() == name.lower()]
        if len(hits) == 1:
            return hits[0]
        if len(hits) > 1:
            raise KeyError(f"column {name!r} is ambiguous: {[f.name for f in hits]}")
    raise KeyError(f"column {name!r} not found; columns are {[f.name for f in fields]}")


def column_metadata(df: DataFrame, name: str) -> dict:
    """Metadata of one column (an empty dict when it has none)."""
    return dict(_field(df, name).metadata or {})


def with_metadata(df: DataFrame, updates: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Merge metadata entries into several columns in one projection, keeping existing keys.

    ``updates`` maps column name → {key: value}. Other columns pass through untouched.
    """
    resolved = {_field(df, name).name: dict(entries) for name, entries in updates.items()}
    cols = []
    for f in df.schema.fields:
        if f.name in resolved:
            cols.append(quoted(f.name).alias(f.name, metadata={**(f.metadata or {}), **resolved[f.name]}))
        else:
            cols.append(quoted(f.name))
    return df.select(*cols)


def with_metadata_all(df: DataFrame, key: str, value: object) -> DataFrame:
    """Add the same metadata entry to every column (one projection, not one per column)."""
    return with_metadata(df, {f.name: {key: value} for f in df.schema.fields})


def with_headers(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Set display headers for several columns at once."""
    return with_metadata(df, {name: {HEADER: text} for name, text in headers.items()})


def column_bounds(df: DataFrame, name: str) -> DataFrame:
    """MIN and MAX of one column in a single aggregate (one job, one output row)."""
    c = quoted(_field(df, name).name)
    return df.agg(F.min(c).alias("min_value"), F.max(c).alias("max_value"))


def bounds(df: DataFrame, name: str) -> tuple:
    """(min, max) of a column on the driver: one aggregate, one row back — for chart titles."""
    row = column_bounds(df, name).first()
    return row["min_value"], row["max_value"]
