"""Calendar expressions on native Spark functions (all inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import quoted

GRAINS = ("month", "quarter", "year")


def as_col(c: str | Column) -> Column:
    return quoted(c) if isinstance(c, str) else c


def month_start(c: str | Column) -> Column:
    """First day of the month as DATE; works for DATE, TIMESTAMP and TIMESTAMP_NTZ."""
    return F.trunc(F.to_date(as_col(c)), "month")


def year_of(c: str | Column) -> Column:
    return F.year(as_col(c))


def quarter_of(c: str | Column) -> Column:
    # ceil(month / 3) is what a quarter is; F.quarter computes the same in one expression.
    return F.quarter(as_col(c))


def quarter_label(c: str | Column) -> Column:
    """Text period ``2000-Q1``: year, literal ``-Q``, quarter number."""
    return F.concat(F.year(as_col(c)).cast("string"), F.lit("-Q"), F.quarter(as_col(c)).cast("string"))


def grain_key(c: str | Column, grain: str) -> Column:
    """The period key of a date for one grain: month → DATE, quarter → STRING, year → INT."""
    if grain == "month":
        return month_start(c)
    if grain == "quarter":
        return quarter_label(c)
    if grain == "year":
        return year_of(c)
    raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def year_months(year: Column) -> Column:
    """ARRAY<DATE> of the twelve month starts of ``year``."""
    return F.sequence(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(1)),
                      F.expr("INTERVAL 1 MONTH"))
