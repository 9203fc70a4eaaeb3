"""Series operators: roll-ups, combining two series, filters, sorts, union.

A *series* is a DataFrame with an optional list of key columns (which series a row belongs to:
carrier, region, segment ...), one period column, and measure columns. With no keys it is the
single global series of a classic chart; with keys, the same plan computes millions of series at
once. Every function here returns a lazy DataFrame; none collects, caches or loops over rows.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_col, grain_key
from ..functions.names import quoted, quoted_all, unused_names
from .columns import HEADER

# Name of the period column a roll-up produces for each grain.
PERIOD_NAMES = {"month": "month", "quarter": "period", "year": "year"}

# Display headers of period columns, where the date column has one.
PERIOD_HEADERS = {"month": "Month", "quarter": "Quarter", "year": "Year"}

Measures = Mapping[str, "Column | str"]


def _aggregates(measures: Measures) -> list[Column]:
    """``{"pax": "pax"}`` means ``sum(pax) AS pax``; a Column is used as the aggregate itself."""
    out = []
    for name, m in measures.items():
        agg = F.sum(quoted(m)) if isinstance(m, str) else m
        out.append(agg.alias(name))
    return out


def _carried(df: DataFrame, measures: Measures) -> list[Column]:
    """The aggregates; one over a plain column keeps that column's metadata (its display header)."""
    metadata = {f.name: f.metadata or {} for f in df.schema.fields}
    return [agg.alias(name, metadata=metadata[m]) if isinstance(m, str) and metadata.get(m) else agg
            for agg, (name, m) in zip(_aggregates(measures), measures.items())]


def _period(df: DataFrame, date_col: str, grain: str, name: str) -> Column:
    """The period column; metadata of the date column with the grain's own display header, if it has one."""
    metadata = next((f.metadata or {} for f in df.schema.fields if f.name == date_col), {})
    if HEADER in metadata:
        metadata = {**metadata, HEADER: PERIOD_HEADERS[grain]}
    key = grain_key(date_col, grain)
    return key.alias(name, metadata=metadata) if metadata else key.alias(name)


def rollup_series(df: DataFrame, date_col: str, grain: str, measures: Measures,
                  keys: Sequence[str] = (), period_name: str | None = None) -> DataFrame:
    """Group rows into periods (``month`` / ``quarter`` / ``year``) per key and aggregate.

    One hash aggregate: partial aggregation runs before the shuffle, so the exchange carries at
    most one row per (task, key, period) whatever the skew of the input. The result is not sorted;
    sort once at the end with :func:`sorted_series`. Display headers and other column metadata go from a measure's
    column to its sum, and from the date to the period (whose header is then the grain's).
    """
    period = period_name or PERIOD_NAMES[grain]
    return (df.groupBy(*quoted_all(keys), _period(df, date_col, grain, period))
            .agg(*_carried(df, measures)))


def rollup_grains(df: DataFrame, date_col: str, grains: Sequence[str], measures: Measures,
                  keys: Sequence[str] = (), name: str = "grain") -> DataFrame:
    """Several grains in one aggregate (grouping sets): ``name`` (the grain), the keys, one period column a grain (NULL in
    rows of the other grains), and the measures. One pass and one exchange, where a roll-up each would take as many;
    :func:`grain_of` takes one grain out. Rows are multiplied by the number of grains before partial aggregation only."""
    periods = {g: PERIOD_NAMES[g] for g in grains}
    if len(periods) != len(grains) or not grains:
        raise ValueError(f"grains must be distinct and not empty, got {list(grains)}")
    wanted = [c for m in measures.values() for c in ([m] if isinstance(m, str) else [])]
    own = unused_names(df, *periods)
    whole = all(isinstance(m, str) for m in measures.values())
    base = df.select(*(quoted_all(dict.fromkeys([*keys, *wanted])) if whole else [F.col("*")]),
                     *[_period(df, date_col, g, own[g]) for g in grains])
    sets = [[*quoted_all(keys), quoted(own[g])] for g in grains]
    flags = F.coalesce(*[F.when(F.grouping(quoted(own[g])) == 0, F.lit(g)) for g in grains])
    out = base.groupingSets(sets, *quoted_all(keys), *[quoted(own[g]) for g in grains]).agg(flags.alias(name), *_carried(df, measures))
    metadata = {g: base.schema[own[g]].metadata or {} for g in grains}
    return out.select(quoted(name), *quoted_all(keys),
                      *[quoted(own[g]).alias(periods[g], **({"metadata": metadata[g]} if metadata[g] else {})) for g in grains],
                      *quoted_all(measures))


def grain_of(grains: DataFrame, grain: str, name: str = "grain") -> DataFrame:
    """The roll-up of one grain out of :func:`rollup_grains`, with the columns of :func:`rollup_series`."""
    others = [p for g, p in PERIOD_NAMES.items() if g != grain and p in grains.columns]
    return grains.where(quoted(name) == F.lit(grain)).drop(name, *others)


def global_sums(df: DataFrame, measures: Measures) -> DataFrame:
    """Aggregates with no key: a single output row (an empty input gives NULL sums, count 0)."""
    return df.agg(*_aggregates(measures))


def count_where(cond: Column) -> Column:
    """Aggregate: number of rows where ``cond`` holds, NULL when there is none.

    Used to build several series from one table in a single aggregate: each series' value is
    NULL in periods where it has no rows, exactly as if the series had been rolled up separately
    and combined by :func:`combine_series` (one scan and one shuffle instead of two plus a join).
    """
    return F.sum(F.when(cond, F.lit(1)))


def with_total(df: DataFrame, total: str, parts: Sequence[str], missing_as_zero: bool = False,
               on_overflow: str = "error") -> DataFrame:
    """``total = parts[0] + parts[1] + ...``; NULL when a part is NULL unless ``missing_as_zero``.

    Metadata that all parts share goes to the total, but for their display headers.
    An integer overflow raises (ANSI arithmetic) unless ``on_overflow="null"``, which gives NULL
    for that row (``try_add``) and keeps the others.
    """
    if on_overflow not in ("error", "null"):
        raise ValueError(f"on_overflow must be 'error' or 'null', got {on_overflow!r}")
    metadata = [f.metadata or {} for p in parts for f in df.schema.fields if f.name == p]
    shared = {k: v for k, v in metadata[0].items() if k != HEADER and all(m.get(k) == v for m in metadata)} if metadata else {}
    cols = quoted_all(parts)
    if missing_as_zero:
        cols = [F.coalesce(c, F.lit(0)) for c in cols]
    expr = cols[0]
    for c in cols[1:]:
        expr = F.try_add(expr, c) if on_overflow == "null" else expr + c
    out = df.withColumn(total, expr)
    return out.withMetadata(total, shared) if shared else out


def combine_series(left: DataFrame, right: DataFrame, on: str | Sequence[str] = "month",
                   total: str | None = None, parts: Sequence[str] | None = None,
                   missing_as_zero: bool = False, before=None, on_overflow: str = "error",
                   period: str | None = None) -> DataFrame:
    """Full outer join of two series on their period (and key) columns, plus an optional total.

    * The join key is the coalesce of both sides, so periods present on one side only keep their
      period value (the reference kept only the left key and lost them).
    * ``total = parts[0] + parts[1]``; NULL when one side is missing unless ``missing_as_zero``.
    * ``before`` cuts the result at ``period < before`` (``period``: the first of ``on`` unless given). A matched row has equal keys on both
      sides and an unmatched row has only its own, so cutting each input first is exactly the cut
      of the coalesced key — and it reaches both inputs' scans (a filter on the coalesced key
      after the join could not be pushed through the full outer join).

    When both inputs come from :func:`rollup_series` on the same keys they are already hash
    partitioned on them, so the join adds no shuffle of its own.
    """
    on = [on] if isinstance(on, str) else list(on)
    if before is not None:
        cut = period or on[0]
        left, right = before_filter(left, cut, before), before_filter(right, cut, before)
    df = left.join(right, on=on, how="full_outer")
    if total:
        if parts is None:
            parts = [c for c in left.columns if c not in on][:1] + [c for c in right.columns if c not in on][:1]
        df = with_total(df, total, parts, missing_as_zero, on_overflow)
    return df


def require_not_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Simple data quality: drop rows with a NULL (or NaN) in any of ``cols`` (pushed into the scan)."""
    types = dict(df.dtypes)
    for c in cols:
        df = df.filter(quoted(c).isNotNull())
        if types.get(c) in ("float", "double"):
            df = df.filter(~F.isnan(quoted(c)))
    return df


_DATE = re.compile(r"\d{4}-\d{2}-\d{2}$")


def _bound(value, dtype: str | None = None) -> Column:
    """A bound as a column. A text in date form is a DATE, unless the column it bounds is known to
    be text; any other text is taken as it is."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str) and dtype != "string" and _DATE.match(value):
        return F.to_date(F.lit(value))
    return F.lit(value)


def _dtype(df: DataFrame, col: str) -> str | None:
    return df.select(quoted(col)).dtypes[0][1]


def before_filter(df: DataFrame, col: str, bound) -> DataFrame:
    """Rows with ``col < bound``; a date as text is a DATE (constant-folded), also against a timestamp."""
    return df.filter(quoted(col) < _bound(bound, _dtype(df, col)))


def between_filter(df: DataFrame, col: str, low, high) -> DataFrame:
    """Rows with ``low <= col <= high`` (closed range). Dates as text or ``date`` values count whole: a
    timestamp on the last day is inside."""
    dtype = _dtype(df, col)
    lo, hi = _bound(low, dtype), _bound(high, dtype)
    whole_day = (isinstance(high, str) and _DATE.match(high)) or (
        isinstance(high, datetime.date) and not isinstance(high, datetime.datetime))
    if dtype.startswith("timestamp") and whole_day:
        return df.filter((quoted(col) >= lo) & (quoted(col) < F.date_add(hi, 1)))
    return df.filter(quoted(col).between(lo, hi))


def split_at(df: DataFrame, col: str, threshold) -> tuple[DataFrame, DataFrame]:
    """(``col <= threshold``, ``col > threshold``): a train / test split on an ordered column."""
    t = _bound(threshold, _dtype(df, col))
    return df.filter(quoted(col) <= t), df.filter(quoted(col) > t)


def split_label(col: str, threshold, below: str = "train", above: str = "test", dtype: str | None = None) -> Column:
    """``below`` where ``col <= threshold``, ``above`` where ``col > threshold``, NULL for NULL —
    the two sides of :func:`split_at` as a column, to aggregate both splits in one pass. ``dtype`` is the
    column's type: with ``"string"`` a threshold in date form stays text (a column alone doesn't tell)."""
    t = _bound(threshold, dtype)
    return F.when(quoted(col) <= t, F.lit(below)).when(quoted(col) > t, F.lit(above))


def known_until(col: str, threshold, value: str, dtype: str | None = None) -> Column:
    """``CASE WHEN col <= threshold THEN value END`` — the value only where it was known. ``dtype`` as in
    :func:`split_label`."""
    return F.when(quoted(col) <= _bound(threshold, dtype), quoted(value))


def tie_breakers(df: DataFrame, by: Sequence[str | Column]) -> list[Column]:
    """The orderable columns of ``df`` not already sorted on, as extra sort keys.

    A global sort range-partitions on its keys, and equal keys cannot be split: a value shared by
    a third of the rows would land in one task. Sorting on the remaining columns too lets the
    partitioner split such a value, and makes the output order deterministic.
    """
    from pyspark.sql.types import ArrayType, MapType, StructType
    named = {b for b in by if isinstance(b, str)}
    return [quoted(f.name) for f in df.schema.fields
            if f.name not in named and not isinstance(f.dataType, (MapType, ArrayType, StructType))]


def sorted_series(df: DataFrame, *by: str | Column, ascending: bool = True, position: str | None = None) -> DataFrame:
    """Global sort; apply once, as the last step (range exchange + per-partition sort). Ties are
    broken by the other columns (see :func:`tie_breakers`). ``position`` names a column for the place of each
    row in the order, see :func:`with_position`."""
    cols = [as_col(b) for b in by] + tie_breakers(df, by)
    ordered = df.orderBy(*[c.asc() if ascending else c.desc() for c in cols])
    return ordered if position is None else with_position(ordered, position)


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """The place (from 1) of every row of a frame that is in order (``orderBy``, or files read in their order), without one
    window over everything.

    The frame is checkpointed, which fixes its partitions and the rows in them. Each partition is counted, prefix sums of the
    counts (one row a partition, the only rows that meet in one task) say how many rows lie before it, and the row
    number inside the partition is added.
    """
    from pyspark.sql.window import Window

    from ..session import materialize
    free = unused_names(ordered, "part", "row", "before", "size")
    fixed = materialize(ordered)
    # monotonically_increasing_id: the partition in the upper bits, the row inside it in the lower 33
    own = fixed.select("*", F.monotonically_increasing_id().alias(free["row"]))
    own = own.select(*quoted_all(fixed.columns), F.shiftright(quoted(free["row"]), 33).alias(free["part"]),
                     quoted(free["row"]).bitwiseAND(F.lit((1 << 33) - 1)).alias(free["row"]))
    sizes = own.groupBy(free["part"]).agg(F.count(F.lit(1)).alias(free["size"]))
    before = F.sum(free["size"]).over(Window.orderBy(free["part"]).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(free["part"], F.coalesce(before, F.lit(0)).alias(free["before"]))
    # one row a partition: small by construction
    return own.join(F.broadcast(starts), free["part"]).select(
        *quoted_all(fixed.columns), (quoted(free["before"]) + quoted(free["row"]) + 1).alias(name))


def latest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``by`` (a top-n: each task keeps n rows, one merge).
    Ties at the boundary are broken by the other columns, so the result is deterministic."""
    return df.orderBy(quoted(by).desc(), *[c.desc() for c in tie_breakers(df, [by])]).limit(n)


def union_series(df: DataFrame, other: DataFrame) -> DataFrame:
    """Union by column name; columns missing on either side are NULL."""
    return df.unionByName(other, allowMissingColumns=True)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns by name; names that don't exist are ignored. The scan then reads fewer columns."""
    return df.drop(*names)
