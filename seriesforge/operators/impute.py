"""Missing months of a partial year: find them and fill them in, per key, in one plan.

The reference filled the months after the last known one with ``sum(year) / (12 - known)`` for
each measure (integer division), assuming the known months were January..k. Here the known months
may be any subset (real gaps are found), every key is handled in the same aggregate, and the
count, the sums, the calendar and the append all stay inside the plan:

    series ── groupBy(keys): months of the year present, sums over the year ──(1 shuffle)──
        explode(the months not known) → imputed rows ── unionByName ── original rows

The set of known months per key holds at most twelve values whatever the input size, so the
aggregate state is bounded; partial aggregation runs before the shuffle. The year is selected
inside the aggregate (conditional aggregates) rather than by a filter in front of it: when the
series is itself a roll-up, a filter on its month would be pushed through that roll-up into a
second scan of the raw input, while the conditional form shares the roll-up's shuffle with the
appended original rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, LongType

from ..functions.dates import month_start
from ..functions.names import quoted, quoted_all, unused_names

METHODS = ("spread", "mean")


def _in_year(date_col: str, year: int):
    return F.year(quoted(date_col)) == F.lit(year)


def _known_months(df: DataFrame, date_col: str, year: int, keys: Sequence[str], extra=()) -> DataFrame:
    """Per key: the sorted months of ``year`` present (collect_set skips the NULLs of other years)."""
    known = F.collect_set(F.when(_in_year(date_col, year), F.month(quoted(date_col))))
    return df.groupBy(*quoted_all(keys)).agg(F.array_sort(known).alias(unused_names(df, "known")["known"]), *extra)


def _missing(known) -> "F.Column":
    return F.filter(F.sequence(F.lit(1), F.lit(12)), lambda m: ~F.array_contains(known, m))


def calendar_gaps(df: DataFrame, date_col: str, year: int, keys: Sequence[str] = (),
                  out: str = "month") -> DataFrame:
    """Month starts of ``year`` that have no row, per key (keys that have rows in that year)."""
    own = unused_names(df, "known", "m")
    known = _known_months(df, date_col, year, keys).where(F.size(own["known"]) > 0)
    return known.select(*quoted_all(keys), F.explode(_missing(quoted(own["known"]))).alias(own["m"])).select(
        *quoted_all(keys), F.make_date(F.lit(year), quoted(own["m"]), F.lit(1)).alias(out))


def calendar_gaps_all(df: DataFrame, date_col: str, keys: Sequence[str] = (), out: str = "month") -> DataFrame:
    """Month starts without a row between the first and the last month of each key, over any number of years.

    A calendar per key (``sequence`` from its first to its last month, from one aggregate of two values a key) minus the
    months it has: a left anti join on key and month, so a key with very many rows is spread by its months. Rows with
    a NULL date count for nothing; NULL keys are keys like any other. A key without gaps, or without dates, gives no rows.
    """
    own = unused_names(df, "m", "first", "last", "months", *[f"key{i}" for i in range(len(keys))])
    month = quoted(own["m"])
    known = (df.where(quoted(date_col).isNotNull())
             .select(*[quoted(k).alias(own[f"key{i}"]) for i, k in enumerate(keys)], month_start(date_col).alias(own["m"])).distinct())
    own_keys = [own[f"key{i}"] for i in range(len(keys))]
    # (a count too: bounds alone would be planned from the raw rows, a second reading of the input)
    spans = known.groupBy(*quoted_all(own_keys)).agg(F.min(month).alias(own["first"]), F.max(month).alias(own["last"]),
                                                     F.count(F.lit(1)).alias(own["months"]))
    # (no key, no rows: the aggregate of nothing has NULL bounds, and no sequence)
    spine = spans.select(*[quoted(o).alias(f"{o}_") for o in own_keys],
                         F.explode(F.when(quoted(own["months"]) > 0, F.sequence(own["first"], own["last"], F.expr("INTERVAL 1 MONTH"))))
                         .alias(f"{own['m']}_"))
    # (null-safe in the month as well, which is never NULL: else a filter would set this use of the months apart from the other)
    on = quoted(f"{own['m']}_").eqNullSafe(month)
    for o in own_keys:
        on = on & quoted(f"{o}_").eqNullSafe(quoted(o))
    return spine.join(known, on, "left_anti").select(*[quoted(f"{o}_").alias(k) for o, k in zip(own_keys, keys)],
                                                     quoted(f"{own['m']}_").alias(out))


def impute_year(df: DataFrame, date_col: str, year: int, measures: Sequence[str],
                keys: Sequence[str] = (), method: str = "spread",
                copies: Mapping[str, str] | None = None, flag: str | None = "imputed") -> DataFrame:
    """Append one row per missing month of ``year`` (per key) to a monthly series.

    * ``spread`` (the reference's rule): each missing month gets ``sum / number of missing months``.
    * ``mean``: each missing month gets ``sum / number of known months``.

    Integral measures become BIGINT and use integer division truncating toward zero (``div``); decimal and floating
    measures use true division, cast back to the measure's type. A key with all twelve months known
    or with no row in ``year`` gets no rows. ``copies`` = {new: measure} adds a copy of a measure
    that stays NULL on imputed rows (to keep the reported values apart), ``flag`` a boolean column.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    copies = dict(copies or {})
    fields = {f.name: f for f in df.schema.fields}
    # a share of a sum may not fit the measure's type: integral measures become BIGINT
    wide = [m for m in measures if isinstance(fields[m].dataType, IntegralType)]
    df = df.select(*[quoted(c).cast("bigint").alias(c, metadata=fields[c].metadata or {}) if c in wide else quoted(c)
                     for c in df.columns])
    types = {c: LongType() if c in wide else f.dataType for c, f in fields.items()}
    own = unused_names(df, "known", "divisor", "m", *[f"sum_{i}" for i in range(len(measures))])
    sums = [F.sum(F.when(_in_year(date_col, year), quoted(m))).alias(own[f"sum_{i}"]) for i, m in enumerate(measures)]
    known = _known_months(df, date_col, year, keys, sums)
    k = F.size(own["known"])
    divisor = (F.lit(12) - k) if method == "spread" else k

    def share(i: int, m: str):
        total, by = quoted(own[f"sum_{i}"]), quoted(own["divisor"])
        if isinstance(types[m], IntegralType):
            value = F.call_function("div", total, by)
        elif isinstance(types[m], DecimalType):
            value = total / by
        else:
            value = F.try_divide(total, by)
        return value.cast(types[m]).alias(m)

    imputed = (known
               .withColumn(own["divisor"], divisor)
               .where((quoted(own["divisor"]) > 0) & (k > 0))
               .select(*quoted_all(keys), *[quoted(own[f"sum_{i}"]) for i in range(len(measures))], quoted(own["divisor"]),
                       F.explode(_missing(quoted(own["known"]))).alias(own["m"]))
               .select(*quoted_all(keys), F.make_date(F.lit(year), quoted(own["m"]), F.lit(1)).cast(types[date_col]).alias(date_col),
                       *[share(i, m) for i, m in enumerate(measures)]))
    base = df
    for new, src in copies.items():
        base = base.withColumn(new, quoted(src))
        imputed = imputed.withColumn(new, F.lit(None).cast(types[src]))
    if flag:
        base = base.withColumn(flag, F.lit(False))
        imputed = imputed.withColumn(flag, F.lit(True))
    return base.unionByName(imputed, allowMissingColumns=True)
