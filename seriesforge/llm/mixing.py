"""Mixing sources to target weights by Pfair scheduling.

With whole weights that sum to D, the k-th block of a source of weight w is released at slot
floor((k - 1) * D / w) and due before slot ceil(k * D / w). Earliest deadline first fills every slot and
meets every deadline, so at any slot each source has had its share to within less than one
block. The schedule repeats every D slots, so one period is a small table made from the weights
alone, and a block finds its slot by its rank: nothing is scheduled one row at a time.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REST = "*"
MOST_SOURCES = 1000     # sources that may have a weight each
BLOCK_ROWS = 16
HEX = 3                 # 4096 rank buckets per source


def schedule(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of ``sum(weights)`` slots; ties go by name."""
    if not weights or any(w <= 0 or w != int(w) for w in weights.values()):
        raise ValueError("weights must be positive whole numbers")
    period = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting: list[tuple[int, str]] = []                     # (release, source) of the next block
    ready: list[tuple[int, str]] = []                       # (deadline, source)
    for s in sorted(weights):
        heapq.heappush(waiting, (0, s))
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            k = len(slots[s]) + 1
            heapq.heappush(ready, (-(-k * period // weights[s]), s))
        due, s = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a deadline was missed")
        slots[s].append(t)
        if len(slots[s]) < weights[s]:
            heapq.heappush(waiting, (len(slots[s]) * period // weights[s], s))
    return slots


def source_weights(df: DataFrame, weights: dict[str, int], source_col: str = "source", most: int = MOST_SOURCES) -> dict[str, int]:
    """A weight for every source of ``df``: its own in ``weights``, else an equal part of the weight of ``"*"`` (1 if not given).

    A null source is one source, ``"*"``. Listed sources that have no rows get no slots. The sources are counted by one distinct
    aggregate; more than ``most`` are an error, as each has a part of the schedule, which the driver makes. Weights are whole
    numbers without a common divisor.
    """
    name = F.coalesce(F.col(common.quoted(source_col)).cast("string"), F.lit(REST))
    there = sorted(r[0] for r in df.select(name.alias("source")).distinct().limit(most + 1).collect())
    if len(there) > most:
        raise ValueError(f"more than {most} sources: give the others one name")
    own = {s: weights[s] for s in there if s in weights and s != REST}
    rest = [s for s in there if s not in own]
    if not there:
        return {REST: 1}
    share = weights.get(REST, 1)
    # the rest's weight cut in equal parts, everything in whole numbers
    out = {**{s: w * max(len(rest), 1) for s, w in own.items()}, **{s: share for s in rest}}
    divisor = math.gcd(*out.values())
    return {s: w // divisor for s, w in out.items()}


def mix(df: DataFrame, weights: dict[str, int], id_col: str = "doc_id", source_col: str = "source",
        block_rows: int = BLOCK_ROWS, carry: list[str] | None = None, complete: bool = False) -> DataFrame:
    """Place every row in the mixture: ``doc_id, mix_source, source_rank, block, slot, position`` and the
    columns in ``carry``.

    ``weights`` are whole numbers per source; a source that is null or not listed belongs to
    ``"*"`` (weight 1 if not given). With ``complete`` weights (from :func:`source_weights`) every source is listed, and a row of
    another one is an error. Inside a source rows are in a fixed shuffled order
    (md5 of the id, then the id, repeated ids in any order); ``block_rows`` rows make a block, the last
    may be smaller. ``slot`` is the block's place in the schedule, ``position`` = slot * block_rows + place
    in the block orders the rows. Sources end when they are out of rows: the rest goes on in its
    own slots; no row is dropped or repeated. Null ids are shuffled as the text "null".

    Ranks need no window over the rows of a source: rows are ranked inside 4096 buckets of their hash, and
    prefix sums of the bucket counts (4096 rows per listed source at most) give what stands before.
    """
    spark = df.sparkSession
    weights = {**({} if complete else {REST: 1}), **weights}
    slots = schedule(weights)
    period = sum(weights.values())
    names = [s for s in weights if s != REST]
    source = F.col(common.quoted(source_col)).cast("string")
    group = F.when(source.isin(names), source).otherwise(F.lit(REST)) if names else F.lit(REST)
    key = F.md5(F.coalesce(F.col(common.quoted(id_col)).cast("string"), F.lit("null")))
    rows = df.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), group.alias("mix_source"),
                     key.alias("mix_key"), F.substring(key, 1, HEX).alias("bucket"),
                     *[F.col(common.quoted(c)).alias(f"carry_{i}") for i, c in enumerate(carry or [])])
    counts = rows.groupBy("mix_source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("mix_source", "bucket", "coalesce(sum(n) over (partition by mix_source order by bucket "
                               "rows between unbounded preceding and 1 preceding), 0) as before")
    ranked = rows.selectExpr("*", "row_number() over (partition by mix_source, bucket order by mix_key, doc_id) - 1 as inner_rank")
    # on the keys the rows were ranked by: they stay where they are
    placed = ranked.join(before, ["mix_source", "bucket"])
    rank = F.col("before") + F.col("inner_rank")
    # one row per listed source
    period_of = spark.createDataFrame([(s, weights[s], at) for s, at in slots.items()], "mix_source string, w long, slots array<long>")
    placed = placed.join(F.broadcast(period_of), "mix_source", "left")
    block = F.floor(F.col("source_rank") / block_rows)
    slot = F.when(F.col("w").isNull(), F.raise_error(F.lit("a source without a weight"))).otherwise(
        F.floor(F.col("block") / F.col("w")) * period + F.element_at("slots", (F.col("block") % F.col("w") + 1).cast("int")))
    return (placed.withColumn("source_rank", rank).withColumn("block", block).withColumn("slot", slot.cast("long"))
            .withColumn("position", F.col("slot") * block_rows + F.col("source_rank") % block_rows)
            .select("doc_id", "mix_source", "source_rank", "block", "slot", "position",
                    *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry or [])]))
