"""Helpers shared by the operators: text as byte buffers, sorted groups, blocks, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.session import materialize, scratch_path

CHUNK_BYTES = 1 << 20
ARROW_ROWS = 1024


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long, may be null) and ``text`` (string, null becomes empty) of ``df``."""
    return df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"),
                     F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` ready for CPU-bound Python: at least a few partitions per core, as a small file must not
    keep a scan on one. Also holds the session's Arrow batches to ``ARROW_ROWS`` rows: texts can
    be long, and a batch is in memory several times, in the JVM and in Python."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    want = 4 * spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def byte_chunks(array, size: int = CHUNK_BYTES):
    """Slices of an Arrow binary array as ``(first row, bytes, starts)``: whole rows, about
    ``size`` bytes each (a longer row is a slice of its own); ``starts`` has one more entry."""
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        stop = min(stop, n)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    out = x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:len(out) - rest], out[rest:])
    return out


def by_group(frames, cols: list[str]):
    """Consecutive rows with equal integer ``cols`` as a dict of arrays each. The frames come
    from a partition sorted by ``cols``; a group may span frames, and only one is held."""
    held: list[dict] = []
    key = None
    for pdf in frames:
        if not len(pdf):
            continue
        arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
        keys = np.stack([arrays[c] for c in cols], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(pdf)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = {c: v[a:b] for c, v in arrays.items()}
            if held and tuple(keys[a]) == key:
                held.append(part)
                continue
            if held:
                yield _joined(held)
            held, key = [part], tuple(keys[a])
    if held:
        yield _joined(held)


def _joined(parts: list[dict]) -> dict:
    if len(parts) == 1:
        return parts[0]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def block_pairs(members: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """Deal the members of every group with two or more into pairs of blocks.

    A group of n members is cut into ceil(n / size) blocks; each member goes to every pair that
    holds its block, so two members meet in exactly one pair ``(bi, bj)`` and no task gets
    more than about ``2 * size`` members, however large a group is. ``blk`` is the own block.
    """
    n = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(float(size))).cast("int")
    return (members.join(n, group)
            .withColumn("_nb", blocks)
            .withColumn("blk", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int"))
            .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .withColumn("bi", F.least("blk", "_j")).withColumn("bj", F.greatest("blk", "_j"))
            .drop("_n", "_nb", "_j"))


def in_groups(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of a group in one partition, next to each other."""
    return df.repartition(*cols).sortWithinPartitions(*cols)


def stars(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of a boolean link matrix as pairs (id, smallest id), own pairs left out."""
    order = np.argsort(ids, kind="stable")
    linked = linked[order][:, order] | np.eye(len(ids), dtype=bool)
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None, :], len(ids)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    low = ids[order][label]
    keep = low != ids[order]
    return ids[order][keep], low[keep]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges ``(a, b)``: ``(id, component)`` for every
    node on an edge, ``component`` the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until nothing changes, a
    logarithmic number in practice. Each round is joins on node ids against pre-aggregated
    minima, so a node with very many edges can be split by the planner; each ends in a
    reliable checkpoint.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct())
    state = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))))
                 .select(F.col("col.x").alias("a"), F.col("col.m").alias("b")).where("a <> b").distinct())
        e = materialize(small)
        row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
