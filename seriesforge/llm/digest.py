"""Improbable-feature digests of documents, and their likeness.

Every 64-byte window has a collision entropy, from the number of equal byte pairs in it. How
rare a value is, is counted over the whole corpus. A window that is the rarest of ``POPULAR`` or
more of the 64-window stretches around it is a feature. Features go, in text order, into a chain
of Bloom filters (2048 bits, 5 bits a feature, at most 160 different features each), so a digest
grows with its text. Likeness is the normalised overlap of bits: for each filter of the digest
with fewer filters, the best overlap beyond chance with a filter of the other, averaged.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 64
STRETCH = 64
POPULAR = 16
BITS = 2048
PROBES = 5
PER_FILTER = 160
PAIRS = WINDOW * (WINDOW - 1) // 2
CHUNK = 1 << 18


def equal_pairs(data: np.ndarray) -> np.ndarray:
    """For every window of 64 bytes, the number of pairs of equal bytes in it."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        ahead[:-lag] += same
        behind[lag:] += same
    # sliding by one loses the pairs of the first byte and gains those of the new last byte
    first = int(sum(int(behind[i]) for i in range(min(WINDOW, len(data)))))
    step = behind[WINDOW:].astype(np.int32) - ahead[:n - 1]
    return first + np.concatenate([[0], np.cumsum(step, dtype=np.int32)]).astype(np.int32)


def _inside(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` positions start a run of ``width`` that ends within its text."""
    step = np.zeros(n + width + 1, np.int32)
    long = (starts[1:] - starts[:-1]) >= width
    np.add.at(step, starts[:-1][long], 1)
    np.add.at(step, starts[1:][long] - width + 1, -1)
    return np.cumsum(step)[:n] > 0


def features(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected features of all texts in a buffer, and the text of each, in order.

    ``rank[pairs]`` is how common that count is; the lowest is the most improbable. A text
    shorter than a window has one feature, all of it, unless it is empty.
    """
    n = len(data) - WINDOW + 1
    size = starts[1:] - starts[:-1]
    hashes, docs = [], []
    if n > 0 and (size >= WINDOW).any():
        ok = _inside(starts, n, WINDOW)
        score = (rank[equal_pairs(data)].astype(np.int64) << 40) | np.arange(n)
        score = np.where(ok, score, np.int64(1) << 62)
        low = common.sliding_min(score, STRETCH)
        at = np.flatnonzero(_inside(starts, max(n - STRETCH + 1, 0), WINDOW + STRETCH - 1))
        pos = low[at] & ((1 << 40) - 1)
        cut = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]])) if len(pos) else np.zeros(0, np.int64)
        popular = np.diff(np.concatenate([cut, [len(pos)]])) >= POPULAR
        chosen = pos[cut][popular]
        # every text has its rarest window, however short or even it is
        full = np.flatnonzero(size >= WINDOW)
        own = np.minimum.reduceat(np.concatenate([score, np.full(WINDOW, np.int64(1) << 62)]), starts[:-1][full])
        chosen = np.unique(np.concatenate([chosen, own & ((1 << 40) - 1)]))
        words = np.ascontiguousarray(data[chosen[:, None] + np.arange(WINDOW)]).view(np.uint64)
        h = np.zeros(len(chosen), np.uint64)
        for i in range(words.shape[1]):
            h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15 | 1) + words[:, i])
        hashes.append(h)
        docs.append(np.searchsorted(starts, chosen, "right") - 1)
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    if len(short):
        grid = np.zeros((len(short), WINDOW), np.uint8)
        for i, d in enumerate(short):
            grid[i, :size[d]] = data[starts[d]:starts[d + 1]]
        h = size[short].astype(np.uint64)
        for i in range(WINDOW // 8):
            h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15 | 1) + grid.view(np.uint64)[:, i])
        hashes.append(h)
        docs.append(short)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(hashes)[order], doc[order]


def digest(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters (rows of bits) and the number of features of each."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    chain = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((chain, BITS), np.uint8)
    link = np.arange(len(hashes)) // PER_FILTER
    for k in range(PROBES):
        bits[link, (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
    return bits, np.bincount(link, minlength=chain)


def encoded(d: tuple[np.ndarray, np.ndarray]) -> str:
    bits, count = d
    return base64.b64encode(struct.pack("<I", len(count)) + count.astype("<u2").tobytes()
                            + np.packbits(bits, axis=1).tobytes()).decode()


def decoded(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(text)
    n = struct.unpack_from("<I", raw)[0]
    count = np.frombuffer(raw, "<u2", n, 4).astype(np.int64)
    packed = np.frombuffer(raw, np.uint8, n * BITS // 8, 4 + 2 * n).reshape(n, BITS // 8)
    return np.unpackbits(packed, axis=1), count


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; equal digests are 1, also two empty ones; an empty with another is 0."""
    if a[0].shape == b[0].shape and (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    if not len(a[1]) or not len(b[1]):
        return 0.0
    if len(a[1]) > len(b[1]):
        a, b = b, a
    x, y = a[0].astype(np.float32), b[0].astype(np.float32)
    overlap = (x @ y.T).astype(np.float64)
    nx, ny = x.sum(axis=1, dtype=np.float64)[:, None], y.sum(axis=1, dtype=np.float64)[None, :]
    chance = nx * ny / BITS
    most = np.minimum(nx, ny)
    score = np.clip((overlap - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(np.average(score.max(axis=1), weights=a[1]))


def _pair_counts(batches):
    total = np.zeros(PAIRS + 1, np.int64)
    for batch in batches:
        for _, data, starts in common.byte_chunks(batch.column(0), CHUNK):
            n = len(data) - WINDOW + 1
            if n > 0:
                total += np.bincount(equal_pairs(data)[_inside(starts, n, WINDOW)], minlength=PAIRS + 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pairs", "n"])


def rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of every pair count by how often it occurs over all windows of all texts; 0 is the rarest."""
    docs = common.texts(df.withColumn("_id", F.lit(0).cast("long")), "_id", text_col)
    rows = (common.spread(docs.select(F.col("text").cast("binary"))).mapInArrow(_pair_counts, "pairs long, n long")
            .groupBy("pairs").agg(F.sum("n").alias("n")).collect())     # at most 2017 rows
    n = np.zeros(PAIRS + 1, np.int64)
    for r in rows:
        n[r["pairs"]] = r["n"]
    rank = np.empty(PAIRS + 1, np.int64)
    rank[np.lexsort((np.arange(PAIRS + 1), n))] = np.arange(PAIRS + 1)
    return rank


def _digests(texts: list[bytes], rank: np.ndarray):
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h, doc = features(np.frombuffer(b"".join(texts), np.uint8), starts, rank)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [digest(h[cut[i]:cut[i + 1]]) for i in range(len(texts))]


def fingerprints(df: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row: base64 of the chained filters. Null texts are empty;
    an empty text has an empty chain; equal texts have equal fingerprints (for one ``rank``)."""
    def fn(batches):
        for batch in batches:
            for row, data, starts in common.byte_chunks(batch.column(1), CHUNK):
                parts = [data[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(parts)), pa.array([encoded(d) for d in _digests(parts, rank)])],
                    names=["doc_id", "fingerprint"])
    docs = common.texts(df, id_col, text_col).select("doc_id", F.col("text").cast("binary"))
    return common.spread(docs).mapInArrow(fn, "doc_id long, fingerprint string")


def edited(text: str, nxt: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + nxt[:half]


def _neighbours(rank: np.ndarray):
    """Rows of a range of ids in order, with the first row of the next range as the last."""
    def fn(frames):
        held: list[tuple] = []          # (doc_id, text, is a guest from the next range)
        size = 0

        def flush():
            rows = [r for r in held if not r[2]]
            if not rows:
                return None
            plain = [r[1] for r in held]
            news = [edited(a[1], b[1]) for a, b in zip(held, held[1:])]
            if len(news) < len(rows):           # the only row of the table is its own next one
                news.append(edited(held[-1][1], held[0][1]))
                nxt = [*range(1, len(held)), 0]
            else:
                nxt = list(range(1, len(held)))
            coded = _digests([t.encode() for t in plain], rank)
            changed = _digests([t.encode() for t in news], rank)
            return pd.DataFrame({
                "doc_id": [r[0] for r in rows], "n_chars": [len(r[1]) for r in rows], "edited": news[:len(rows)],
                "fingerprint": [encoded(d) for d in coded[:len(rows)]],
                "edited_fingerprint": [encoded(d) for d in changed[:len(rows)]],
                "near_edited": [likeness(coded[i], changed[i]) for i in range(len(rows))],
                "near_next": [likeness(coded[i], coded[nxt[i]]) for i in range(len(rows))]})

        rng = None
        for pdf in frames:
            for r, doc_id, guest, text in zip(pdf["rng"], pdf["doc_id"], pdf["guest"], pdf["text"]):
                if rng is not None and r != rng:
                    out = flush()
                    if out is not None:
                        yield out
                    held, size = [], 0
                rng = r
                held.append((doc_id, text, bool(guest)))
                size += len(text)
                if size > CHUNK and len(held) > 1 and not guest:
                    last = held[-1]
                    held[-1] = (last[0], last[1], True)     # shown as the next one, then starts anew
                    yield flush()
                    held, size = [last], len(last[1])
        if held:
            out = flush()
            if out is not None:
                yield out
    return fn


def edit_probe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next one (ascending id, repeated ids by
    text hash; the last one's next is the first): ``doc_id, n_chars, edited, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    Ids are dealt to ranges cut at quantiles; one row per range, the first, also goes to the range
    before it, so texts move once. A table of one row is its own next one. Null texts are
    empty; rows with a null id come first in the order. An empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = common.texts(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rank = rarity(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    key = F.coalesce("doc_id", F.lit(-2**63))
    cuts = docs.select(key.cast("double").alias("k")).approxQuantile(
        "k", [i / parts for i in range(1, parts)], 0.25 / parts)
    cuts = sorted({int(c) for c in cuts})
    # the range of an id: how many of the cuts, fewer than `parts`, are at or below it
    rng = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= key)) if cuts else F.lit(0)
    placed = docs.withColumn("rng", rng)
    # the first row of each range, by (id, tie); at most `parts` rows, and only keys
    firsts = placed.groupBy("rng").agg(F.min(F.struct("doc_id", "tie")).alias("first")).orderBy("rng").collect()
    if not firsts:
        firsts = [(0, None)]
    before = [firsts[-1][0]] + [r[0] for r in firsts[:-1]]
    # the same id and text may come in several rows: one of them is enough as a guest
    wanted = spark.createDataFrame(
        [(r[1][0], r[1][1], b) for r, b in zip(firsts, before) if r[1] is not None],
        "first_id long, first_tie long, before int")
    guests = (docs.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
              .dropDuplicates(["before"]).select("doc_id", "text", "tie", F.col("before").alias("rng"), F.lit(1).alias("guest")))
    rows = placed.select("doc_id", "text", "tie", "rng", F.lit(0).alias("guest")).unionByName(guests)
    return (rows.repartition("rng").sortWithinPartitions("rng", "guest", "doc_id", "tie")
            .select("rng", "doc_id", "guest", "text")
            .mapInPandas(_neighbours(rank), "doc_id long, n_chars long, edited string, fingerprint string, "
                         "edited_fingerprint string, near_edited double, near_next double"))
