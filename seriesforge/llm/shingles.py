"""N-gram Jaccard join of documents with Bayesian candidate pruning.

1. Every document becomes its set of word shingles (runs of ``words`` words), a set hash that
   makes equal sets one class, and MinHash values.
2. Classes that agree on all values of a band meet; with 20 bands of 3 a pair at Jaccard 0.8 is
   missed with probability (1 - 0.8**3)**20 = 6e-7.
3. Pairs that meet compare their MinHash values a few at a time. After n values with m equal, the
   posterior probability of Jaccard >= t under a uniform prior is P(Bin(n + 1, t) <= m); a pair
   is dropped once that falls below ``tolerance`` (BayesLSH, Satuluri and Parthasarathy 2012).
4. What survives is joined into clusters, and inside a cluster every pair of classes is compared
   exactly on whole shingle sets: a true link is lost only if a chain of 2 or 3 lost it.

Copies are counted, never expanded; lists and clusters of any size are cut into pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 3
STEP = 10
TOLERANCE = 1e-8
BLOCK = 512

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _P, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles of the texts in a buffer, and the text of each.

    Words are runs of bytes other than ASCII white space. A text with some but fewer than
    ``words`` words has one shingle, all its words; a text without words has none.
    """
    n_docs = len(starts) - 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    ink = ~_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = starts[1:-1][(starts[1:-1] < len(data))]
    first[inner] = ink[inner]                       # a text's first byte starts a word
    at = np.flatnonzero(first)
    if not len(at):
        return none
    word = np.cumsum(first)                         # 1-based word of each byte
    place = np.arange(len(data)) - at[np.maximum(word, 1) - 1]
    place = np.where(ink & (word > 0), place, 0)
    value = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    value[~ink] = 0
    h = common.mix64(np.add.reduceat(value, at), 1)
    doc = np.searchsorted(starts, at, "right") - 1
    count = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(count) - count
    # a shingle starts at each word that has words - 1 more behind it in its text, or at the first word
    length = np.minimum(words, count)[doc]
    rank = np.arange(len(at)) - begin[doc]
    ok = rank + length <= count[doc]
    src = np.flatnonzero(ok)
    total = np.zeros(len(src), np.uint64)
    for k in range(words):
        use = k < length[src]
        total = np.where(use, total * _P + h[np.minimum(src + k, len(h) - 1)], total)
    return common.mix64(total, 2), doc[src]


def _sketches(words: int, hashes: int):
    salts = np.random.default_rng(11).integers(1, 2**63, size=(hashes, 2), dtype=np.uint64)

    def fn(batches):
        for batch in batches:
            ids, rep = batch.column(0), batch.column(1)
            for row, data, starts in common.byte_chunks(rep):
                n = len(starts) - 1
                h, doc = shingle_hashes(data, starts, words)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                if len(h):
                    keep = np.ones(len(h), dtype=bool)
                    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    h, doc = h[keep], doc[keep]
                size = np.bincount(doc, minlength=n)
                some = np.flatnonzero(size)
                s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sig = np.zeros((n, hashes), np.uint32)
                if len(some):
                    at = (np.cumsum(size) - size)[some]
                    s1[some] = np.add.reduceat(common.mix64(h, 3), at)
                    s2[some] = np.add.reduceat(common.mix64(h, 4), at)
                    for j, (a, b) in enumerate(salts):
                        v = ((h ^ b) * (a | np.uint64(1))) >> np.uint64(32)
                        sig[some, j] = np.minimum.reduceat(v, at).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                    pa.array(size.astype(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["doc_id", "s1", "s2", "size", "sig"])
    return fn


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values out of ``n`` with posterior P(Jaccard >= threshold) >= tolerance."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def _survivors(hashes: int, threshold: float, tolerance: float, step: int):
    def fn(frames):
        checks = [(n, least_matches(n, threshold, tolerance)) for n in range(step, hashes + 1, step)]
        for g in common.by_group(frames, ["g", "bi", "bj"]):
            left = np.flatnonzero(g["blk"] == g["bi"])
            right = np.flatnonzero(g["blk"] == g["bj"])
            sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(len(g["id"]), hashes)
            size = g["size"].astype(np.float64)
            ratio = size[left][:, None] / size[right][None, :]
            alive = np.argwhere((np.minimum(ratio, 1 / ratio) >= threshold))
            a, b = left[alive[:, 0]], right[alive[:, 1]]
            use = g["id"][a] < g["id"][b] if g["bi"][0] == g["bj"][0] else g["id"][a] != g["id"][b]
            a, b = a[use], b[use]
            same = np.zeros(len(a), np.int64)
            for n, least in checks:
                same += (sig[a, n - step:n] == sig[b, n - step:n]).sum(axis=1)
                use = same >= least
                a, b, same = a[use], b[use], same[use]
            if len(a):
                m = np.zeros((len(g["id"]),) * 2, dtype=bool)
                m[a, b] = m[b, a] = True
                x, y = common.stars(g["id"], m)
                yield pd.DataFrame({"a": x, "b": y})
    return fn


def _whole_sets(words: int):
    def fn(batches):
        for batch in batches:
            for row, data, starts in common.byte_chunks(batch.column(1)):
                n = len(starts) - 1
                h, doc = shingle_hashes(data, starts, words)
                cut = np.searchsorted(doc, np.arange(n + 1))
                sets = [np.unique(h[cut[i]:cut[i + 1]]) for i in range(n)]
                sums = [np.array([common.mix64(s, k).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                        for k in (3, 4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sums[0]), pa.array(sums[1]), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["s1", "s2", "size", "shingles"])
    return fn


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Exact intersection sizes of every left with every right set, by blocked matrix products."""
    both = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, code, count = np.unique(both, return_inverse=True, return_counts=True)
    shared = count > 1
    owner, code = owner[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(left), len(right)), np.float32)
    row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    for lo in range(0, int(shared.sum()), columns):
        s, e = np.searchsorted(code, [lo, lo + columns])
        o, c = owner[s:e], code[s:e] - lo
        a, b = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        use = row_l[o] >= 0
        a[row_l[o[use]], c[use]] = 1
        use = row_r[o] >= 0
        b[row_r[o[use]], c[use]] = 1
        out += a @ b.T
    return out


def _verified(threshold: float):
    def fn(frames):
        for g in common.by_group(frames, ["g", "bi", "bj"]):
            left = np.flatnonzero(g["blk"] == g["bi"])
            right = np.flatnonzero(g["blk"] == g["bj"])
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            size = np.array([len(s) for s in sets], np.float64)
            common_ = _overlaps(sets, left, right).astype(np.float64)
            union = size[left][:, None] + size[right][None, :] - common_
            # at least threshold of the union, compared without a division
            hit = (common_ >= threshold * union - 1e-9) & (g["id"][left][:, None] != g["id"][right][None, :])
            if not hit.any():
                continue
            m = np.zeros((len(sets),) * 2, dtype=bool)
            m[np.ix_(left, right)] = hit
            x, y = common.stars(g["id"], m | m.T)
            ids, links = [g["id"][left]], [hit @ g["n"][right]]
            if g["bi"][0] != g["bj"][0]:
                ids.append(g["id"][right])
                links.append(g["n"][left] @ hit)
            ids, links = np.concatenate(ids), np.concatenate(links).astype(np.int64)
            yield pd.DataFrame({"a": np.concatenate([x, ids[links > 0]]),
                                "b": np.concatenate([y, ids[links > 0]]),
                                "links": np.concatenate([np.zeros(len(x), np.int64), links[links > 0]])})
    return fn


def shingle_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, step: int = STEP,
                 tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Near-duplicate classes: ``doc_id, n_links, class_id, kept``, one row per document.

    Two documents link when the Jaccard similarity of their shingle sets is >= ``threshold``;
    ``n_links`` counts all other documents linked, copies included; ``class_id`` is the smallest
    doc_id reachable by links, and ``kept`` marks that document (of repeated rows with that id,
    all). Null, empty and blank texts have no shingles and link with nothing: 0 links, own
    class, kept. Documents with fewer than ``words`` words link only with equal word
    sequences. A row with a null id links with nothing: 0 links, null class, kept. An empty table
    gives an empty result.
    """
    hashes = bands * rows
    docs = common.texts(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    sketch = common.save(
        common.spread(docs).mapInArrow(_sketches(words, hashes), "doc_id long, s1 long, s2 long, size long, sig binary"),
        "sketches")
    usable = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    classes = common.save(
        sketch.where(usable).groupBy("s1", "s2", "size")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"))
        .withColumn("id", F.xxhash64("s1", "s2", "size")), "classes")
    band = [F.xxhash64(F.lit(i), F.substring("sig", 4 * rows * i + 1, 4 * rows)) for i in range(bands)]
    listed = classes.select("id", F.explode(F.array(*band)).alias("g"))
    met = common.block_pairs(listed, "g", "id", block).join(classes.select("id", "size", "sig"), "id")
    near = (common.in_groups(met, ["g", "bi", "bj"])
            .mapInPandas(_survivors(hashes, threshold, tolerance, step), "a long, b long"))
    clusters = common.materialize(common.components(near).join(classes.select("id", "doc_id", "n"), "id"))
    # whole sets of the documents that stand for the clustered classes; the set hash picks the right row
    wanted = docs.join(clusters.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = (wanted.mapInArrow(_whole_sets(words), "s1 long, s2 long, size long, shingles binary")
            .select(F.xxhash64("s1", "s2", "size").alias("id"), "shingles").dropDuplicates(["id"]))
    inside = (common.block_pairs(clusters.withColumnRenamed("component", "g"), "g", "id", block)
              .join(sets, "id"))
    checked = common.save(common.in_groups(inside, ["g", "bi", "bj"])
                          .mapInPandas(_verified(threshold), "a long, b long, links long"), "links")
    links = checked.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    comp = common.components(checked.where("a <> b").select("a", "b"))
    comp = comp.join(classes.select("id", "doc_id"), "id")
    smallest = comp.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    found = (classes.select("id", "s1", "s2", "size", "doc_id", "n")
             .join(comp.select("id", "component").join(smallest, "component").select("id", "class_id"), "id", "left")
             .join(links, "id", "left")
             .select("s1", "s2", "size", F.coalesce("class_id", "doc_id").alias("class_id"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    linked = (sketch.where(usable).select("doc_id", "s1", "s2", "size").join(found, ["s1", "s2", "size"])
              .select("doc_id", "n_links", "class_id"))
    alone = sketch.where(~usable).select("doc_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("doc_id").alias("class_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
