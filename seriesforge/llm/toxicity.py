"""Toxicity by compression distance.

Two raw zstandard dictionaries are trained on labelled text. The ordinary one holds the word
beginnings that ordinary documents use most. The toxic one holds the same, so that ordinary text
compresses alike with both, and those that toxic documents use far more often. A window of
words that compresses shorter with the toxic dictionary speaks for toxicity. How many windows
gain at least 1, 2, ... 8 bytes, their shares, and the mean gain go through a logistic calibration
fitted on the same labelled rows: it sets the worth of every one of these thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TOXIC, MAX_ORDINARY = 4_000, 8_000      # labelled documents used to fit, by smallest hash of the id
WINDOW_WORDS = 4
WINDOW_BYTES = 256                          # a window is cut here if its words are very long
BEGINNINGS = (4, 5, 6, 8, 12)               # characters of a word's beginning that are counted
ORDINARY, CANDIDATES, TOXIC = 2048, 4000, 128
LEAST_Z, LEAST_ODDS, OF_BEST = 4.0, 2.0, 0.25   # how far a toxic beginning stands out, and against the best one
LEVEL = 6
LEVELS = 8                                  # least gains in bytes, from 1, that the calibration weighs
# Starts every window and ends both dictionaries: a window is always compressible as a whole, so
# small gains show, where zstandard would store a window raw that saves only a few bytes.
LEAD = b"0123456789abcdefghijklmnopqrstuvwxyz!#$%&/=?+*-_:;<>"


@dataclass(frozen=True)
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    least: int = 3                          # bytes saved that make a window count in reports
    weights: tuple[float, ...] = ()
    threshold: float = 0.7
    n_toxic: int = 0
    n_ordinary: int = 0
    words: tuple[str, ...] = field(default=(), repr=False)


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """All of a text in windows of whole words, lower case, white space as one blank."""
    w = text.lower().encode().split()
    out = []
    for i in range(0, len(w), words):
        part = b" ".join(w[i:i + words])
        if len(part) <= WINDOW_BYTES:
            out.append(LEAD + b" " + part)
        else:
            out += [LEAD + b" " + part[j:j + WINDOW_BYTES] for j in range(0, len(part), WINDOW_BYTES)]
    return out


def _packer(data: bytes):
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                    write_dict_id=False).compress


def _features(model: Model):
    if not model.weights and not model.words:
        return lambda text: []
    toxic, ordinary = _packer(model.toxic), _packer(model.ordinary)

    def of(text: str) -> list[int]:
        """Bytes saved by the toxic dictionary, window by window."""
        return [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]
    return of


def _measure(of, texts: list[str]):
    """Per text: windows, their mean gain in bytes, how many gain how much (0 to 12 and more), all gains."""
    count, mean = np.zeros(len(texts)), np.zeros(len(texts))
    table, every = np.zeros((len(texts), 13), np.int64), []
    for i, t in enumerate(texts):
        saved = of(t)
        every.append(saved)
        if saved:
            count[i], mean[i] = len(saved), sum(saved) / len(saved)
            table[i] = np.bincount(np.clip(saved, 0, 12), minlength=13)
    return count, mean, table, every


def _inputs(windows, mean, gains) -> np.ndarray:
    """Model inputs: 1, mean gain, log of the windows, and for every least gain the log of the windows that
    reach it and the root of their share."""
    reach = gains[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:LEVELS + 1]
    share = np.sqrt(reach / np.maximum(windows, 1)[:, None])
    return np.column_stack([np.ones(len(gains)), mean, np.log1p(windows), np.log1p(reach), share])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(label_col: str = "label", id_col: str = "doc_id"):
    """The rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1) & F.col(label_col).isNotNull()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, threshold: float = 0.7) -> Model:
    """Train both dictionaries and the calibration.

    At most ``max_toxic`` and ``max_ordinary`` labelled documents are used, those with the smallest hash
    of their id, whole texts; ids with several labels count as toxic if one is. Null labels are
    left out. Without documents of both kinds the model scores 0 everywhere.
    """
    known = (labels.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"),
                           F.col(common.quoted(label_col)).cast("int").alias("label"))
             .where("doc_id is not null").where(training_rows())
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = (known.where("label = 1").orderBy(*order).limit(max_toxic)
              .unionByName(known.where("label = 0").orderBy(*order).limit(max_ordinary)))
    # at most max_toxic + max_ordinary rows of two numbers
    rows = common.save(common.texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
                       .select("doc_id", "text", "label"), "labelled")
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    if not n1 or not n0:
        return Model(threshold=threshold)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= BEGINNINGS[0] - 1)
    parts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, n) for n in BEGINNINGS]))))
    seen = (common.spread(rows).select("label", F.explode(parts).alias("w"))
            .groupBy("w").agg(F.sum("label").cast("long").alias("n1"),
                              F.sum(1 - F.col("label")).cast("long").alias("n0")))
    share = (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-9)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    seen = common.save(seen.where("n1 + n0 > 1").withColumn("z", z).withColumn("odds", odds), "beginnings")
    # reports of at most CANDIDATES and ORDINARY words
    tilted = (seen.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS) & (F.col("n1") >= 3))
              .orderBy(F.desc("z"), "w").limit(CANDIDATES).collect())
    toxic: list[str] = []
    for r in tilted:
        if len(toxic) >= TOXIC or r["z"] < OF_BEST * tilted[0]["z"]:
            break
        if not any(r["w"].startswith(k[:4]) or k.startswith(r["w"]) for k in toxic):
            # the longest extension that is nearly as telling
            toxic.append(max((x["w"] for x in tilted if x["w"].startswith(r["w"]) and x["z"] >= 0.8 * r["z"]), key=len))
    if not toxic:
        return Model(threshold=threshold, n_toxic=n1, n_ordinary=n0)
    plain = [r["w"] for r in seen.where("n0 > 0").orderBy(F.desc("n0"), "w").limit(ORDINARY).collect()]
    plain = [w for w in plain if not any(w.startswith(k[:4]) for k in toxic)]

    def dictionary(words):
        # the most telling words last, where they are cheapest to refer to
        return (" " + " ".join(words) + " ").encode() + LEAD
    model = Model(toxic=dictionary([*plain[::-1], *toxic[::-1]]), ordinary=dictionary(plain[::-1]),
                  threshold=threshold, n_toxic=n1, n_ordinary=n0, words=tuple(toxic))

    def measured(batches):
        of = _features(model)
        for batch in batches:
            n, mean, table, _ = _measure(of, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(mean), pa.array(table.tolist(), pa.list_(pa.int64())),
                                              batch.column(1)], names=["windows", "mean", "gains", "label"])
    gained = (common.spread(rows.select("text", "label"))       # the bounded sample
              .mapInArrow(measured, "windows double, mean double, gains array<long>, label int").collect())
    g = np.array([r["gains"] for r in gained], np.int64)
    y = np.array([r["label"] for r in gained], np.float64)
    n, mean = (np.array([r[c] for r in gained], np.float64) for c in ("windows", "mean"))
    best = (-1.0, 3)
    for least in range(2, 9):
        hit = g[:, least:].any(axis=1)
        best = max(best, (round(float(hit[y == 1].mean() - hit[y == 0].mean()), 6), least))
    least = best[1]
    w = _logistic(_inputs(n, mean, g), y)
    return Model(model.toxic, model.ordinary, least, tuple(map(float, w)), threshold, n1, n0, model.words)


def _score(model: Model, of, texts: list[str]):
    """Score, windows that count and best window of each text."""
    if not model.weights:
        return np.zeros(len(texts)), np.zeros(len(texts), np.int64), [""] * len(texts)
    n, mean, table, every = _measure(of, texts)
    logit = _inputs(n, mean, table) @ np.array(model.weights)
    worst = []
    for t, saved in zip(texts, every):
        top = max(saved, default=0)
        worst.append(windows(t)[saved.index(top)][len(LEAD) + 1:].decode(errors="replace") if top >= model.least else "")
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500))), table[:, model.least:].sum(axis=1), worst


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, windows_hit, worst`` of every whole text; ``worst`` is the window
    that speaks loudest. Null texts are empty; an empty text gets the score of one without any
    telling window; repeated rows and null ids are rows like any other."""
    def fn(batches):
        of = _features(model)
        for batch in batches:
            p, hits, worst = _score(model, of, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= model.threshold).astype(np.int32)), pa.array(hits),
                 pa.array(worst, pa.string())], names=["doc_id", "score", "predicted", "windows_hit", "worst"])
    return common.spread(common.texts(df, id_col, text_col)).mapInArrow(
        fn, "doc_id long, score double, predicted int, windows_hit long, worst string")


def reject(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, as they are, whatever else their columns are
    called. Null texts count as empty."""
    at = df.columns.index(text_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def fn(batches):
        of = _features(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(_score(model, of, texts)[0] < model.threshold))
    return common.spread(plain).mapInArrow(fn, plain.schema).toDF(*df.columns)
