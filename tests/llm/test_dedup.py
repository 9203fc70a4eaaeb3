"""The deduplicating operators against brute force."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from seriesforge.llm import common, digest, lines, pivots, shingles, suffixes

from . import helpers


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType())])


def test_pivots_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(30):
            base = rng.standard_normal(32)
            for _ in range(rng.integers(1, 6)):
                v = base + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.12, 0.2, 0.3])
                rows.append((int(i), v.astype(np.float32).tolist(), label))
                i += 1
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    comp = components(len(rows), list(zip(*np.nonzero(hit))))
    odd = [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] * 32, 0), (1003, [1.0] * 31 + [None], 0),
           (1004, rows[0][1], None), (1005, [float("inf")] * 32, 1), (None, rows[0][1], 0), (1006, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], VECTORS)
    got = {r["vec_id"]: r for r in pivots.embedding_dups(df, block=4).collect()}
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert found <= hit.sum() and found >= 0.99 * hit.sum() and hit.sum() > 50      # recall
    if found == hit.sum():
        assert [got[i]["component_id"] for i in range(len(rows))] == comp
    for r in odd:
        g = got[r[0]]
        assert (g["n_links"], g["component_id"], g["kept"]) == (0, r[0], True)
    assert pivots.embedding_dups(spark.createDataFrame([], VECTORS)).count() == 0


def test_repeated_vectors_count_as_links(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 1, "x") for i in (5, 5, 7)] + [(9, [1.0, 2.0, 3.01], 1, "x")], VECTORS)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pivots.embedding_dups(df).collect()) == [
        (5, 3, 5), (5, 3, 5), (7, 3, 5), (9, 3, 5)]


def brute_removed(rows):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("block_bytes", [2000, 1 << 24])
def test_suffixes_against_brute_force(spark, block_bytes):
    rows = helpers.corpus()
    rng = random.Random(9)
    tail = helpers.prose(rng, 40)
    rows += [[500 + i, helpers.prose(rng, 3) + tail[i:120 + 7 * i] + "\0" * i + helpers.prose(rng, 3)] for i in range(20)]
    rows += [[600 + i, "ab" * (30 + i) + "y" * 70] for i in range(4)]
    out = suffixes.repeated_strings(helpers.frame(spark, rows), block_bytes=block_bytes).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out]
    assert Counter(got) == Counter(brute_removed(rows))
    assert suffixes.repeated_strings(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [1, 20])
def test_hot_grams_are_dealt_out_and_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "_HOT_ROWS", 16)
    rows = helpers.corpus()
    rng = random.Random(11)
    passage, phrase = helpers.prose(rng, 30), "a phrase of thirty-six bytes, or so."
    rows += [[700 + i, helpers.prose(rng, 4) + passage + helpers.prose(rng, 4)] for i in range(60)]
    rows += [[800 + i, helpers.prose(rng, 4) + phrase + helpers.prose(rng, 4) + phrase * (i % 3)] for i in range(60)]
    rows += [[900, "ab" * 300], [901, "ab" * 400 + passage]]
    out = suffixes.repeated_strings(helpers.frame(spark, rows), block_bytes=4000, hot=hot).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out]
    assert Counter(got) == Counter(brute_removed(rows))


def test_answers_come_back_in_little_memory():
    rng = np.random.default_rng(13)
    text = [bytes(rng.integers(97, 123, 2000, np.uint8)) for _ in range(1000)]
    docs = pd.DataFrame({"doc_id": range(2000), "text": text + text})        # everything repeats
    asked = suffixes._request_keys(4, 50)((0,), docs)
    bits = pd.concat([suffixes._answer_keys(suffixes.HOT)(g) for _, g in asked.groupby("bucket")])
    runs = suffixes._request_runs(4, 50)((0,), docs, bits)
    found = pd.concat([suffixes._answer_runs(50)(g) for _, g in runs.groupby("bucket")])
    tracemalloc.start()
    out = suffixes._remove(50)((0,), docs, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(k) for k in out.sort_values("doc_id")["kept"]] == [2000] * 1000 + [0] * 1000
    assert peak < 25 * 4_000_000, peak


def test_no_bucket_gets_all_surroundings_of_a_hot_gram():
    rng = random.Random(12)
    letters = bytes(rng.choices(range(97, 123), k=20000))
    at = int(np.argmin(suffixes._gram_hashes(np.frombuffer(letters, np.uint8)) >> np.uint64(32)))
    phrase = letters[at:at + 24]                                # the anchor of nearly all windows that hold it
    text = [bytes(rng.choices(range(97, 123), k=60)) + phrase + bytes(rng.choices(range(97, 123), k=60)) for _ in range(400)]
    blocks = [pd.DataFrame({"doc_id": range(i, i + 50), "text": text[i:i + 50]}) for i in range(0, 400, 50)]
    asked = pd.concat([suffixes._request_keys(16, 50)((i,), pdf) for i, pdf in enumerate(blocks)])
    bits = pd.concat([suffixes._answer_keys(100)(g) for _, g in asked.groupby("bucket")])
    runs = pd.concat([suffixes._request_runs(16, 50)((i,), pdf, bits[bits["block"] == i]) for i, pdf in enumerate(blocks)])
    rows = Counter()
    for bucket, is_hot, blob in zip(runs["bucket"], runs["hot"], runs["blob"]):
        rows[bucket] += len(suffixes._unpack(blob)[1 if is_hot else 0])
    assert len(rows) == 16 and max(rows.values()) < 2 * sum(rows.values()) / 16


def test_merge_never_recompares_and_sorts():
    rng = random.Random(1)
    runs = [sorted({rng.randrange(1 << 24) for _ in range(rng.randrange(0, 30))}) for _ in range(7)]
    lcp = [[0] + [(24 - (a ^ b).bit_length()) >> 3 for a, b in zip(r, r[1:])] for r in runs]
    out = list(suffixes.merged(runs, lcp, width=3))
    values = [runs[r][i] for r, i, _ in out]
    assert values == sorted(v for r in runs for v in r)
    for a, b, (_, _, same) in zip(values, values[1:], out[1:]):
        assert same == (24 - (a ^ b).bit_length()) >> 3


def jaccard_links(rows, words=5):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(set(zip(*[w[i:] for i in range(words)])) if len(w) >= words else ({tuple(w)} if w else set()))
    return [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
            and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def test_shingles_against_brute_force(spark):
    rows = helpers.corpus()
    rng = random.Random(4)
    base = helpers.prose(rng, 120).split(" ")
    for i in range(60):                                         # near copies at many distances
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = "edit" + str(i)
        rows.append([1000 + i, " ".join(w)])
    rows += [[2000, "one two"], [2001, "one  two"], [2002, "one two three"]]
    links = [(i, j) for i, j in jaccard_links(rows) if rows[i][0] is not None and rows[j][0] is not None]
    degree = Counter(x for link in links for x in link)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    place = {i: k for k, i in enumerate(order)}
    comp = components(len(rows), [(place[i], place[j]) for i, j in links])
    want = Counter((rows[i][0], degree[i], rows[order[comp[place[i]]]][0]) for i in range(len(rows)))
    got = shingles.shingle_join(helpers.frame(spark, rows), block=8).collect()
    assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"] or r["doc_id"] is None) for r in got)
    assert shingles.shingle_join(helpers.empty(spark)).count() == 0


def test_posterior_bound():
    # all equal never drops; none equal soon does; more values need more matches
    least = [shingles.least_matches(n, 0.8, 1e-8) for n in (10, 20, 40, 60)]
    assert least == sorted(least) and least[0] < 5 and 15 < least[-1] < 40


def brute_lines(rows, run=2, alone=None):
    """Every run of ``run`` lines, and every line of ``alone`` words or more, that stands earlier goes."""
    seqs, first = [], {}
    for d, t in rows:
        s = [(i, x.strip(" \t\r")) for i, x in enumerate((t or "").split("\n"))]
        seqs.append([x for x in s if x[1]])

    def windows(s):
        yield from (s[j:j + run] for j in range(len(s) - run + 1))
        yield from ([x] for x in s if alone is not None and len(re.split("[ \t\n\x0b\f\r]+", x[1])) >= alone)
    for (d, _), s in sorted(zip(rows, seqs), key=lambda r: (r[0][0] is None, r[0][0] or 0)):
        for w in windows(s) if d is not None else ():
            key = tuple(x[1] for x in w)
            first[key] = min(first.get(key, (d, w[0][0])), (d, w[0][0]))
    out = []
    for (d, t), s in zip(rows, seqs):
        gone = set()
        for w in windows(s) if d is not None else ():
            if first[tuple(x[1] for x in w)] < (d, w[0][0]):
                gone |= {x[0] for x in w}
        out.append((d, len(gone), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)))
    return out


@pytest.mark.parametrize("run,alone", [(1, None), (2, None), (3, None), (2, 3), (2, 20), (3, 8)])
def test_lines_against_brute_force(spark, run, alone):
    rows = helpers.corpus()
    rows += [[900, "p q\nr s\n\nt u\np q\nr s"], [901, "v\n p q \nr s\t\nt u\r\nw"], [902, "same\nsame\nsame\nsame"]]
    got = lines.line_dedup(helpers.frame(spark, rows), run=run, carry=["source"], alone=alone).collect()
    assert Counter((r["doc_id"], r["n_deleted"], r["kept"]) for r in got) == Counter(brute_lines(rows, run, alone))
    assert lines.line_dedup(helpers.empty(spark)).count() == 0


def test_a_long_line_is_a_run_by_itself(spark):
    long, short = "one two three four five six", "one two"
    rows = [[1, f"a\n{long}\n{short}\nb"], [2, long], [3, f"c\n {long} \n{short}x"], [4, f"d\n{short}\ne"], [5, f"{long}\n{long}"],
            [6, f"a\n{long}"], [7, short], [8, None], [None, long]]

    def kept(**rule):
        return {r["doc_id"]: r["kept"] for r in lines.line_dedup(helpers.frame(spark, rows), **rule).collect()}
    assert kept(alone=6) == {1: rows[0][1], 2: "", 3: f"c\n{short}x", 4: rows[3][1], 5: "", 6: "", 7: short, 8: "", None: long}
    assert kept(alone=7) == kept() and kept(alone=1) == kept(run=1)


def test_digest_windows_and_likeness():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choices(range(97, 107), k=300)), np.uint8)
    want = [sum(c * (c - 1) // 2 for c in Counter(data[i:i + 64].tolist()).values()) for i in range(len(data) - 63)]
    assert digest.equal_pairs(data).tolist() == want
    rank = np.arange(digest.PAIRS + 1)
    a, b, c, none = digest._digests([t.encode() for t in (helpers.prose(rng, 800), helpers.prose(rng, 800), "tiny", "")], rank)
    assert digest.likeness(a, a) == digest.likeness(none, none) == 1 and digest.likeness(a, none) == 0
    assert digest.likeness(a, b) < 0.2
    again = digest.decoded(digest.encoded(a))
    assert (again[0] == a[0]).all() and (again[1] == a[1]).all() and digest.likeness(c, c) == 1


def test_edit_probe_against_brute_force(spark):
    rows = [r for r in helpers.corpus() if r[0] is not None]
    got = digest.edit_probe(helpers.frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: r[0])
    want = Counter()
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[d, len(t), t[:len(t) - half] + n[:half]] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == want
    by_text = defaultdict(set)
    text_of = {d: t or "" for d, t in rows}
    for r in got:
        by_text[text_of[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if r["fingerprint"] == r["edited_fingerprint"]:
            assert r["near_edited"] == 1
    assert all(len(v) == 1 for v in by_text.values())
    # the long text's next one is short, so its edit is its own first half: contained
    assert next(r for r in got if r["n_chars"] > 8000)["near_edited"] > 0.9
    far = digest.edit_probe(helpers.frame(spark, [[i, helpers.prose(random.Random(i), 900)] for i in range(4)])).collect()
    assert all(0.2 < r["near_edited"] < 0.8 and r["near_next"] < 0.2 for r in far)
    assert digest.edit_probe(helpers.frame(spark, [[4, "only one"]])).first()["edited"] == "onlyonly"
    assert digest.edit_probe(helpers.empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(1, 2), (2, 1), (3, 3)]
    rng.shuffle(edges)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 1: 1, 2: 1}


def equal_byte_pairs(window):
    return sum(n * (n - 1) // 2 for n in Counter(window).values())


def brute_features(text, rank):
    """The selected windows of one text, in order."""
    if len(text) < digest.WINDOW:
        return [text] if text else []
    score = [(rank[equal_byte_pairs(text[i:i + 64])], i) for i in range(len(text) - 63)]
    picked = [min(score[i:i + 64]) for i in range(len(score) - 63)]             # the rarest of every stretch
    runs = []
    for _, at in picked:
        if runs and runs[-1][0] == at:
            runs[-1][1] += 1
        else:
            runs.append([at, 1])
    chosen = {at for at, n in runs if n >= digest.POPULAR} | {min(score)[1]}
    return [text[i:i + 64] for i in sorted(chosen)]


def test_digest_selection_and_rarity_against_brute_force(spark):
    rng = random.Random(21)
    texts = [t for _, t in helpers.corpus(seed=3, n=24)] + ["", "a", "ab" * 31, "ab" * 32, "ab" * 33, "x" * 63, "x" * 64, "x" * 200,
                                                            helpers.prose(rng, 60), "é" * 100, "".join(chr(rng.randrange(32, 127)) for _ in range(700))]
    df = helpers.frame(spark, list(enumerate(texts))).repartition(5)
    raw = [(t or "").encode() for t in texts]
    seen = Counter(equal_byte_pairs(t[i:i + 64]) for t in raw for i in range(len(t) - 63))
    order = sorted(range(digest.PAIRS + 1), key=lambda p: (seen[p], p))
    rank = digest.rarity(df)
    assert [order.index(p) for p in range(digest.PAIRS + 1)] == rank.tolist()
    # all texts in one buffer, and each alone: the neighbours in a buffer make no difference
    starts = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    hashes, doc = digest.features(np.frombuffer(b"".join(raw), np.uint8), starts, rank)
    want = [brute_features(t, rank) for t in raw]
    window_of = {}
    for d, t in enumerate(raw):
        own = hashes[doc == d].tolist()
        assert len(own) == len(want[d])
        alone, _ = digest.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), rank)
        assert alone.tolist() == own
        for h, w in zip(own, want[d]):
            assert window_of.setdefault(h, w) == w                   # equal hashes, equal windows
    assert len(window_of) == len({w for ws in want for w in ws})     # and the other way round
    # filters: at most 160 different features each, the bits of each feature set, none besides
    for d in range(len(raw)):
        bits, count = digest.digest(hashes[doc == d])
        distinct = list(dict.fromkeys(hashes[doc == d].tolist()))
        assert count.tolist() == [len(distinct[i:i + digest.PER_FILTER]) for i in range(0, len(distinct), digest.PER_FILTER)]
        for i, row in enumerate(bits):
            part = distinct[i * digest.PER_FILTER:(i + 1) * digest.PER_FILTER]
            assert set(np.flatnonzero(row)) == {(h >> 11 * k) & (digest.BITS - 1) for h in part for k in range(digest.PROBES)}
        back = digest.decoded(digest.encoded((bits, count)))
        assert (back[0] == bits).all() and (back[1] == count).all()


def test_likeness_recomputed(spark):
    rng = np.random.default_rng(6)
    made = [digest.digest(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 40, 160, 161, 500)]
    shared = digest.digest(np.arange(1, 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    half = digest.digest(np.arange(1, 150, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for a in [*made, shared, half]:
        for b in [*made, shared, half]:
            got = digest.likeness(a, b)
            assert 0 <= got <= 1 and abs(got - digest.likeness(b, a)) < 1e-9 or len(a[1]) == len(b[1])
            if len(a[1]) and len(b[1]) and a is not b:
                small, large = (a, b) if len(a[1]) <= len(b[1]) else (b, a)
                total = 0.0
                for x, n in zip(*small):
                    best = 0.0
                    for y in large[0]:
                        both, nx, ny = int((x & y).sum()), int(x.sum()), int(y.sum())
                        best = max(best, min(1.0, (both - nx * ny / digest.BITS) / max(min(nx, ny) - nx * ny / digest.BITS, 1e-9)))
                    total += best * n
                assert abs(got - total / small[1].sum()) < 1e-6
    assert digest.likeness(shared, half) > 0.9 and digest.likeness(made[0], made[0]) == 1 and digest.likeness(made[0], made[3]) == 0
