"""Personal data, licenses, toxicity, mixing and tokenizing."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seriesforge.llm import bpe, licenses, mixing, pii, toxicity

from . import helpers

VOCAB, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]


def brute_pii(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, rx, ok) in enumerate(BASE)
                   for m in re.finditer(rx, text) if ok(m.group()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)


def test_pii_base_spans_against_brute_force(spark):
    rng = random.Random(6)
    pieces = ["a@b.c", "x.y+z@host-1.example.org", "a@b.c_d@e.f", "@", "1.2.3.4", "999.1.2.3.4", "1.2.3.999.5.6.7.8", "010.0.0.1",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "0" * 14, "0" * 20, "1 2", "+1 (555) 123-4567",
              "+49 30 1234567890 ", "+1", "+123456789012345678", " ", "é", "\n", "😀", ".", "-", "7", "abc", "  "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts += ["1" * 20000, "a" * 20000 + "@", "1 " * 5000, "+1" + " " * 5000, None, ""]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in pii.summary(pii.find_pii(helpers.frame(spark, rows))).collect()}
    for i, t in rows:
        want = brute_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i]["spans"])
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert [got[i][f"n_{k}"] for k, _, _ in BASE] == [kinds[k] for k, _, _ in BASE]
    assert pii.find_pii(helpers.empty(spark)).count() == 0


def test_pii_adds_confirmed_spans(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 thanks", "GB82WEST12345698765433", "my SSN is 123-45-6789", "code 123-45-6789"]
    got = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find_pii(helpers.frame(spark, list(enumerate(texts))))).collect()}
    assert got[0] == "iban:5:32" and got[1] == "" and got[2] == "ssn:10:21" and got[3] == ""


def test_license_scan(spark):
    rows = [[1, "code\nLicensed under the Apache License, Version 2.0.\nmore"], [2, "Released under the MIT License."],
            [3, "Licensed under CC BY-NC 4.0."], [4, "This work is licensed under the GNU General Public License, version 3."],
            [5, "a driving licence is nothing of the kind and has quite other words"], [6, None], [7, ""],
            [8, "pad " * 300 + licenses.TEMPLATES["MIT"] + " pad" * 300], [None, "Released under the MIT License."]]
    got = [(r["doc_id"], r["license"]) for r in licenses.license_scan(helpers.frame(spark, rows + [rows[1]])).collect() if r["confirmed"]]
    assert Counter(got) >= Counter({(1, "Apache-2.0"): 1, (2, "MIT"): 2, (3, "CC-BY-NC-4.0"): 1, (4, "GPL-3.0"): 1, (None, "MIT"): 1})
    assert (8, "MIT") in got and not any(d == 5 for d, _ in got)
    assert licenses.license_scan(helpers.empty(spark)).count() == 0


def test_differing_words_decide_on_licenses(spark):
    whole = dict(licenses.whole_texts())
    notice = "This work is licensed under the GNU %sGeneral Public License, version %s."
    lines = {"GPL-1.0": notice % ("", 1), "AGPL-3.0": notice % ("Affero ", 3), "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
             "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.", "GPL-2.0": notice % ("", 2), "LGPL-2.1": notice % ("Lesser ", 2.1),
             "All rights reserved": "All rights reserved.", "MIT": whole["MIT"][-330:], "BSD-3-Clause": "3. " + whole["BSD-3-Clause"].split(" 3. ")[1][:330],
             "GPL-3.0": "Conveying under any other circumstances is permitted solely under the conditions stated below. Sublicensing is not "
                        "allowed; section 10 makes it unnecessary."}
    none = ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under CC BY-NC 3.0.", notice % ("", 7), "Licensed under the Apache License, Version 4.2.",
            "THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES"]
    rows = list(enumerate([*lines.values(), *none]))
    got = licenses.license_scan(helpers.frame(spark, rows)).collect()
    assert {(r["doc_id"], r["license"]) for r in got if r["confirmed"]} == set(enumerate(lines))


EPL = "SPDX-License-Identifier: EPL-2.0"


def test_notices_as_they_stand_in_files(spark):
    """Wrapped, commented and tagged notices; whole texts as published, at 76 columns."""
    import textwrap
    whole = dict(licenses.whole_texts())
    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 76))
    gpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
           "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    cases = [("BSD-3-Clause", wrap(whole["BSD-3-Clause"])), ("BSD-2-Clause", wrap(whole["BSD-2-Clause"])), ("GPL-3.0", wrap(gpl, "# ")),
             ("GPL-3.0", "/*\n" + wrap(gpl, " * ") + "\n */"), ("Apache-2.0", "Licensed under the Apache License,\nVersion 2.0."),
             ("MIT", "SPDX-License-Identifier: MIT"), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"), ("EPL-2.0", EPL), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0"), ("LGPL-2.1", "/* SPDX-License-Identifier: LGPL-2.1-or-later */"),
             ("EPL-2.0", "Eclipse Public License 2.0"), ("MIT", wrap(whole["MIT"], "// ")), ("ISC", wrap(whole["ISC"], "-- ")),
             (None, "SPDX-License-Identifier: Sleepycat-9.1"), ("Apache-2.0", "prose of nothing at all\n" + wrap(licenses.TEMPLATES["Apache-2.0"][48:440], ";; ") + "\nmore prose")]
    rows = [(i, t) for i, (_, t) in enumerate(cases)]
    got = licenses.license_scan(helpers.frame(spark, rows)).collect()
    named = {}
    for r in got:
        if r["confirmed"]:
            named.setdefault(r["doc_id"], set()).add(r["license"])
    assert named == {i: {k} for i, (k, _) in enumerate(cases) if k}
    assert not [r for r in got if r["doc_id"] == 13 and r["license"]]         # an unknown license is not named
    assert "prose" not in " ".join(r["block"] for r in got if r["doc_id"] == 14)


@pytest.mark.parametrize("mark", ["", "# "])
def test_whole_texts_are_found_and_nothing_else(spark, mark):
    from pathlib import Path
    files = sorted((Path(licenses.__file__).parent / "license_texts").glob("*.txt"))
    rows = [(i, "\n".join(mark + x for x in p.read_text(encoding="utf-8").splitlines())) for i, p in enumerate(files)]
    got = licenses.license_scan(helpers.frame(spark, rows).repartition(len(rows))).collect()
    for i, p in enumerate(files):
        own = [r["license"] for r in got if r["doc_id"] == i and r["confirmed"]]
        assert own.count(p.name.removesuffix(".txt")) >= max(1, 0.9 * len(own)), (p.name, Counter(own))


def test_license_ranking_and_differences_recomputed(spark):
    """Every row of a scan from scratch: the savings of all templates, their order, and the words."""
    import difflib

    import zstandard
    rng = random.Random(5)
    own = {"A": "the quick license of foxes, version 2.0, is granted to any person who likes foxes and hens",
           "B": "the quick license of foxes, version 3.0, is granted to any person who likes foxes and hens",
           "C": "this license speaks of copyright and of nothing else whatever it may be", "D": "the quick license of foxes, version 2.0, is granted to any person who likes foxes and hens"}
    texts = []
    for k, t in own.items():
        for _ in range(12):
            words = t.split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["license", "cats", "3.0,", "x"])
            texts.append(" ".join(words[rng.randrange(3):]))
    texts += ["a license of its own kind", "license"]
    got = licenses.license_scan(helpers.frame(spark, list(enumerate(texts))), templates=own).collect()

    def size(text, extra=None):
        d = None if extra is None else zstandard.ZstdCompressionDict(extra.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_dict_id=False).compress(text.lower().encode()))
    by_id = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        saved = {k: (size(t) - size(t, v)) / size(t) for k, v in own.items()}
        if max(saved.values()) < licenses.LEAST_SAVED:
            assert i not in by_id
            continue
        r = by_id[i]
        assert abs(r["saved"] - max(saved.values())) < 1e-12
        split = lambda x: [w.lower() for w in licenses._WORD.findall(x)]
        a = split(t)
        score = {}
        for k, v in own.items():
            if saved[k] >= licenses.LEAST_SAVED:
                m = difflib.SequenceMatcher(None, split(v), a, autojunk=False)
                ops = [o for o in m.get_opcodes() if o[0] != "equal"]
                equal = len(a) - sum(o[4] - o[3] for o in ops)
                lost = {w for o in ops for w in a[o[3]:o[4]]}
                extra = {w for o in ops if 0 < o[3] < len(a) and 0 < o[1] for w in split(v)[o[1]:o[2]]}
                odd = any(w[0].isdigit() for w in lost | extra)
                score[k] = (equal, not odd and equal / len(a) >= licenses.LEAST_SAME and equal >= 3)
        if r["confirmed"]:
            assert score[r["license"]][1] and score[r["license"]][0] == max(e for e, ok in score.values() if ok)
            assert r["license"] not in ("A", "D")              # equal texts: no license fits best
        minus = [d for d in r["diffs"] if d[0] == "-"]
        if r["license"] in score:
            assert len(minus) == len(a) - round(r["same_words"] * len(a)) == len(a) - score[r["license"]][0]


def test_license_differences():
    diffs, same = licenses.differences("Licensed under the Apache Licence, Version 2.0", licenses.TEMPLATES["Apache-2.0"])
    assert diffs == ["-licence", "+license"] and same == 6 / 7
    assert licenses.differences("", "x") == ([], 0.0)


@pytest.fixture(scope="module")
def toxic_corpus():
    rng = random.Random(12)
    bad = ["idiotic", "pathetic", "worthless", "disgusting"]
    rows, labels = [], []
    for i in range(600):
        words = helpers.prose(rng, rng.randrange(40, 200)).split(" ")
        toxic = i % 6 == 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append([i, " ".join(words)])
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, toxic_corpus):
    rows, labels = toxic_corpus
    docs = helpers.frame(spark, rows + [[9000, None], [9001, ""], [None, "idiotic pathetic " * 9], [0, rows[0][1]]])
    known = spark.createDataFrame(labels + [(5, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs, model).collect()
    import zlib
    held = [(r["score"], r["predicted"], r["doc_id"] % 6 == 0) for r in got
            if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([p == t for _, p, t in held]) > 0.95
    a, b = [s for s, _, t in held if t], [s for s, _, t in held if not t]
    assert np.mean([x > y for x in a for y in b]) > 0.97
    odd = [r for r in got if r["doc_id"] is None or r["doc_id"] >= 9000]
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in odd) == [(0, 1), (9000, 0), (9001, 0)]
    clean = toxicity.reject(docs, model)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in got if not r["predicted"])


def test_toxicity_without_labels(spark):
    docs = helpers.frame(spark, helpers.corpus())
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.reject(docs, model).count() == docs.count()
    assert toxicity.score(helpers.empty(spark), model).count() == 0


def test_schedule_deviates_less_than_a_block():
    rng = random.Random(2)
    for _ in range(50):
        weights = {f"s{i}": rng.randrange(1, 40) for i in range(rng.randrange(1, 7))}
        slots = mixing.schedule(weights)
        period = sum(weights.values())
        assert sorted(t for at in slots.values() for t in at) == list(range(period))
        for s, at in slots.items():
            for t in range(period + 1):
                assert abs(sum(x < t for x in at) - t * weights[s] / period) < 1


def test_every_source_has_a_weight_and_its_share(spark):
    rng = random.Random(9)
    rows = [(i, f"t{i}", rng.choice(["src0"] * 10 + [f"src{k}" for k in range(18)] + [None])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = mixing.source_weights(df, {"src0": 20, "src1": 10, "absent": 30, mixing.REST: 55})
    assert set(weights) == {*(f"src{k}" for k in range(18)), mixing.REST}          # null is a source, an absent one is none
    assert weights["src0"] == 2 * weights["src1"] and len({weights[f"src{k}"] for k in range(2, 18)} | {weights[mixing.REST]}) == 1
    assert weights["src1"] / weights["src2"] == 10 / (55 / 17)
    got = mixing.mix(df, weights, block_rows=2, complete=True).collect()
    assert len(got) == len(rows) and len({r["position"] for r in got}) == len(rows)
    period, slots = sum(weights.values()), {}
    for r in got:
        slots.setdefault(r["mix_source"], set()).add(r["slot"])
    for s, w in weights.items():
        own = sorted(slots[s])
        for k, slot in enumerate(own):                                             # its share up to any slot, less than one block off
            assert abs((k + 1) - (slot + 1) * w / period) < 1 and abs(k - slot * w / period) < 1, (s, k, slot)
    with pytest.raises(ValueError):
        mixing.source_weights(df, {}, most=18)
    with pytest.raises(Exception, match="without a weight"):
        mixing.mix(df, {"src0": 1}, complete=True).collect()
    assert mixing.mix(df.limit(0), mixing.source_weights(df.limit(0), weights), complete=True).count() == 0


def test_mix_against_brute_force(spark):
    rows = helpers.corpus()
    df = helpers.frame(spark, rows)
    weights = {"src0": 3, "src1": 1, "absent": 2, "*": 2}
    got = mixing.mix(df, weights, block_rows=3, carry=["text"]).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(map(tuple, rows))
    slots = mixing.schedule(weights)
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        s = ["src0", "src0", "src1", None, "other"][i % 5]
        groups.setdefault(s if s in weights else "*", []).append(
            (hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest(), d))
    want = Counter()
    for s, ids in groups.items():
        for rank, (_, d) in enumerate(sorted(ids, key=lambda x: x[0])):
            block = rank // 3
            slot = block // weights[s] * 8 + slots[s][block % weights[s]]
            want[d, s, rank, slot, slot * 3 + rank % 3] += 1
    assert Counter((r["doc_id"], r["mix_source"], r["source_rank"], r["slot"], r["position"]) for r in got) == want
    assert len({r["position"] for r in got}) == len(rows)
    assert mixing.mix(helpers.empty(spark), weights).count() == 0


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_merging(reference_encoding):
    fst = bpe.Transducer(bpe.load_ranks(VOCAB), max_states=2000)
    rng = random.Random(7)
    tokens = list(fst.ranks)
    for i in range(3000):
        word = (b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5))) if i % 2 else
                bytes(rng.choice(b"abcd e.\xc3\xa9\x00\xff") for _ in range(rng.randrange(1, 30))))
        ids = fst.encode(word)
        assert ids == reference_encoding._encode_single_piece(word) and fst.decode(ids) == word
    long = b"ab" * 6000 + b"x" * 9000
    assert fst.encode(long) == reference_encoding._encode_single_piece(long) and fst.encode(b"") == []


def test_encode_and_decode_whole_texts(spark, reference_encoding):
    rows = helpers.corpus() + [[700, "It's 12,345 naïve cafés\r\n\n  😀\x1c don't\x85 end   "], [701, "word " * 80000]]
    df = helpers.frame(spark, rows)
    want = Counter((d, tuple(reference_encoding.encode_ordinary(t or ""))) for d, t in rows)
    ids = bpe.encode(df, VOCAB, PATTERN, carry=["source"])
    got = ids.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want and all(r["exact"] for r in got)
    back = bpe.decode(ids, VOCAB).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, t or "") for d, t in rows)
    out = bpe.round_trip(df, VOCAB, PATTERN).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["exact"]) for r in out) == Counter(
        (d, len(reference_encoding.encode_ordinary(t or "")),
         hashlib.sha256(" ".join(map(str, reference_encoding.encode_ordinary(t or ""))).encode()).hexdigest(),
         hashlib.sha256((t or "").encode()).hexdigest(), True) for d, t in rows)
    assert bpe.encode(helpers.empty(spark), VOCAB, PATTERN).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [72, None, 10**6])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd, VOCAB).collect()} == {1: "", 2: "i��"}


def test_utf8_stream_equals_one_pass():
    rng = random.Random(5)
    for _ in range(2000):
        data = bytes(rng.choice(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xed\xa0\xff\xc0") for _ in range(rng.randrange(0, 20)))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = rng.randrange(1, 6)
            out += stream.feed(data[at:at + step])
            at += step
        assert out + stream.close() == data.decode(errors="replace")


def test_pii_of_a_text_with_very_many_matches(spark):
    """Positions and contexts of 32,000 addresses are those of brute force, and time grows with them, not with their square."""
    import time
    took = {}
    for n in (4000, 32000):
        text = "".join(f"é {i} email u{i}@ex.org," if i % 3 else f" card 4111 1111 1111 1111 x{i}, " for i in range(n))
        rows = [(1, text)]
        start = time.time()
        got = pii.summary(pii.find_pii(helpers.frame(spark, rows))).collect()[0]
        took[n] = time.time() - start
        assert got["base_sha256"] == hashlib.sha256(brute_pii(text).encode()).hexdigest()
        assert set(got["scores"].split(",")) == {"1.0"}              # the context word stands before every match
    assert took[32000] < 20 * took[4000] + 10
