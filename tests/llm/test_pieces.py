"""Piece encoding against the library, decoding of any ids."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from seriesforge.llm import pieces

from . import helpers

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(12)
    parts = ["a", "b", "the", " ", "  ", "\t", "\n", "é", "日", "本", "𝄞", "▁", "0", "12", "ing", "aaaa", "<s>", "</s>", "<0x41>", "\x00",
             "ñ", "░", "████", "----", "=====", "ab", " " * 30, " ", "́", "hello", "World", "🙂", "🙂🙂", "ᚠ"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(800)]
    out += ["a" * k for k in range(40)] + ["-" * k for k in range(70)] + [" " * k for k in range(1, 140)]
    out += [" " * k + "x" + " " * k + "the" for k in range(55, 80)] + ["▁" * 100 + "▁the", " " * 5000, "x" * 5000, "ab" * 5000]
    out += ["".join(rng.choice("abcdefgh") for _ in range(3000)), helpers.prose(rng, 3000), None, ""]
    return out


def test_round_trip_equals_the_library(spark, library):
    rows = list(enumerate(texts())) + [(3, "a repeated id"), (None, "a null id")]
    df = helpers.frame(spark, rows).repartition(5)
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.round_trip(df, MODEL).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces.round_trip(helpers.empty(spark), MODEL).count() == 0


def test_encode_and_decode_as_frames(spark, library):
    rows = list(enumerate(texts()[:300])) + [(None, "x")]
    ids = pieces.encode(helpers.frame(spark, rows), MODEL)
    own = {i: t for i, t in rows}
    assert all(r["ids"] == library.encode(own[r["doc_id"]] or "", add_eos=True) for r in ids.collect())
    back = pieces.decode(ids, MODEL).collect()
    assert all(r["text"] == library.decode(library.encode(own[r["doc_id"]] or "")) for r in back)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 99999, -1])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(odd, MODEL).collect()} == {1: "", 2: "", 3: " ⁇ " * 3}


def test_decoder_on_any_ids(library):
    model, rng = pieces.load(MODEL), random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), 259, 28705])
               for _ in range(rng.randrange(10))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_texts_go_in_slices(library, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 500)
    monkeypatch.setattr(pieces, "SLICE", 7)
    monkeypatch.setattr(pieces, "MAX_WORDS", 50)
    coder = pieces._Coder(pieces.load(MODEL))
    for t, slices in zip(texts(), coder.texts([t or "" for t in texts()])):
        parts = list(slices)
        assert " ".join(x for x, _, _ in parts if x) == " ".join(map(str, library.encode(t or "")))
        assert "".join(x for _, _, x in parts) == library.decode(library.encode(t or ""))


def toy(scores, pieces_):
    """A model file of few pieces, to order merges as real ones seldom do."""
    import struct

    def field(f, kind, body):
        return bytes([f << 3 | kind]) if f < 16 else bytes([(f << 3 | kind) & 127 | 128, f >> 4]), body

    def blob(f, data):
        return b"".join(field(f, 2, b"")[:1]) + bytes([len(data)]) + data

    def number(f, n):
        return b"".join(field(f, 0, b"")[:1]) + bytes([n])
    out = b""
    for text, kind, score in [("<unk>", 2, 0.0), ("<s>", 3, 0.0), ("</s>", 3, 0.0), *[(f"<0x{b:02X}>", 6, 0.0) for b in range(256)],
                              *[(p, 1, s) for p, s in zip(pieces_, scores)]]:
        body = blob(1, text.encode()) + b"\x15" + struct.pack("<f", score) + number(3, kind)
        out += blob(1, body)
    return out + blob(2, number(3, 2) + number(35, 1)) + blob(3, blob(1, b"identity") + number(3, 1) + number(4, 0))


def test_merges_that_make_better_pairs_stay_in_order(tmp_path):
    """Pieces whose parts score worse than the whole: merging all occurrences at once would go wrong."""
    words, rng = ["▁", "a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa", "aaa", "aba", "▁a", "bb", "abab"], random.Random(8)
    for _ in range(25):
        data = toy([-float(rng.randrange(6)) for _ in words], words)
        path = tmp_path / f"m{rng.random()}.model"
        path.write_bytes(data)
        own, lib = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_file=str(path))
        coder = pieces._Coder(own)
        texts_ = ["".join(rng.choice("abc a") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
        for t, slices in zip(texts_, coder.texts(texts_)):
            assert " ".join(x for x, _, _ in slices) == " ".join(map(str, lib.encode(t))), t
