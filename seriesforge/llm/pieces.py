"""SentencePiece encoding and decoding by vectorised merge rounds (BPE models with byte fallback).

A text is normalised as the model says (blanks become U+2581, one is put in front) and cut in front of
every run of blanks: no piece holds another character before a blank, so no merge crosses
such a cut. The distinct words of a batch that are not known yet lie next to each other in flat numpy arrays,
one symbol an entry. A round finds the best (least) pair rank of each word with one segmented minimum,
merges all of its occurrences at once, the leftmost first where two overlap, compacts the arrays,
and drops the words in which no pair is left.

Merging occurrences at once gives what merging one by one gives as long as no pair made
on the way ranks as well as the pair merged. That is checked every round; a word in which it fails (runs of
blanks, whose pieces all have one score) merges its leftmost occurrence alone in that round.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLANK = "▁"
# Piece types and model type of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
NONE = np.iinfo(np.int32).max           # no such pair
KEY_BITS = 21                           # ids in a pair key
CHUNK_CHARS = 1 << 21                   # texts of about this many characters are encoded together
SLICE = 1 << 16                         # words of a longer text at a time
MAX_WORDS = 1 << 18                     # words a worker remembers
MAX_WORD = 64                           # longer ones are not remembered
LONG_RUN = 64                           # a longer run of blanks is encoded by its length

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def _wire(data: bytes):
    """(field number, value) pairs of a serialised message: numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield field, data[at:at + size]
        at += size


class Pieces:
    """The pieces of a model file, and the table of pairs that merge."""

    def __init__(self, data: bytes):
        parts = list(_wire(data))
        pieces = [dict(_wire(v)) for f, v in parts if f == 1]
        trainer = dict(_wire(b"".join(v for f, v in parts if f == 2)))
        rule = dict(_wire(b"".join(v for f, v in parts if f == 3)))
        self.text = [p[1].decode() for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        plain = (trainer.get(3) == BPE and trainer.get(35) and set(self.kind) <= {NORMAL, UNKNOWN, CONTROL, BYTE}
                 and not trainer.get(24) and not rule.get(2) and rule.get(3, 1) and not rule.get(4, 1) and rule.get(5, 1))
        normal = [i for i, k in enumerate(self.kind) if k == NORMAL]
        id_of = {self.text[i]: i for i in normal}
        if not plain or BLANK not in id_of or any(re.search(f"[^{BLANK}]{BLANK}", p) for p in id_of):
            raise ValueError("only BPE models with byte fallback, a blank in front, no character map and no user-defined "
                             "pieces, whose pieces hold blanks at the front only")
        self.eos = trainer.get(42, 2)
        self.unknown = trainer.get(44, " ⁇ ".encode()).decode()
        self.byte_id = {int(self.text[i][3:5], 16): i for i, k in enumerate(self.kind) if k == BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        n = len(pieces)
        chars = {c: id_of.get(c, -1) for p in id_of for c in p}
        for c in sorted(c for c, i in chars.items() if i < 0):       # characters that occur inside pieces only
            chars[c] = n = n + 1
        self.other = n + 1                                           # any further character
        if self.other >= 1 << KEY_BITS:
            raise ValueError("too many pieces")
        self.char = np.full(0x110000, self.other, np.int32)
        for c, i in chars.items():
            self.char[ord(c)] = i
        # equal scores rank equal, the best first
        score = {i: struct.unpack("<f", pieces[i].get(2, b"\0\0\0\0"))[0] for i in normal}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = []
        for p, i in id_of.items():
            for k in range(1, len(p)):
                left, right = id_of.get(p[:k], chars.get(p[:k])), id_of.get(p[k:], chars.get(p[k:]))
                if left is not None and right is not None:
                    pairs.append((left << KEY_BITS | right, rank[score[i]], i))
        self._fill(pairs)
        self._numbers = self._table([b"%d " % i for i in range(len(pieces))])
        self._spellings = self._table([self.byte_of.get(i, t.replace(BLANK, " ").encode()) for i, t in enumerate(self.text)])
        # runs of blanks on their own: if their pieces score alike and below all others, every other merge comes
        # first, and of a run only the last blank takes part in it
        self.run_ids = {len(p): i for p, i in id_of.items() if set(p) == {BLANK}}
        scores = {score[i] for n, i in self.run_ids.items() if n > 1}
        self.runs_last = (len(scores) <= 1 and not any(BLANK * 2 in p and set(p) != {BLANK} for p in id_of)
                          and all(score[i] > max(scores, default=-np.inf) for p, i in id_of.items()
                                  if len(p) > 1 and set(p) != {BLANK}))

    def _fill(self, pairs: list[tuple[int, int, int]]) -> None:
        """Tables of (key, rank, merged id) by hash, open to the next free place; a key of -1 is none."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank, self.merged = np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        todo = np.array(pairs, np.int64).reshape(-1, 3)
        at = self._hash(todo[:, 0])
        while len(todo):
            free = np.flatnonzero(self.key[at] == -1)
            own = free[np.unique(at[free], return_index=True)[1]]       # of those that want one place, one gets it
            self.key[at[own]], self.rank[at[own]], self.merged[at[own]] = todo[own].T
            rest = np.ones(len(todo), bool)
            rest[own] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of every pair of symbols; rank ``NONE`` where they don't merge."""
        key = left.astype(np.int64) << KEY_BITS | right
        at = self._hash(key)
        have = self.key[at]
        far = np.flatnonzero((have != key) & (have != -1))
        while len(far):
            at[far] = (at[far] + 1) & self.mask
            have = self.key[at[far]]
            far = far[(have != key[far]) & (have != -1)]
        return self.rank[at], self.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, first characters, words) of all symbols left when no pair remains, words in order."""
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym, at = self.char[cps], np.arange(len(cps))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        left = np.full(len(cps), -1, np.int32)
        pr, to = self._ranked(sym, word)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(pr, starts), np.diff(np.r_[starts, len(sym)]))
            live = low != NONE
            if not live.all():
                left[at[~live]] = sym[~live]
                sym, at, word, pr, to, low = (x[live] for x in (sym, at, word, pr, to, low))
                continue
            hit = np.flatnonzero(pr == low)
            # of occurrences that overlap in a row, every other one from the left
            first = np.r_[True, np.diff(hit) > 1]
            order = np.arange(len(hit))
            hit = hit[(order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0]
            hit, sym, at, word, pr, to = self._merged(hit, sym, at, word, pr, to, low)
        own = np.flatnonzero(left >= 0)
        return left[own], cps[own], np.repeat(np.arange(len(words)), [len(w) for w in words])[own]

    def _ranked(self, sym, word):
        if not len(sym):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        pr, to = self.pairs(sym[:-1], sym[1:])
        pr[word[1:] != word[:-1]] = NONE
        return np.r_[pr, np.int32(NONE)], np.r_[to, np.int32(0)]

    def _merged(self, hit, sym, at, word, pr, to, low):
        """The arrays after merging at ``hit``; words in which that isn't safe merge their first hit alone."""
        while True:
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            now = sym.copy()
            now[hit] = to[hit]
            new_sym, new_at, new_word, new_pr, new_to = now[keep], at[keep], word[keep], pr[keep], to[keep]
            touched = np.zeros(len(new_sym) + 1, bool)
            touched[place[hit]] = touched[place[hit] - 1] = True       # (-1: the spare one at the end)
            touched[-1] = False
            last = touched[-2]
            touched[-2] = False
            inner = np.flatnonzero(touched)
            rank, merged = self.pairs(new_sym[inner], new_sym[inner + 1])
            rank[new_word[inner] != new_word[inner + 1]] = NONE
            new_pr[inner], new_to[inner] = rank, merged
            if last:
                new_pr[-1] = NONE
            several = np.flatnonzero(word[hit[1:]] == word[hit[:-1]])     # hits followed by one of the same word
            if not len(several):
                return hit, new_sym, new_at, new_word, new_pr, new_to
            bad = set(new_word[inner][rank <= low[keep][inner]].tolist())
            close = hit[several][hit[several + 1] == hit[several] + 2]    # pairs that stand only until the next merge
            if len(close):
                between, _ = self.pairs(to[close], sym[close + 2])
                bad |= set(word[close][between <= low[close]].tolist())
            many = set(word[hit[several]].tolist()) & bad
            if not many:
                return hit, new_sym, new_at, new_word, new_pr, new_to
            alone = np.isin(word[hit], list(many)) & ~np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[~alone]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        sym, char, word = self.merge(words)
        whole = sym < len(self.text)
        if whole.all():
            return sym, np.bincount(word, minlength=len(words))
        # a character without a piece becomes its bytes
        odd = [[self.byte_id[b] for b in chr(c).encode()] for c in char[~whole].tolist()]
        size = np.ones(len(sym), np.int64)
        size[~whole] = [len(o) for o in odd]
        ids = np.repeat(sym, size)
        ids[np.repeat(~whole, size)] = [i for o in odd for i in o]
        return ids, np.bincount(word, size, len(words)).astype(np.int64)

    def words_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_words``; long runs of blanks by their length."""
        if not self.runs_last or not any(w.startswith(_LONG) for w in words):
            return self.encode_words(words)
        run = [len(w) - len(w.lstrip(BLANK)) for w in words]
        ids, count = self.encode_words([w if k <= LONG_RUN else w[k - 1:] for w, k in zip(words, run)])
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i, k in enumerate(run):
            if k > LONG_RUN:
                lone = parts[i][0] == self.run_ids[1]
                parts[i] = np.r_[np.array(self._run(k if lone else k - 1), parts[i].dtype), parts[i][1 if lone else 0:]]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _run(self, k: int) -> list[int]:
        """Ids of ``k`` blanks on their own. All their pieces score alike, so the leftmost pair always merges first:
        what lies to the left has no pair left, and each further blank merges back into it as far as it can."""
        done: list[int] = []
        for _ in range(k):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.run_ids:
                done[-2:] = [done[-2] + done[-1]]
        return [self.run_ids[n] for n in done]

    def spelled(self, ids: np.ndarray, count: np.ndarray) -> tuple[list[str], list[str]]:
        """(ids as decimal numbers joined by blanks, decoded text) of every word; all words at once, from two tables
        that hold the number and the text of each piece."""
        numbers, at = self._looked_up(self._numbers, ids)
        ends = np.r_[0, np.cumsum(count)]
        spots = at[ends].tolist()
        numbers = numbers.decode()
        out = [numbers[a:b - 1] for a, b in zip(spots, spots[1:])]
        raw, at = self._looked_up(self._spellings, ids)
        spots = at[ends].tolist()
        try:
            plain = raw.isascii()
            text = raw.decode()
            if not plain:                       # places in characters: bytes that don't continue one, counted
                lead = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
                spots = lead[spots].tolist()
            return out, [text[a:b] for a, b in zip(spots, spots[1:])]
        except UnicodeDecodeError:              # bytes that are no text: each word by itself
            return out, [" " + self.decode(part) for part in (x.tolist() for x in np.split(ids, ends[1:-1]))]

    @staticmethod
    def _looked_up(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(entries of ``ids`` one after the other, where each starts)."""
        flat, starts = table
        size = starts[ids + 1] - starts[ids]
        at = np.r_[0, np.cumsum(size)]
        return flat[np.arange(at[-1]) + np.repeat(starts[ids] - at[:-1], size)].tobytes(), at

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(entries), np.uint8), np.r_[0, np.cumsum([len(e) for e in entries])]

    def decode(self, ids) -> str:
        """Text of ``ids`` as the model's own decoder gives it: control pieces are nothing, bytes that are no
        UTF-8 become U+FFFD one by one, and the blank in front of the first piece goes. An id that doesn't exist,
        or a null, reads as the unknown piece."""
        out, raw, front = [], [], True

        def flush():
            if raw:
                out.append(b"".join(raw).decode("utf-8", "each_byte"))
                raw.clear()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                front = False
                continue
            flush()
            kind = self.kind[i] if i is not None and 0 <= i < len(self.kind) else UNKNOWN
            if kind == CONTROL:
                continue
            piece = self.text[i] if kind == NORMAL else self.unknown
            if front and kind == NORMAL and piece.startswith(BLANK):
                piece = piece[1:]
            out.append(piece.replace(BLANK, " ") if kind == NORMAL else piece)
            front = False
        flush()
        return "".join(out)


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model at ``path`` (read on every worker, once)."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Pieces(f.read())
    return _LOADED[path]


_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")
_LONG = BLANK * (LONG_RUN + 1)


class _Coder:
    """Texts to words to what is known of each word: ids as text joined by blanks, their number, their text."""

    def __init__(self, model: Pieces):
        self.model, self.known = model, {}

    def look_up(self, parts: list[list[str]]) -> dict:
        known = self.known
        new = list({w for part in parts for w in part if w not in known})
        if not new:
            return known
        ids, count = self.model.words_of(new)
        # a word starts with a blank of its own, so its text stands by itself: all but the first word keep theirs
        numbers, spelled = self.model.spelled(ids, count)
        fresh = dict(zip(new, zip(numbers, count.tolist(), spelled)))
        if len(known) + len(fresh) > MAX_WORDS:
            known = self.known = {w: known[w] for part in parts for w in part if w in known}
        longer = [w for w in new if len(w) > MAX_WORD]
        if not longer:
            known.update(fresh)
            return known
        look = {**known, **fresh}
        for w in longer:
            del fresh[w]
        known.update(fresh)
        return look

    def texts(self, texts: list[str]):
        """For every text an iterator of slices (ids as text, number of ids, decoded text), in order."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_CHARS):
                size += len(texts[hi])
                hi += 1
            if size <= CHUNK_CHARS:
                parts = [_WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts[lo:hi]]
                look = self.look_up(parts)
                for part in parts:
                    yield self._slices([map(look.__getitem__, part)] if part else [])
            else:                                   # one long text, in slices of words
                yield self._slices(self._long(texts[lo]))
            lo = hi

    def _long(self, text: str):
        words = (m.group() for m in _WORD.finditer(BLANK + text.replace(" ", BLANK)))
        while part := list(islice(words, SLICE)):
            look = self.look_up([part])
            yield map(look.__getitem__, part)

    @staticmethod
    def _slices(parts):
        first = True
        for got in parts:
            ids, count, text = zip(*got)
            text = "".join(text)
            yield " ".join(ids), sum(count), text[1:] if first else text
            first = False


_CODERS: dict[str, _Coder] = {}


def _coder(path: str) -> _Coder:
    if path not in _CODERS:
        _CODERS[path] = _Coder(load(path))
    return _CODERS[path]


def _row_slices(batches, rows: int = 512):
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", eos: bool = True) -> DataFrame:
    """``doc_id, ids``: every whole text (null: empty) as piece ids (``array<int>``), with the end id unless
    ``eos`` is off. Repeated rows and null ids stay rows; an empty text has the end id alone.
    ``model_path`` must be readable on every worker, like the package."""
    def fn(batches):
        coder = _coder(model_path)
        end = [coder.model.eos] if eos else []
        for batch in _row_slices(batches):
            ids = []
            for slices in coder.texts(batch.column(1).to_pylist()):
                parts = [np.fromstring(x, np.int32, sep=" ") for x, _, _ in slices]
                ids.append(np.concatenate([*parts, np.array(end, np.int32)]))
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))],
                                             names=["doc_id", "ids"])
    return common.spread(common.texts(df, id_col, text_col)).mapInArrow(fn, "doc_id long, ids array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: piece ids back to text. A null list is empty, see :meth:`Pieces.decode` for odd ids."""
    def fn(batches):
        model = load(model_path)
        for batch in _row_slices(batches):
            out = [model.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])
    rows = df.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"),
                     F.col(common.quoted(ids_col)).cast("array<int>").alias("ids"))
    return rows.mapInArrow(fn, "doc_id long, text string")


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode with an end id and decode in one pass, keeping digests only: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256`` (ids as decimal numbers joined by one space; the decoded text in UTF-8), and ``exact``:
    whether the decoded text is the text itself (a U+2581 of the text comes back as a blank)."""
    def fn(batches):
        coder = _coder(model_path)
        end = str(coder.model.eos)
        for batch in _row_slices(batches):
            texts = batch.column(1).to_pylist()
            n_tokens, ids_hash, text_hash, exact = [], [], [], []
            for t, slices in zip(texts, coder.texts(texts)):
                a, b, n, at, same = hashlib.sha256(), hashlib.sha256(), 1, 0, True
                for ids, count, text in slices:
                    a.update((ids + " ").encode())
                    b.update(text.encode())
                    same = same and t.startswith(text, at)
                    n, at = n + count, at + len(text)
                a.update(end.encode())
                n_tokens.append(n)
                ids_hash.append(a.hexdigest())
                text_hash.append(b.hexdigest())
                exact.append(same and at == len(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_hash),
                                              pa.array(text_hash), pa.array(exact)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])
    return common.spread(common.texts(df, id_col, text_col)).mapInArrow(
        fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
