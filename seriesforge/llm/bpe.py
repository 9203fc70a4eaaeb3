"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The encoding of every prefix of a word is known as soon as the prefix is read: its last token is
the one that ends there and may follow the last token of the encoding before it (a pair may
follow if the merges of its joined bytes give back that pair). A state of the transducer is the
set of open threads, each a trie node reached inside some token and the token before it; reading a
byte moves all threads at once and yields the last token of the prefix. Tokens are emitted once the
paths of all open threads agree on them; a thread is never older than the longest token, which
bounds the lookahead. States and moves are made when first needed, and kept up to a limit.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_STATES = 200_000
MAX_WORDS = 150_000
SETTLE = 1 << 12             # bytes of a long word between emissions
STEP = 1 << 15


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Word bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.child: dict[int, int] = {}             # node << 8 | byte
        self.token_at = [-1]
        self.depth = [0]
        self.open = [True]                          # whether a longer token goes on from here
        # tokens down the right and the left edge of a token's merge tree, the token itself last
        self.right_edge: dict[int, list[int]] = {}
        self.left_edge: dict[int, list[int]] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._halves(token)
            if halves is None:
                continue                            # no merges lead to it
            if len(token) == 1:
                self.right_edge[i], self.left_edge[i] = [i], [i]
            else:
                self.right_edge[i] = self.right_edge[halves[1]] + [i]
                self.left_edge[i] = self.left_edge[halves[0]] + [i]
            node = 0
            for b in token:
                self.open[node] = True
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.open.append(False)
                node = nxt
            self.token_at[node] = i
        self.length = {i: len(t) for i, t in self.bytes_of.items()}
        self.max_states = max_states
        self._reset()

    def _reset(self) -> None:
        self.index: dict[tuple, int] = {}
        self.threads: list[tuple] = []
        self.last: list[int] = []                   # last token of the prefix that leads to a state
        self.moves: dict[int, int] = {}             # state << 8 | byte
        self.follows: dict[int, bool] = {}
        self._state((0,), -1)

    def _state(self, threads: tuple, last: int) -> int:
        i = self.index.get(threads)
        if i is None:
            i = self.index[threads] = len(self.threads)
            self.threads.append(threads)
            self.last.append(last)
        return i

    def _halves(self, word: bytes) -> tuple[int, int] | None:
        """The last merge that makes ``word`` (lowest rank first, leftmost on ties); None if they
        end in more than one token."""
        parts = [word[i:i + 1] for i in range(len(word))]
        rank = self.ranks.get
        halves = (b"", word)
        while len(parts) > 1:
            pairs = [rank(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
            best = pairs.index(min(pairs))
            if pairs[best] == 1 << 60:
                return None
            halves = parts[best], parts[best + 1]
            parts[best:best + 2] = [halves[0] + halves[1]]
        return (self.ranks[halves[0]], self.ranks[halves[1]]) if len(word) > 1 else (-1, -1)

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves the two.

        Both are built in rank order; only the tokens at the seam matter, those on the right edge
        of one merge tree and on the left edge of the other. A merge across the seam
        spoils the pair if its turn comes before that of the next merge on either side.
        """
        known = self.follows.get(a << 20 | b)
        if known is not None:
            return known
        x, y = self.right_edge[a], self.left_edge[b]
        i = j = 0
        never = 1 << 60
        while True:
            across = self.ranks.get(self.bytes_of[x[i]] + self.bytes_of[y[j]], never)
            next_x = x[i + 1] if i + 1 < len(x) else never
            next_y = y[j + 1] if j + 1 < len(y) else never
            if across < next_x and across <= next_y and across < never:
                known = False               # on equal ranks the leftmost merge goes first
                break
            if next_x == next_y == never:
                known = True
                break
            if next_x <= next_y:
                i += 1
            else:
                j += 1
        self.follows[a << 20 | b] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        threads, last = [], -1
        for t in self.threads[state]:
            node = self.child.get((t >> 20) << 8 | byte)
            if node is None:
                continue
            if self.open[node]:
                threads.append(node << 20 | t & 0xFFFFF)
            token = self.token_at[node]
            before = (t & 0xFFFFF) - 1
            if token >= 0 and last < 0 and (before < 0 or self._may_follow(before, token)):
                last = token
        threads.append(last + 1)            # a new thread at the root, after that token
        to = self._state(tuple(threads), last)
        self.moves[state << 8 | byte] = to
        return to

    def _path(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            token = lasts[end - 1]
            out.append(token)
            end -= self.length[token]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode(self, word: bytes) -> list[int]:
        if len(self.threads) > self.max_states:
            self._reset()
        out: list[int] = []
        lasts: list[int] = []
        state = 0
        moves, last = self.moves.get, self.last
        for b in word:
            to = moves(state << 8 | b)
            if to is None:
                to = self._move(state, b)
            state = to
            lasts.append(last[state])
            if len(lasts) >= SETTLE:
                # what the paths of all open threads share is final
                paths = [self._path(lasts, len(lasts) - self.depth[t >> 20]) for t in self.threads[state]]
                shared = 0
                while shared < min(map(len, paths)) and len({p[shared] for p in paths}) == 1:
                    shared += 1
                out += paths[0][:shared]
                del lasts[:sum(self.length[t] for t in paths[0][:shared])]
        return out + self._path(lasts, len(lasts))


class Utf8Stream:
    """Incremental UTF-8 decoding by an explicit state machine.

    ``feed`` returns the characters complete so far; an ill-formed sequence becomes U+FFFD once for
    its longest valid beginning, as Unicode recommends; ``close`` ends the stream.
    """

    def __init__(self):
        self.need, self.point, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need:           # a well-formed stretch in one go, the machine takes up its open end
            end = len(data)
            while end and len(data) - end < 3 and data[end - 1] & 0xC0 == 0x80:
                end -= 1
            end = end - 1 if end and data[end - 1] >= 0xC0 else len(data)
            try:
                head = data[:end].decode()
            except UnicodeDecodeError:
                head, end = "", 0
            return head + self._run(data[end:])
        return self._run(data)

    def _run(self, data: bytes) -> str:
        out = []
        i = 0
        while i < len(data):
            b = data[i]
            if self.need:
                if self.low <= b <= self.high:
                    self.point = self.point << 6 | b & 0x3F
                    self.low, self.high = 0x80, 0xBF
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.point))
                    i += 1
                else:
                    out.append("�")
                    self.need, self.low, self.high = 0, 0x80, 0xBF
                continue            # the byte that broke the sequence is read again
            i += 1
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.point = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.point = 2, b & 0x0F
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.point = 3, b & 0x07
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left = "�" if self.need else ""
        self.need, self.low, self.high = 0, 0x80, 0xBF
        return left


class _Check:
    """Whether a stream of bytes decodes to a given text, without holding what it decodes."""

    def __init__(self, text: str):
        self.text, self.at, self.same, self.stream = text, 0, True, Utf8Stream()

    def feed(self, raw: bytes) -> None:
        part = self.stream.feed(raw)
        self.same = self.same and self.text.startswith(part, self.at)
        self.at += len(part)

    def done(self) -> bool:
        return self.same and not self.stream.close() and self.at == len(self.text)


_MADE: dict[tuple, tuple] = {}      # one transducer, pattern and word table per worker and vocabulary

_BYTES: dict[str, dict[int, bytes]] = {}


def _tools(path: str, pattern: str):
    key = (path, pattern)
    if key not in _MADE:
        _MADE[key] = Transducer(load_ranks(path)), regex.compile(pattern), {}
    return _MADE[key]


def _token_bytes(path: str) -> dict[int, bytes]:
    if path not in _BYTES:
        _BYTES[path] = {i: t for t, i in load_ranks(path).items()}
    return _BYTES[path]


def _words(text: str, split):
    """The matches of the pattern in slices, so that a long text is never held as one list."""
    found = (m.group() for m in split.finditer(text))
    while part := list(islice(found, STEP)):
        yield part


def _encoded(text: str, fst: Transducer, split, known: dict):
    """Slices of (ids as text joined by spaces, number of ids, bytes those ids decode to)."""
    parts = [split.findall(text)] if len(text) <= 8 * STEP else _words(text, split)
    for part in parts:
        got = []
        for w in part:
            k = known.get(w)
            if k is None:
                ids = fst.encode(w.encode())
                if len(known) >= MAX_WORDS:
                    known.clear()
                k = known[w] = (" ".join(map(str, ids)), len(ids), fst.decode(ids))
            got.append(k)
        if got:
            ids, count, raw = zip(*got)
            yield " ".join(ids), sum(count), b"".join(raw)


def encode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           carry: list[str] | None = None) -> DataFrame:
    """``doc_id, ids, exact`` and the columns in ``carry``: every whole text (null: empty) as token ids
    (``array<int>``), each match of ``pattern`` encoded on its own, no special tokens; ``exact`` says
    whether the ids decode, as a stream, to the very text. Repeated rows and null ids stay rows;
    an empty text has an empty list. ``vocab_path`` must be readable on every worker, like the
    package."""
    rows = df.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"),
                     F.coalesce(F.col(common.quoted(text_col)).cast("string"), F.lit("")).alias("text"),
                     *[F.col(common.quoted(c)).alias(f"carry_{i}") for i, c in enumerate(carry or [])])
    kept = rows.drop("text").schema
    names = [*kept.names, "ids", "exact"]

    def fn(batches):
        fst, split, known = _tools(vocab_path, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                ids, exact = [], []
                for t in batch.column(1).to_pylist():
                    parts, check = [], _Check(t)
                    for x, _, raw in _encoded(t, fst, split, known):
                        parts.append(np.fromstring(x, np.int32, sep=" "))
                        check.feed(raw)
                    ids.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
                    exact.append(check.done())
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                others = [batch.column(i) for i in range(batch.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays(
                    [*others, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                     pa.array(exact, pa.bool_())], names=names)
    schema = T.StructType([*kept.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("exact", T.BooleanType())])
    out = common.spread(rows).mapInArrow(fn, schema)
    return out.select("doc_id", "ids", "exact", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry or [])])


def decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: token ids back to text, decoded as a stream of UTF-8. A null list is empty;
    an id outside the vocabulary, or a null one, decodes to U+FFFD."""
    def fn(batches):
        token = _token_bytes(vocab_path)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                stream, parts = Utf8Stream(), []
                ids = iter(ids or ())
                while part := list(islice(ids, STEP)):
                    parts.append(stream.feed(b"".join([token.get(i, b"\xef\xbf\xbd") for i in part])))
                out.append("".join(parts) + stream.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])
    rows = df.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"),
                     F.col(common.quoted(ids_col)).cast("array<int>").alias("ids"))
    return rows.mapInArrow(fn, "doc_id long, text string")


def round_trip(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, keeping digests only: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256`` (ids as decimal numbers joined by one space; the decoded bytes), and ``exact``,
    whether the stream decodes to the text itself."""
    def fn(batches):
        fst, split, known = _tools(vocab_path, pattern)
        token = {str(i): t for i, t in fst.bytes_of.items()}
        for batch in batches:
            n_tokens, ids_hash, bytes_hash, exact = [], [], [], []
            for t in batch.column(1).to_pylist():
                a, b, n, lead, check = hashlib.sha256(), hashlib.sha256(), 0, "", _Check(t)
                for ids, count, raw in _encoded(t, fst, split, known):
                    a.update((lead + ids).encode())
                    b.update(raw)
                    check.feed(raw)
                    n, lead = n + count, " "
                n_tokens.append(n)
                ids_hash.append(a.hexdigest())
                bytes_hash.append(b.hexdigest())
                exact.append(check.done())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_hash),
                                              pa.array(bytes_hash), pa.array(exact)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])
    return common.spread(common.texts(df, id_col, text_col)).mapInArrow(
        fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
