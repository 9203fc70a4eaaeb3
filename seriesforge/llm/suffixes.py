"""Exact removal of long repeated byte strings by a distributed merge sort of suffixes.

The suffixes that matter are sampled so that nothing is missed: the anchor of a window of
``window`` bytes is its 24-byte gram of least hash (leftmost on ties). Equal windows have equal
anchors at equal offsets, so it is enough to sort the suffixes at anchors, each with the bytes
before it that its windows reach (about one position in fourteen).

1. Blocks of documents send their sorted anchor hashes to buckets; a bucket replies with one bit
   per hash, set if another document has it. Text that repeats nowhere goes no further.
2. Blocks sort the remaining suffixes, fold equal ones into one entry with the smallest doc_id, and
   send each bucket a front-coded run (common prefix length, then the new bytes).
3. A bucket merges its runs with a loser tree that keeps each contender's common prefix with the
   last output: different lengths decide without looking at a byte, equal ones are compared beyond
   the prefix only. The merged order brings equal windows together; every run is told, for its
   entries, the smallest doc_id of each window.
4. Blocks mark the bytes of windows that start in a smaller document.

A run holds an equal suffix once, however many documents have it, so a passage in a third of all
documents costs a bucket one entry per block, and no list of its documents is ever gathered.

A gram with ``HOT`` anchors or more (the ends of such a passage, a common phrase) has about as many
different surroundings as documents. Its entries don't go to one bucket: blocks spell out their
windows, fold equal ones to the smallest doc_id, and deal them out by their own bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
GRAM = 24
BLOCK_BYTES = 16 << 20
HOT = 1 << 13                    # anchors of one gram, from which on its windows are dealt out one by one
_HOT_ROWS = 1 << 15              # anchors of hot grams that are spelled out at a time
_ANSWER_ROWS = 1 << 16           # anchors that are put in classes at a time when answers come back
_WIDE, _LEFT = 56, 32            # bytes of the padded right and left part of an entry
_B = 0x100000001B3


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<3sq", a.dtype.str.encode()[-3:], len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<3sq", raw, at)
        at += struct.calcsize("<3sq")
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint64) + np.uint64(1)
    power = lambda k: np.uint64(pow(_B, k, 1 << 64))
    width, h = 1, x
    kept = {1: x}
    while width < 16:
        h = h[:-width] * power(width) + h[width:]
        width *= 2
        kept[width] = h
    n = len(data) - GRAM + 1
    return common.mix64(kept[16][:n] * power(8) + kept[8][16:16 + n])


def anchors(data: np.ndarray, starts: np.ndarray, window: int = WINDOW):
    """Anchors of all windows inside the texts of a buffer: position, first and last window start,
    48-bit key. The windows of one anchor are consecutive."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < window:
        return none
    h = _gram_hashes(data)
    order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    low = common.sliding_min(order, window - GRAM + 1)
    step = np.zeros(len(data) + 1, np.int64)
    long = (starts[1:] - starts[:-1]) >= window
    np.add.at(step, starts[:-1][long], 1)
    np.add.at(step, starts[1:][long] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(step)[:len(low)] > 0)
    if not len(at):
        return none
    p = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(p[1:] != p[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    p = p[first]
    return p, at[first], at[last], common.mix64(h[p], 5) >> np.uint64(16)


class _Block:
    """The texts of a block in a fixed order, and their anchors."""

    def __init__(self, pdf: pd.DataFrame, window: int):
        rows = sorted(zip(pdf["doc_id"].tolist(), pdf["text"].tolist()))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.texts = [r[1] for r in rows]
        self.window = window
        found = []
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        self.padded = np.frombuffer(b"".join([bytes(_LEFT), *self.texts, bytes(_WIDE)]), np.uint8)
        self.data = self.padded[_LEFT:len(self.padded) - _WIDE]
        row = 0
        while row < len(rows):              # a few whole texts at a time stay in the CPU's cache
            stop = max(row + 1, int(np.searchsorted(self.starts, self.starts[row] + common.CHUNK_BYTES, "right")) - 1)
            base = self.starts[row]
            p, i0, i1, key = anchors(self.data[base:self.starts[stop]], self.starts[row:stop + 1] - base, window)
            found.append((p + base, i0 + base, i1 + base, key))
            row = stop
        self.p, self.i0, self.i1, self.key = (np.concatenate(c) for c in zip(*found))
        self.doc = self.ids[np.searchsorted(self.starts, self.p, "right") - 1]

    def entries(self, chosen: np.ndarray):
        """Right and left bytes (padded with zeros) of the chosen anchors, and offsets of the windows."""
        p = self.p[chosen]
        o_max, o_min = p - self.i0[chosen], p - self.i1[chosen]
        right = sliding_window_view(self.padded, _WIDE)[p + _LEFT]
        right[np.arange(_WIDE) >= (self.window - o_min)[:, None]] = 0
        left = np.ascontiguousarray(sliding_window_view(self.padded, _LEFT)[p][:, ::-1])
        left[np.arange(_LEFT) >= o_max[:, None]] = 0
        return right, left, o_min.astype(np.uint8), o_max.astype(np.uint8)

    def spelled(self, starts: np.ndarray) -> np.ndarray:
        return sliding_window_view(self.padded, self.window)[starts + _LEFT]

    def windows(self, chosen: np.ndarray):
        """The windows of each class of equal anchors among the chosen, some whole keys at a time: the
        classes' first anchors, their keys, smallest and largest doc_ids, and per window its class, start and bytes."""
        chosen = chosen[np.argsort(self.key[chosen], kind="stable")]
        for a, z in _whole_keys(self.key[chosen], _HOT_ROWS):
            sel = chosen[a:z]
            order, _, first = _classes(*self.entries(sel), last_key=self.doc[sel])
            last = np.concatenate([first[1:], [len(order)]]) - 1
            pick = sel[order[first]]
            n = self.i1[pick] - self.i0[pick] + 1
            owner = np.repeat(np.arange(len(pick)), n)
            starts = self.i0[pick][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            yield (pick, np.unique(self.key[sel]), self.doc[sel][order[first]], self.doc[sel][order[last]], owner,
                   starts, self.spelled(starts))


def _whole_keys(key: np.ndarray, most: int):
    """Bounds of stretches of sorted keys, of at most ``most`` rows unless one key has more; equal keys are in one stretch."""
    a = 0
    while a < len(key):
        z = len(key)
        if a + most < z:
            z = int(np.searchsorted(key, key[a + most - 1], "left"))
            z = z if z > a else int(np.searchsorted(key, key[a], "right"))
        yield a, z
        a = z


def _classes(right, left, o_min, o_max, first_key=None, last_key=None):
    """Sort order of entries, and the number of each one's class of equal entries in that order."""
    words = [*right.view(">u8").T, *left.view(">u8").T]
    words = [w.astype(np.uint64) for w in words] + [o_min.astype(np.uint64) << np.uint64(8) | o_max]
    if first_key is not None:
        words.insert(0, first_key)
    order = np.lexsort(([last_key] if last_key is not None else []) + words[::-1])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for w in words:
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _alike(grid: np.ndarray):
    """Sort order of byte rows (by their order of arrival where equal), the number of each one's class of equal rows
    in that order, the first places of the classes, and a hash of every row."""
    wide = np.zeros((len(grid), _WIDE), np.uint8)
    wide[:, :grid.shape[1]] = grid
    words = wide.view(">u8").astype(np.uint64).T
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    hashed = np.zeros(len(order), np.uint64)
    for w in words:
        hashed = common.mix64(hashed ^ w, 7)
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new), hashed


def _request_keys(buckets: int, window: int):
    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = _Block(pdf, window)
        rows = []
        for bucket, sel in _by_bucket(b.key, buckets):
            order = np.lexsort((b.doc[sel], b.key[sel]))
            k, d = b.key[sel][order], b.doc[sel][order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            last = np.concatenate([first[1:], [len(k)]]) - 1
            u = k[first]
            rows.append((key[0], bucket, _pack(np.diff(u, prepend=np.uint64(0)), (d[first] != d[last]).astype(np.uint8),
                                               np.minimum(last - first + 1, 0xFFFF).astype(np.uint16))))
        return pd.DataFrame(rows, columns=["block", "bucket", "blob"])
    return fn


def _by_bucket(key: np.ndarray, buckets: int):
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in range(buckets):
        if cut[i] < cut[i + 1]:
            yield i, order[cut[i]:cut[i + 1]]


def _answer_keys(hot_from: int):
    """Two rows of bits for a block's keys: another document has it, and it has ``hot_from`` anchors."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, many, counts = [], [], []
        for blob in pdf["blob"]:
            delta, multi, count = _unpack(blob)
            keys.append(np.cumsum(delta, dtype=np.uint64))
            many.append(multi)
            counts.append(count)
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        again = (np.bincount(inverse) + np.bincount(inverse, weights=np.concatenate(many))) > 1
        hot = np.bincount(inverse, weights=np.concatenate(counts)) >= hot_from
        cut = np.cumsum([0] + [len(k) for k in keys])
        bits = [np.packbits(again[inverse[a:b]]).tobytes() + np.packbits(hot[inverse[a:b]]).tobytes()
                for a, b in zip(cut[:-1], cut[1:])]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "blob": bits})
    return fn


def _hot_requests(block: int, b: _Block, chosen: np.ndarray, buckets: int):
    """Every different window of the chosen anchors once, with its smallest doc_id, to the bucket of its bytes."""
    parts = []
    for pick, _, low, high, owner, starts, grid in b.windows(chosen):
        order, _, first, hashed = _alike(grid)
        least = np.minimum.reduceat(low[owner][order], first)
        multi = least != np.maximum.reduceat(high[owner][order], first)
        rep = order[first]
        back = np.argsort(rep)                  # neighbours overlap, which compresses well
        rep = rep[back]
        anchor = pick[owner[rep]]
        parts.append((hashed[rep], starts[rep], least[back], multi[back].astype(np.uint8), anchor.astype(np.uint32),
                      (b.p[anchor] - starts[rep]).astype(np.uint8)))
    if not parts:
        return
    hashed, starts, *rest = (np.concatenate(c) for c in zip(*parts))
    for bucket, sel in _by_bucket(hashed, buckets):
        yield block, bucket, True, _pack(b.spelled(starts[sel]).reshape(-1), *[c[sel] for c in rest])


def _hot_answers(blocks: list[int], blobs: list[bytes], window: int):
    got = [_unpack(x) for x in blobs]
    grid = np.concatenate([g[0] for g in got]).reshape(-1, window)
    low, multi, ordinal, offset = (np.concatenate(c) for c in list(zip(*got))[1:])
    order, cls, first, _ = _alike(grid)
    least = np.empty(len(order), np.int64)
    least[order] = np.minimum.reduceat(low[order], first)[cls]
    use = multi.astype(bool) | (least < low)
    cut = np.cumsum([0] + [len(g[1]) for g in got])
    for block, a, z in zip(blocks, cut[:-1], cut[1:]):
        at = a + np.flatnonzero(use[a:z])
        if len(at):
            yield block, True, _pack(ordinal[at], offset[at], least[at])


def _hot_spans(b: _Block, blobs: list[bytes]):
    """Answers about windows as answers about all classes of anchors that have them: first anchor, least and
    largest offset of a stretch of windows with one answer, its smallest doc_id."""
    ordinal, offset, low = (np.concatenate(c) for c in zip(*[_unpack(x) for x in blobs]))
    ordinal = ordinal.astype(np.int64)
    asked = b.key[ordinal]
    for pick, keys, _, _, owner, starts, grid in b.windows(np.flatnonzero(np.isin(b.key, asked))):
        mine = np.flatnonzero(np.isin(asked, keys))
        told = b.spelled(b.p[ordinal[mine]] - offset[mine])
        order, cls, first, _ = _alike(np.concatenate([told, grid]))
        at = np.empty(len(order), np.int64)
        at[order] = cls
        answer, known = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        answer[at[:len(mine)]] = low[mine]
        known[at[:len(mine)]] = True
        at = at[len(mine):]
        hit = np.flatnonzero(known[at])
        if not len(hit):
            continue
        who, value = owner[hit], answer[at[hit]]
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(who) != 0) | (np.diff(value) != 0)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(hit)]]) - 1
        anchor = pick[who[begin]]
        yield anchor, b.p[anchor] - starts[hit[end]], b.p[anchor] - starts[hit[begin]], value[begin]


def _request_runs(buckets: int, window: int):
    def fn(key: tuple, docs: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        b = _Block(docs, window)
        answer = dict(zip(bits["bucket"], bits["blob"]))
        chosen, dealt = [], [np.zeros(0, np.int64)]
        for bucket, sel in _by_bucket(b.key, buckets):
            u, inverse = np.unique(b.key[sel], return_inverse=True)
            again, hot = np.unpackbits(np.frombuffer(answer[bucket], np.uint8).reshape(2, -1), axis=1, count=len(u)).astype(bool)
            chosen.append(sel[(again & ~hot)[inverse]])
            dealt.append(sel[(again & hot)[inverse]])
        rows = list(_hot_requests(key[0], b, np.concatenate(dealt), buckets))
        for sel in chosen:
            if not len(sel):
                continue
            right, left, o_min, o_max = b.entries(sel)
            order, _, first = _classes(right, left, o_min, o_max, last_key=b.doc[sel])
            last = np.concatenate([first[1:], [len(order)]]) - 1
            low, high = b.doc[sel][order[first]], b.doc[sel][order[last]]
            pick = order[first]
            r, lf = right[pick], left[pick]
            same = np.minimum.accumulate(r[1:] == r[:-1], axis=1).sum(axis=1)
            reach = (window - o_min[pick]).astype(np.int64)
            lcp = np.concatenate([[0], np.minimum(same, reach[:-1])]).astype(np.uint8)   # real bytes only
            place = np.arange(_WIDE)
            fresh = (place >= lcp[:, None]) & (place < reach[:, None])
            before = np.arange(_LEFT) < o_max[pick][:, None]
            rows.append((key[0], int(b.key[sel[0]] % np.uint64(buckets)), False,
                         _pack(lcp, r[fresh], lf[before], o_min[pick], o_max[pick], low,
                               (low != high).astype(np.uint8), sel[pick].astype(np.uint32))))
        return pd.DataFrame(rows, columns=["block", "bucket", "hot", "blob"])
    return fn


class _Run:
    """A front-coded run, decoded."""

    def __init__(self, blob: bytes, window: int):
        lcp, fresh, before, o_min, o_max, low, multi, ordinal = _unpack(blob)
        n = len(lcp)
        reach = window - o_min.astype(np.int64)
        place = np.arange(_WIDE)
        has = (place >= lcp[:, None]) & (place < reach[:, None])
        source = np.where(has, np.arange(n, dtype=np.int32)[:, None], np.int32(0))
        np.maximum.accumulate(source, axis=0, out=source)   # the last row that spelled out this byte
        grid = np.zeros((n, _WIDE), np.uint8)
        grid[has] = fresh
        grid = grid[source, place]
        grid[place >= reach[:, None]] = 0
        back = np.zeros((n, _LEFT), np.uint8)
        back[np.arange(_LEFT) < o_max[:, None]] = before
        raw, raw_left = grid.tobytes(), back.tobytes()
        as_int = int.from_bytes
        self.right = [as_int(raw[i:i + _WIDE], "big") for i in range(0, n * _WIDE, _WIDE)]
        self.left = [as_int(raw_left[i:i + _LEFT], "big") for i in range(0, n * _LEFT, _LEFT)]
        # padded bytes count for the order, so the common prefix is taken over padded entries
        same = np.minimum.accumulate(grid[1:] == grid[:-1], axis=1).sum(axis=1)
        self.lcp = [0, *same.tolist()]
        self.offsets = list(zip(o_min.tolist(), o_max.tolist()))
        self.low, self.multi, self.ordinal = low.tolist(), multi.tolist(), ordinal


def merged(values: list[list[int]], prefixes: list[list[int]], width: int = _WIDE):
    """K-way merge of sorted runs of ``width``-byte integers: yields (run, index, common prefix
    with the last output). ``prefixes`` are the common prefixes inside each run."""
    runs = len(values)
    size = 1
    while size < runs:
        size *= 2
    at = [0] * size
    value = [v[0] if v else 0 for v in values] + [0] * (size - runs)
    # a contender's common prefix with the last output of its part of the tree; -1: exhausted
    lcp = [0 if v else -1 for v in values] + [-1] * (size - runs)
    bits = 8 * width
    loser = [0] * size

    def play(a, b):
        """Winner and loser of two contenders; the loser keeps its prefix with the winner."""
        la, lb = lcp[a], lcp[b]
        if la > lb:
            return a, b
        if la < lb:
            return b, a
        if la < 0:
            return a, b
        x = value[a] ^ value[b]
        same = (bits - x.bit_length()) >> 3
        if value[a] <= value[b]:
            lcp[b] = same
            return a, b
        lcp[a] = same
        return b, a

    winners = list(range(size))
    nodes = size
    while nodes > 1:
        nodes //= 2
        nxt = []
        for i in range(nodes):
            w, lo = play(winners[2 * i], winners[2 * i + 1])
            loser[nodes + i] = lo
            nxt.append(w)
        winners = nxt
    w = winners[0]
    while lcp[w] >= 0:
        i = at[w]
        yield w, i, lcp[w]
        i += 1
        at[w] = i
        run = values[w]
        if i < len(run):
            value[w] = run[i]
            lcp[w] = prefixes[w][i]
        else:
            lcp[w] = -1
        node = (size + w) >> 1
        while node:
            other = loser[node]
            la, lb = lcp[w], lcp[other]
            if la < lb:
                loser[node] = w
                w = other
            elif la == lb and la >= 0:
                x = value[w] ^ value[other]
                same = (bits - x.bit_length()) >> 3
                if value[w] <= value[other]:
                    lcp[other] = same
                else:
                    lcp[w] = same
                    loser[node] = w
                    w = other
            node >>= 1


def _answer_runs(window: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        rows, dealt = [], pdf[pdf["hot"]]
        if len(dealt):
            rows += _hot_answers(dealt["block"].tolist(), dealt["blob"].tolist(), window)
        pdf = pdf[~pdf["hot"]]
        runs = [_Run(blob, window) for blob in pdf["blob"]]
        replies: list[tuple[list, list, list, list]] = [([], [], [], []) for _ in runs]

        def reply(r, i, lo, hi, low):
            for column, v in zip(replies[r], (i, lo, hi, low)):
                column.append(v)

        def settle(group):
            if len(group) == 1:
                r, i = group[0]
                if runs[r].multi[i]:
                    reply(r, i, *runs[r].offsets[i], runs[r].low[i])
                return
            r, i = group[0]
            head = (runs[r].right[i], runs[r].left[i], runs[r].offsets[i])
            if all((runs[r].right[i], runs[r].left[i], runs[r].offsets[i]) == head for r, i in group):
                low = min(runs[r].low[i] for r, i in group)
                for r, i in group:
                    if runs[r].multi[i] or runs[r].low[i] > low:
                        reply(r, i, *runs[r].offsets[i], low)
                return
            least: dict = {}
            spelled = []
            for r, i in group:
                right, left, (lo, hi) = runs[r].right[i], runs[r].left[i], runs[r].offsets[i]
                own = [(o, left >> 8 * (_LEFT - o), right >> 8 * (_WIDE - window + o)) for o in range(lo, hi + 1)]
                low = runs[r].low[i]
                for k in own:
                    if least.get(k, low) >= low:
                        least[k] = low
                spelled.append(own)
            for (r, i), own in zip(group, spelled):
                a = 0
                while a < len(own):                 # stretches of windows with one answer
                    low = least[own[a]]
                    z = a
                    while z + 1 < len(own) and least[own[z + 1]] == low:
                        z += 1
                    if runs[r].multi[i] or low < runs[r].low[i]:
                        reply(r, i, own[a][0], own[z][0], low)
                    a = z + 1

        group: list[tuple[int, int]] = []
        for r, i, lcp in merged([x.right for x in runs], [x.lcp for x in runs]):
            if lcp < GRAM and group:
                settle(group)
                group = []
            group.append((r, i))
        if group:
            settle(group)
        for block, run, (i, lo, hi, low) in zip(pdf["block"], runs, replies):
            if i:
                rows.append((block, False, _pack(run.ordinal[np.array(i)], np.array(lo, np.uint8), np.array(hi, np.uint8),
                                                 np.array(low, np.int64))))
        return pd.DataFrame(rows, columns=["block", "hot", "blob"])
    return fn


def _remove(window: int):
    def fn(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = _Block(docs, window)
        step = np.zeros(len(b.data) + 1, np.int32)
        got = [_unpack(x) for x in answers["blob"][~answers["hot"]]]
        if answers["hot"].any():
            got += _hot_spans(b, answers["blob"][answers["hot"]].tolist())
        if got:
            ordinal, lo, hi, low = (np.concatenate(c) for c in zip(*got))
            del got
            by_key = np.argsort(b.key[ordinal], kind="stable")
            ordinal, lo, hi, low = ordinal[by_key].astype(np.int64), lo[by_key], hi[by_key], low[by_key]
            asked = b.key[ordinal]
            chosen = np.flatnonzero(np.isin(b.key, asked))
            chosen = chosen[np.argsort(b.key[chosen], kind="stable")]
            key = b.key[chosen]
            cls_of = np.full(len(b.key), -1)
            for a, z in _whole_keys(key, _ANSWER_ROWS):     # a class has one key
                sel = chosen[a:z]
                order, cls, _ = _classes(*b.entries(sel))
                cls_of[sel[order]] = cls
                # every anchor of an answered class, with each of its answers
                base = int(np.searchsorted(asked, key[a], "left"))
                told = cls_of[ordinal[base:int(np.searchsorted(asked, key[z - 1], "right"))]]
                by_cls = base + np.argsort(told, kind="stable")
                count = np.bincount(told, minlength=int(cls[-1]) + 1)
                begin = np.cumsum(count) - count
                c = cls_of[sel]
                anchor = np.repeat(sel, count[c])
                nth = np.arange(len(anchor)) - np.repeat(np.cumsum(count[c]) - count[c], count[c])
                answer = by_cls[np.repeat(begin[c], count[c]) + nth]
                use = b.doc[anchor] > low[answer]
                anchor, answer = anchor[use], answer[use]
                np.add.at(step, b.p[anchor] - hi[answer].astype(np.int64), 1)
                np.add.at(step, b.p[anchor] - lo[answer].astype(np.int64) + window, -1)
        gone = np.cumsum(step, dtype=np.int32, out=step)[:-1] > 0
        del step
        none = np.zeros(0, np.int32)
        rows = []
        for doc_id, text, s, e in zip(b.ids.tolist(), b.texts, b.starts[:-1].tolist(), b.starts[1:].tolist()):
            g = gone[s:e]
            if not g.any():
                rows.append((doc_id, text, none, none))
                continue
            edge = np.diff(g.astype(np.int8), prepend=0, append=0)
            rows.append((doc_id, b.data[s:e][~g].tobytes(), np.flatnonzero(edge == 1).astype(np.int32),
                         np.flatnonzero(edge == -1).astype(np.int32)))
        return pd.DataFrame(rows, columns=["doc_id", "kept", "span_start", "span_end"])
    return fn


def repeated_strings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts in a document with a
    smaller id: ``doc_id, n_bytes, n_removed, n_spans, span_start, span_end, kept``.

    Texts are UTF-8 bytes (null: empty); ``kept`` is binary, the remaining bytes in order, and the
    spans are the maximal removed runs as byte positions, end exclusive. Strings are judged on the
    input. Repeated rows of one id count as one document for "smaller" and each get their
    own result row. A row with a null id keeps its text and removes nothing. An empty
    table gives an empty result. ``window`` is from 32 to 50 (an entry's padded size). ``hot`` decides how
    grams are dealt out, not what is removed.
    """
    if not 32 <= window <= WINDOW:
        raise ValueError("window must be from 32 to 50 bytes")
    if not 1 <= hot <= 0xFFFF:
        raise ValueError("hot must be from 1 to 65535 anchors")
    docs = common.texts(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    spark = df.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(4 * spark.sparkContext.defaultParallelism, -(-total // block_bytes))
    placed = (docs.where("doc_id is not null")
              .select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text"))
    request = "block int, bucket int, blob binary"
    run, answer = "block int, bucket int, hot boolean, blob binary", "block int, hot boolean, blob binary"
    keys = placed.groupBy("block").applyInPandas(_request_keys(blocks, window), request)
    bits = keys.groupBy("bucket").applyInPandas(_answer_keys(hot), request)
    runs = (placed.groupBy("block").cogroup(bits.groupBy("block"))
            .applyInPandas(_request_runs(blocks, window), run))
    found = runs.groupBy("bucket").applyInPandas(_answer_runs(window), answer)
    out = (placed.groupBy("block").cogroup(found.groupBy("block"))
           .applyInPandas(_remove(window), "doc_id long, kept binary, span_start array<int>, span_end array<int>"))
    none = F.array().cast("array<int>")
    out = out.unionByName(docs.where("doc_id is null").select(
        "doc_id", F.col("text").alias("kept"), none.alias("span_start"), none.alias("span_end")))
    removed = F.aggregate(F.zip_with("span_end", "span_start", lambda e, s: (e - s).cast("long")),
                          F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.select("doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
                      F.size("span_start").cast("long").alias("n_spans"), "span_start", "span_end", "kept")
