"""Conversation structure repair with a suffix-shared automaton.

A row of a conversation becomes one symbol: the initial of its role (``s``, ``u``, ``a`` or another) and its fault.
The signature of a conversation, its symbols in order, decides the cheapest edits alone, so each distinct
signature is solved once. The signatures are sorted by their reverse: those that end alike lie next to each other,
and a task that reads them in this order adds only the nodes in front of the end it shares with the signature before
(one node a distinct suffix, as in building a minimal automaton from sorted words, from the end). A node holds, for every
grammar state, the cost to go and the first edit with the state it leads to; the rest of the best audit is
the node behind it. So nothing is computed twice for a suffix that conversations share, and no more than one signature's
nodes are in memory.

Edits: keep a row (cost 0), rerole it to user or assistant (1), delete it (2, the only one for blank and duplicate
rows), insert an empty user or assistant row (5); a truncated row that stays costs 5 more. The role initials of the result
are ``(s?(ua)+)?``; of equally cheap audits (initials of the edits in order) the least in ASCII order counts.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
OK, BLANK, DUPLICATE, CUT, GONE = range(5)          # faults of a row; GONE: not there, its conversation is
INITIALS = "suao"                                   # o: any other initial
# grammar states: nothing yet, after s, after u, after a (complete)
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = ("u", "u", "a", "u")                         # the turn that a rerole or an insertion gives in each state
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
END = ((0, "", START), (2 * INSERT, "I", USER), (INSERT, "I", ASSISTANT), (0, "", ASSISTANT))


@functools.lru_cache(maxsize=1 << 14)
def _node(symbol: str, behind: tuple[int, ...]) -> tuple:
    """(cost to go, first edit, state after it) for each state in front of a row of ``symbol`` (see ``_symbol``), given
    the costs behind the row. Edits that take the row first, then insertions, which lead to another state here."""
    initial, fault = INITIALS[(ord(symbol) - 48) % 4], (ord(symbol) - 48) // 4
    stay = TRUNCATED if fault == CUT else 0
    best = []
    for state in range(4):
        options = [(behind[state] + DELETE, "D", state)]
        if fault not in (BLANK, DUPLICATE):
            if (state, initial) in AFTER:
                to = AFTER[state, initial]
                options.append((behind[to] + KEEP + stay, "K", to))
            to = AFTER[state, NEXT[state]]
            options.append((behind[to] + REROLE + stay, "R", to))
        best.append(min(options))                   # equal costs: the least letter, as the letter decides the order
    for _ in range(4):
        for state in range(4):
            to = AFTER[state, NEXT[state]]
            best[state] = min(best[state], (best[to][0] + INSERT, "I", to))
    return tuple(best)


def _solve(front: list, state: int = START) -> tuple[int, str]:
    """(cost, audit) read off the nodes of a signature: ``front[0]`` is the node behind the last row."""
    cost, letters = front[-1][state][0], []
    for at in range(len(front) - 1, -1, -1):
        while True:
            _, letter, to = front[at][state]
            if not letter:
                break
            letters.append(letter)
            state = to
            if letter != "I":                       # the row is taken
                break
    return cost, "".join(letters)


def solve_sorted(signatures):
    """(signature, cost, audit) for signatures sorted by their reverse."""
    before, nodes = "", [END]
    base = [0]                                      # nodes hold costs above their least one, so that they recur
    for signature in signatures:
        shared, most = 0, min(len(before), len(signature))
        while shared < most and before[-1 - shared] == signature[-1 - shared]:
            shared += 1
        del nodes[shared + 1:], base[shared + 1:]
        for symbol in reversed(signature[:len(signature) - shared]):
            costs = [e[0] for e in nodes[-1]]
            least = min(costs)
            nodes.append(_node(symbol, tuple(c - least for c in costs)))
            base.append(base[-1] + least)
        cost, audit = _solve(nodes)
        yield signature, cost + base[-1], audit
        before = signature


# ---------------------------------------------------------------------------------------------
# Rows


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``conv_id, turn`` (longs, may be null), ``role, text`` (null: one space) and ``gone`` (false)."""
    text = lambda c: F.coalesce(F.col(common.quoted(c)).cast("string"), F.lit(" "))
    number = lambda c: F.col(common.quoted(c)).cast("long")
    return df.select(number(conv_col).alias("conv_id"), number(turn_col).alias("turn"), text(role_col).alias("role"),
                     text(text_col).alias("text"), F.lit(False).alias("gone"))


def damage(df: DataFrame, **names: str) -> DataFrame:
    """Rows of conversations with faults by ``crc32("conv_id:turn") % 20`` (a null there is one space): 0 drops the row
    (``gone``: the conversation stays known), 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 sets
    its role to user."""
    rows = conversations(df, **names)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("code")
    rows = rows.select("*", code)
    once, twice = F.array(F.lit(0)), F.array(F.lit(0), F.lit(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", "".join(ENDS), ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("gone"), F.explode(F.when(F.col("code") == 3, twice).otherwise(once)).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Every row with its symbol, rows of a conversation in one partition. Duplicates are found in a window by conversation,
    role and a 128-bit digest of the text, sorted after the one exchange by conversation; no task holds a conversation."""
    from pyspark.sql.window import Window
    trimmed = F.rtrim("text", F.lit(BLANKS))
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).repartition("conv_id")
    rows = rows.withColumn("time", F.row_number().over(same))
    fault = (F.when(F.col("gone"), F.lit(GONE)).when(trimmed == "", F.lit(BLANK)).when(F.col("time") > 1, F.lit(DUPLICATE))
             .when(~F.right(trimmed, F.lit(1)).isin(*ENDS), F.lit(CUT)).otherwise(F.lit(OK)))
    return rows.withColumn("symbol", _symbol(F.left("role", F.lit(1)), fault))


def _symbol(initial: Column, fault: Column) -> Column:
    """One character: 4 times the fault and the place of the initial in ``INITIALS``, counted from "0"."""
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(48) + 4 * fault + place)


#: Rows of a conversation in order. Rows of one turn: by role, then text.
ORDER = (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "text")


def _ordered(rows: DataFrame, first: tuple = (), last: tuple = ()) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", *first, *[way(c) for way, c in ORDER], *last)


def _pieces(batches):
    """(conversation, its rows in this batch) in order: a conversation may come in several pieces."""
    for batch in batches:
        ids = batch.column(0)
        values, missing = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((values[1:] != values[:-1]) | (missing[1:] != missing[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
            if hi > lo:
                yield (None if missing[lo] else int(values[lo])), batch.slice(lo, hi - lo)


def signatures(rows: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, signature`` (``gaps`` null where a long can't
    hold it). A task reads the rows of a
    conversation as a stream and keeps a byte for each."""
    counted = ("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT)
    names = ["conv_id", "gaps", *[c for c, _ in counted], "illegal", "signature"]
    legal = np.zeros((4, 4), bool)
    for pair in LEGAL:
        legal[INITIALS.index(pair[0]), INITIALS.index(pair[1])] = True

    def fn(batches):
        out: list = []

        def close():
            sig = np.concatenate(held) if held else np.zeros(0, np.uint8)
            fault, initial = (sig - 48) // 4, (sig - 48) % 4
            gaps = last - low + 1 - distinct if last is not None else 0
            out.append((key, gaps if gaps < 1 << 63 else None, *[int((fault == f).sum()) for _, f in counted],
                        int((~legal[initial[:-1], initial[1:]]).sum()), sig.tobytes().decode()))
        started, key, held, low, last, distinct = False, None, [], None, None, 0
        for conv, part in _pieces(batches):
            if not started or conv != key:
                if started:
                    close()
                started, key, held, low, last, distinct = True, conv, [], None, None, 0
            sym = np.array(part.column(2).to_pylist(), "S1").view(np.uint8)
            there = (sym - 48) // 4 != GONE
            held.append(sym[there])
            for t in np.unique([t for t, is_there in zip(part.column(1).to_pylist(), there) if is_there and t is not None]).tolist():
                if last is None or t > last:
                    low, last, distinct = t if low is None else low, t, distinct + 1
            if len(out) >= 4096:
                yield _batch(out, names)
                out = []
        if started:
            close()
        if out:
            yield _batch(out, names)

    def _batch(out, names):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "signature" else pa.int64())
                                           for n, c in zip(names, zip(*out))], names=names)
    return _ordered(_faults(rows), last=("time",)).select("conv_id", "turn", "symbol").mapInArrow(
        fn, ", ".join(f"{n} {'string' if n == 'signature' else 'long'}" for n in names))


def solve(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` for every distinct signature."""
    def fn(batches):
        for batch in _batches(solve_sorted(s for b in batches for s in b.column(0).to_pylist())):
            sig, cost, audit = zip(*batch)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())],
                                             names=["signature", "cost", "audit"])
    unique = signatures.select("signature").distinct().withColumn("ending", F.reverse("signature"))
    return (unique.repartitionByRange("ending").sortWithinPartitions("ending").select("signature")
            .mapInArrow(fn, "signature string, cost long, audit string"))


def _batches(rows, size: int = 1024):
    part = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def report(rows: DataFrame) -> DataFrame:
    """One row a conversation: counts of faults, ``cost`` and ``audit`` of its cheapest repair."""
    found = common.save(signatures(rows), "repair-signatures")
    return found.join(solve(found), "signature").select(*REPORT)


def _edited(rows: DataFrame, reports: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over a stream of ``(conv_id, turn, role, text, report)``: the report of a conversation comes first, its rows follow
    in order. One exchange by conversation; nothing is held but one batch."""
    rows = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text",
                                             *[F.lit(None).cast(t).alias(f"r_{c}") for c, t in reports.dtypes])
    heads = reports.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("string").alias("text"), *[F.col(c).alias(f"r_{c}") for c in reports.columns])
    return _ordered(heads.unionByName(rows).repartition("conv_id"), first=("kind",)).drop("kind").mapInArrow(fn, schema)


def _repairs(batches):
    """(report, edit, turn, role, text) for every edit of every conversation; deleted rows too, inserted ones with a null turn.
    A conversation starts with (report, None, ...)."""
    head, state, at = None, START, 0

    def inserted():
        nonlocal state, at
        while at < len(head["audit"]) and head["audit"][at] == "I":
            turn = NEXT[state]
            state, at = AFTER[state, turn], at + 1
            yield head, "I", None, ROLE[turn], ""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        reports = {n[2:]: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n.startswith("r_")}
        for i, (conv, turn, role, text) in enumerate(zip(*columns)):
            if reports["audit"][i] is not None:
                if head is not None:
                    yield from inserted()
                head, state, at = {**{n: v[i] for n, v in reports.items()}, "conv_id": conv}, START, 0
                yield head, None, None, None, None
                continue
            yield from inserted()
            edit = head["audit"][at]
            at += 1
            if edit == "R":
                role = ROLE[NEXT[state]]
            if edit != "D":
                state = AFTER[state, NEXT[state] if edit == "R" else role[:1]]
            yield head, edit, turn, role, text
    if head is not None:
        yield from inserted()


def repair(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id, position, edit, turn, role, text``, one row a row that stays (``edit`` K or R) or is
    inserted (I, null turn), ``position`` from 0.

    ``rows`` come from :func:`conversations` or :func:`damage`. Null ids are one conversation; null turns come first; rows of
    the same turn follow each other by role, then text, and of repeated rows the first stands. A role that starts with another
    letter than s, u or a can only be reroled or deleted. An empty table gives no rows. A conversation is streamed
    through one task, whatever its length."""
    def fn(batches):
        def rows_of():
            position = 0
            for head, edit, turn, role, text in _repairs(batches):
                if edit is None:
                    position = 0
                elif edit != "D":
                    yield head["conv_id"], position, edit, turn, role, text
                    position += 1
        types = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()
        for part in _batches(rows_of()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)],
                                             names=["conv_id", "position", "edit", "turn", "role", "text"])
    return _edited(rows, report(rows) if reports is None else reports, fn,
                   "conv_id long, position long, edit string, turn long, role string, text string")


def digest(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """The report of every conversation with ``repaired_sha256``: SHA-256 of its repaired rows as ``role:text``, joined by line
    breaks. A conversation without rows has zeros, an empty audit and the digest of an empty text."""
    def fn(batches):
        def rows_of():
            head, sha, lead = None, None, b""
            for now, edit, _, role, text in _repairs(batches):
                if edit is None:
                    if head is not None:
                        yield *[head[c] for c in REPORT], sha.hexdigest()
                    head, sha, lead = now, hashlib.sha256(), b""
                elif edit != "D":
                    sha.update(lead + f"{role}:{text}".encode())
                    lead = b"\n"
            if head is not None:
                yield *[head[c] for c in REPORT], sha.hexdigest()
        names = [*REPORT, "repaired_sha256"]
        for part in _batches(rows_of()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64())
                                              for n, c in zip(names, zip(*part))], names=names)
    schema = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in REPORT) + ", repaired_sha256 string"
    return _edited(rows, report(rows) if reports is None else reports, fn, schema)
