"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Only built-in functions. The matches of a pattern and the pieces between them (a split by the same
pattern) have lengths that add up to positions in code points. Patterns are written so that a find starts only
where a leftmost match can start, and repetitions are possessive where nothing can be given back:
time stays linear in the text, also on very long runs of digits or letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_LOCAL = "A-Za-z0-9._%+-"
# kind: (pattern, cheap test for texts that cannot match)
PATTERNS = {
    # starts where a run of local characters starts, or right after the match before
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    # a whole run of digits with single separators, if it has 14 to 19 digits
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", r"[0-9][0-9 -]{12}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
}
BASE = ["email", "ip", "card", "phone"]
# score of the bare pattern, and the words near a span that raise it
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|contact|write to|address", "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|payment|account", "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|konto", "ssn": "ssn|social security|tax id",
}
CHECKSUM_GAIN, CONTEXT_GAIN, LEAST = 0.4, 0.2, 0.5
NEAR = 48
STRETCH = 64                    # characters, NEAR or more


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.split(F.reverse(digits), "")
    value = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97 (first four characters last, A is 10)."""
    moved = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


def _prefix_sums(lengths: Column) -> Column:
    """Sums of an array of numbers up to and with each entry: every round adds what stands 1, 2, 4, ... places before, and no
    array grows entry by entry."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths) + 1)).cast("int"))
    step = lambda r: F.call_function("shiftleft", F.lit(1), r)
    return F.aggregate(rounds, lengths, lambda sums, r: F.transform(
        sums, lambda v, i: v + F.when(i >= step(r), F.get(sums, i - step(r))).otherwise(F.lit(0))))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not once for every entry of an array that ``body`` goes through."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _near(stretches: Column, start: Column, length: Column) -> Column:
    """``length`` (at most ``STRETCH``) characters from ``start`` of a text cut into stretches."""
    at = F.floor(start / STRETCH).cast("int")
    two = F.concat(F.coalesce(F.get(stretches, at), F.lit("")), F.coalesce(F.get(stretches, at + 1), F.lit("")))
    return F.substring(two, start - at * STRETCH + 1, length)


def _spans(text: Column, kind: str, order: int) -> Column:
    """Array of (start, order, end, kind, score) of the valid matches of one kind."""
    pattern, hint = PATTERNS[kind]
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    checksum = CHECKSUM_GAIN if kind in ("card", "iban") else 0.0

    def placed(found):
        lengths = F.zip_with(F.slice(found["gaps"], 1, F.size(found["hits"])), found["hits"], lambda g, h: F.length(g) + F.length(h))
        return F.struct(found["hits"].alias("hits"), _prefix_sums(lengths).alias("ends"), found["stretches"].alias("stretches"))

    def scored(end, hit, stretches):
        start = end - F.length(hit)
        low = F.greatest(start - NEAR, F.lit(0))
        near = F.concat(_near(stretches, low, start - low), F.lit(" "), _near(stretches, end, F.lit(NEAR)))
        score = F.lit(SCORES[kind] + checksum) + F.when(near.rlike(rf"(?i)\b(?:{CONTEXT[kind]})"), CONTEXT_GAIN).otherwise(0.0)
        return F.when(_valid(kind, hit), F.struct(
            start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"),
            F.round(F.least(score, F.lit(1.0)), 2).alias("score")))
    found = F.struct(gaps.alias("gaps"), hits.alias("hits"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("stretches"))
    spans = _bound(found, lambda f: _bound(placed(f), lambda p: F.filter(
        F.zip_with(p["ends"], p["hits"], lambda end, hit: scored(end, hit, p["stretches"])), lambda s: s.isNotNull())))
    empty = F.expr("cast(array() as array<struct<start:int,`order`:int,`end`:int,kind:string,score:double>>)")
    return F.when(text.rlike(hint), spans).otherwise(empty)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, found``: every span as (start, order, end, kind, score), by start, then kind in
    the order of ``PATTERNS``; positions are code points, ends exclusive.

    Base kinds (email, ip, card, phone) are leftmost matches without overlap within their kind
    that pass their check; their score never removes them. IBANs must pass mod 97, social
    security numbers need a context word. Null texts are empty; empty texts have no spans; repeated
    rows and null ids are rows like any other.
    """
    docs = common.spread(common.texts(df, id_col, text_col))
    text = F.col("text")
    every = [_spans(text, kind, i) for i, kind in enumerate(PATTERNS)]
    found = F.sort_array(F.filter(F.concat(*every), lambda s: (s["order"] < len(BASE)) | (s["score"] >= LEAST)))
    return docs.select("doc_id", "text", found.alias("found"))


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_pii``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans, scores``; a span is written kind:start:end, spans are joined by commas."""
    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    counts = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("found")).alias("spans"),
                        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"))
