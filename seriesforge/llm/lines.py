"""Repeated runs of lines, found by hashes of all windows of lines, with built-in functions only.

Lines are trimmed and hashed; blank lines are left out of the sequence. Every window of ``run``
consecutive lines goes on with the hashes of all its lines as its key, and lines in a window whose
key stands earlier, by (id, position), are deleted; longer runs are covered by their windows. Windows
whose least hash occurs only once are left out before the keys are grouped. That saves work and
decides nothing: no fingerprints are selected and no matches extended, as winnowing would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = 2


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
               carry: list[str] | None = None, alone: int | None = None) -> DataFrame:
    """``doc_id, text, n_lines, n_deleted, kept`` and the columns in ``carry``: every row with its later repeated lines deleted.

    A run is ``run`` or more consecutive non-blank lines that stand, equal up to outer white space,
    earlier in the corpus: in a document with a smaller id, or above in the same text. The
    first occurrence stays. With ``alone``, a line of at least that many words is a run by itself,
    whatever its neighbours, in texts of one line too. ``kept`` is the text without the deleted lines, other lines and blank ones
    as they were. Rows with a null id, and null or empty texts, delete nothing (null: empty). Repeated rows of
    the same id and text share their positions, so each keeps what the first would keep.
    """
    rows = df.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"),
                     F.coalesce(F.col(common.quoted(text_col)).cast("string"), F.lit("")).alias("text"),
                     *[F.col(common.quoted(c)).alias(f"carry_{i}") for i, c in enumerate(carry or [])])
    rows = rows.withColumn("tie", F.xxhash64("text"))
    docs = rows.select("doc_id", "text", "tie")
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(" \t\r")).alias("line")))
    # 64 bits decide where to look; where equality counts, two independent hashes stand for a line
    hashed = F.transform(F.filter(numbered, lambda x: x["line"] != ""), lambda x: F.struct(
        x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"), F.xxhash64(F.lit(1), x["line"]).alias("h2"),
        *([] if alone is None else [(F.size(F.split(x["line"], r"\s+")) >= alone).alias("long")])))
    seq = (common.spread(docs).where("doc_id is not null").select("doc_id", "tie", hashed.alias("seq"))
           .where(F.size("seq") >= (run if alone is None else 1)))

    def window(part):
        return F.struct(F.transform(part, lambda x: x["at"]).alias("lines"),
                        F.array_min(F.transform(part, lambda x: x["h"])).alias("print"),
                        F.transform(part, lambda x: F.struct(x["h"], x["h2"])).alias("key"))
    windows = F.transform(F.sequence(F.lit(0), F.size("seq") - run), lambda i: window(F.slice("seq", i + 1, run)))
    if alone is not None:
        starts = F.slice(F.sequence(F.lit(0), F.size("seq")), 1, F.greatest(F.size("seq") - (run - 1), F.lit(0)))
        windows = F.concat(F.transform(starts, lambda i: window(F.slice("seq", i + 1, run))),
                           F.transform(F.filter("seq", lambda x: x["long"]), lambda x: window(F.array(x))))
    found = common.save(seq.select("doc_id", "tie", F.explode(windows).alias("w"))
                        .select("doc_id", "tie", F.col("w.lines").alias("lines"), "w.print", "w.key"), "line-windows")
    # windows whose least hash is seen once have no equal: a filter only
    prints = found.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    met = found.join(prints, "print", "left_semi")
    place = F.struct("doc_id", F.col("lines")[0].alias("at"))
    first = met.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = met.join(first.select("key", "first"), "key").where(place > F.col("first"))
    # as many positions as the document has lines at most
    gone = (later.groupBy("doc_id", "tie").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))
            .select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie"), "gone"))
    out = rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("tie") == F.col("gone_tie")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.col("all_lines")[i]), "\n"))
    return (out.withColumn("all_lines", F.when(F.col("gone").isNotNull(), lines))
            .select("doc_id", "text", F.size(lines).alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"), kept.alias("kept"),
                    *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry or [])]))
