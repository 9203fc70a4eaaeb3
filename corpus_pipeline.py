"""A corpus pipeline: documents in, a mixed, deduplicated, tokenized corpus out.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; ``n_chars`` follows the text. Further columns stay with their rows up to
the last stage, whatever they are called; nulls, empty texts and empty tables are as the operators say.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import bpe, common, lines, mixing, shingles, toxicity
from seriesforge.llm.queries import LONG_LINE, WEIGHTS

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _extras_aside(stage):
    """Columns besides ``COLUMNS`` go through a stage under plain names, so that none clashes with the stage's own."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)
    return run_stage


@_extras_aside
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic (score >= 0.7) go; the model learns from the labelled ones."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


@_extras_aside
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted (two lines or more, or one of ``LONG_LINE`` words or more); a document of which
    nothing is left goes."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = lines.line_dedup(docs, carry=other, alone=LONG_LINE)
    left = (F.col("n_deleted") == 0) | (F.btrim("kept", F.lit(" \t\r\n")) != "")
    return (out.where(left).withColumn("n_chars", F.length("kept").cast("long"))
            .drop("text").withColumnRenamed("kept", "text").select(docs.columns))


@_extras_aside
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five words, Jaccard 0.8, chained) the smallest id stays, once;
    documents that link with nothing stay as they are. Rows that share an id count as one document, those with
    a null id each as one of their own."""
    verdict = shingles.shingle_join(docs)
    gone = verdict.where("doc_id is not null and n_links > 0").select("doc_id", "kept")
    single = docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")     # null ids stay
    first = docs.join(gone.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.select(docs.columns).unionByName(first.select(docs.columns))


@_extras_aside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, in files by position, which ``tokenize`` keeps; every source that is left has
    a weight of its own."""
    out = mixing.mix(docs, mixing.source_weights(docs, WEIGHTS), complete=True, carry=[c for c in docs.columns if c != "doc_id"])
    return (out.repartitionByRange("position").sortWithinPartitions("position", "doc_id").select(docs.columns))


def in_written_order(docs: DataFrame, parts: int) -> DataFrame:
    """``COLUMNS`` of a table read from Parquet files, with ``position``, the row's place in the order the files were written in
    (files by number, rows as they stand, from 0), and ``part``, which of ``parts`` equal stretches it is in.

    A scan deals files out by size, so their order is taken from the files. The prefix sums are over one row per file.
    """
    place = docs.metadataColumn("_metadata")
    rows = docs.select(*COLUMNS, place["file_name"].alias("file"), place["row_index"].alias("row"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("number", number)
    before = counts.selectExpr("file", "sum(n) over (order by number, file rows between unbounded preceding and current row) - n as before",
                               "sum(n) over () as total")
    position = F.col("before") + F.col("row")
    return (rows.join(F.broadcast(before), "file").withColumn("position", position)
            .withColumn("part", F.floor(F.col("position") / F.col("total") * parts).cast("int"))
            .select(*COLUMNS, "position", "part"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its very text, in the order of the mixture (``position`` from 0,
    files by position): ``doc_id, lang, source, n_chars, n_tokens, ids, exact, position``."""
    parts = max(1, docs.rdd.getNumPartitions())
    ids = bpe.encode(in_written_order(docs, parts), VOCABULARY, public_tokenizers.PATTERN,
                     carry=["lang", "source", "n_chars", "position", "part"])
    return (ids.repartitionById(parts, "part").sortWithinPartitions("position")
            .select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact", "position"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard", drop_near_copies),
          ("pfair_mix", mix_sources), ("bpe", tokenize)]

#: Compression and tokenizer merges have no SQL form; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
