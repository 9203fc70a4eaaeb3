"""The registered queries of this subpackage: each operator over its whole table.

Every query takes ``(spark, sf_dir)``. Digest columns are derived here from the real outputs of the
operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, digest, licenses, lines, mixing, pieces, pii, pivots, repair, shingles, suffixes, toxicity, whitening
from .oracle import LONG_LINE, ORACLE, WEIGHTS  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.embedding_dups(table(spark, sf_dir, "embeddings"))


def op2_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digest.edit_probe(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                      "edited_fingerprint", "near_edited", "near_next")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.repeated_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(table(spark, sf_dir, "documents")))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.shingle_join(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted",
                                              "windows_hit", "worst")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"), alone=LONG_LINE)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_deleted").cast("long").alias("n_deleted"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_weights(docs, WEIGHTS), complete=True)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op11_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.damage(table(spark, sf_dir, "conversations")))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_pivot_dups, op2_improbable_digest, op3_license_scan, op4_suffix_dedup, op5_pii, op6_shingle_join, op7_toxicity,
    op8_line_dedup, op9_pfair_mix, op10_bpe, op11_repair_turns, op12_piece_codec, op13_whiten)}
