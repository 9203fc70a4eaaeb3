"""The pipeline: each stage's decisions on its own input, and the registered queries."""

from collections import Counter

import base64
import os
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from seriesforge.llm import common, mixing
from seriesforge.llm.queries import LONG_LINE, QUERIES, WEIGHTS

from . import helpers
from .test_dedup import brute_lines, jaccard_links

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, SMALL), "test-" + name)
        seen.append(docs.collect())
        assert name == "bpe" or docs.columns == columns
    raw, clean, lines, near, mixed, ids = seen
    assert len(clean) >= 0.85 * len(raw) and {r["doc_id"] for r in clean} <= {r["doc_id"] for r in raw}
    want = Counter((d, k) for d, n, k in brute_lines([(r["doc_id"], r["text"]) for r in clean], alone=LONG_LINE) if n == 0 or k.strip(" \t\r\n"))
    assert Counter((r["doc_id"], r["text"]) for r in lines) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    rows = sorted((r["doc_id"], r["text"]) for r in lines)
    gone, parent = set(), {}
    for i, j in sorted(jaccard_links(rows)):
        a, b = i, j
        while a in parent:
            a = parent[a]
        while b in parent:
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            gone.add(rows[max(a, b)][0])
    assert {r["doc_id"] for r in near} == {d for d, _ in rows} - gone
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, near))
    order = {r["doc_id"]: r["position"] for r in mixing.mix(
        spark.createDataFrame(near), mixing.source_weights(spark.createDataFrame(near), WEIGHTS), complete=True).collect()}
    assert [r["doc_id"] for r in mixed] == sorted(order, key=order.get)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert all(r["ids"] == enc.encode_ordinary(text[r["doc_id"]]) and r["exact"] for r in ids) and len(ids) == len(mixed)


@pytest.mark.parametrize("n_rows", [None, 0])
def test_stages_with_odd_rows_and_clashing_columns(spark, n_rows):
    extra = ["n_deleted", "n_lines", "position", "slot", "mix_source", "n_links", "ids", "exact", "tie", "a.b", "extra_0"]
    docs = helpers.frame(spark, helpers.corpus()).select("*", *[F.lit(c).alias(c) for c in extra])
    docs = docs if n_rows is None else docs.limit(n_rows)
    for name, stage in corpus_pipeline.STAGES:
        out = common.save(stage(spark, docs, SMALL), "odd-" + name)
        rows, ids = out.collect(), {r["doc_id"] for r in docs.collect()}
        assert {r["doc_id"] for r in rows} <= ids and (len(rows) > 30) == (n_rows is None)
        if name != "bpe":
            assert out.columns == docs.columns
            assert all(r[len(helpers.SCHEMA):] == tuple(extra) for r in rows) and {r["kept"] for r in rows} <= {"clash"}
        docs = out


def test_tokens_keep_the_order_of_the_mixture(spark):
    rng = random.Random(5)
    rows = [(i, helpers.prose(rng, 1 + i % 9 * (i % 4)), "en", f"src{i % 3}", i, "clash") for i in range(300)] + [(7, "again", "en", None, 5, "clash"), (None, None, None, "src0", 0, "clash")]
    near = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _metadata string")
    mixed = corpus_pipeline.mix_sources(spark, near, SMALL)
    path = common.scratch_path(spark, "test-order")
    mixed.repartitionByRange(7, "n_chars").write.parquet(path)      # files of different sizes, each a part of the rows
    files = sorted(f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-"))
    assert len(files) == 7
    want = [r["doc_id"] for f in files for r in spark.read.parquet(f"{path}/{f}").select("doc_id").collect()]
    for options in ({}, {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}):
        old = {k: spark.conf.get(k) for k in options}
        for k, v in options.items():
            spark.conf.set(k, v)
        out = common.save(corpus_pipeline.tokenize(spark, spark.read.parquet(path), SMALL), "test-order-ids")
        for k, v in old.items():
            spark.conf.set(k, v)
        got = out.collect()
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == want
        assert sorted(r["position"] for r in got) == list(range(len(rows)))
        spans = out.groupBy(F.input_file_name().alias("f")).agg(F.min("position").alias("a"), F.max("position").alias("z")).orderBy("f").collect()
        assert all(x["z"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_registered(spark):
    names = __spark_entry__.queries()
    assert {*QUERIES, "pipeline"} <= set(names)
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op2_improbable_digest", "op4_suffix_dedup", "op5_pii", "op7_toxicity", "op8_line_dedup", "op9_pfair_mix"):
        assert QUERIES[name](spark, SMALL).count() == n
