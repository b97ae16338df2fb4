"""The pipeline against its stages done plainly."""

import collections
import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, quality

from .test_operators import brute_join, brute_rules


def test_stages_keep_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == columns, name
        before, now = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}
        assert now.keys() <= before.keys() and all(r.n_chars == len(r.text) for r in now.values()), name
        if name == "quality rules":
            model = quality.train_line_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            verdict = {r.doc_id for r in quality.quality_rules(docs, model).filter("kept").collect()}
            assert now.keys() == verdict and not any(brute_rules(before[d].text)[-1] for d in now)
        if name == "n-gram Jaccard join":
            rows = [(d, r.text) for d, r in before.items()]
            assert now.keys() == {d for d, c, _ in brute_join(rows) if d == c}
        if name == "secret scans":
            assert now.keys() == before.keys()
            assert not any(re.search("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r.text) for r in now.values())
        docs = after


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    tokens = collections.Counter()
    for r in rows:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in rows)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_null_texts_pass_the_stages(spark):
    df = spark.createDataFrame([(1, None, None, "s", None), (None, "a b", "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, df, sf).collect()
    assert bpe.library_encoder(public_tokenizers.path("byte_bpe_50k.json")).encode([None]) == [b""]
    assert corpus_pipeline.STAGES[3][1](spark, df, sf).filter(F.col("text").isNull()).count() == 1
