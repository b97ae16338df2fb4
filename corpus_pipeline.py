"""From raw documents to packed training sequences, five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``; where a stage changes texts, ``n_chars`` follows.

Rows that repeat a doc_id, or have none, are documents of their own in every
stage: each is judged, cut, redacted and packed by its own text.  Of copies of a
text with different ids the smallest id's rows stay; rows alike in id and text all
stay, as do texts without an id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import line_dedup, ngram_join, packing, quality, secrets
from factloom.llm.common import SPACES, documents, shared_folder


def _with_text(df: DataFrame, text) -> DataFrame:
    """The struct ``row`` opened, with another text where it had one."""
    columns = df.select("row.*").columns
    out = df.select("row", F.when(F.col("row.text").isNotNull(), text).alias("now"))
    new = {"text": F.col("now")} | ({"n_chars": F.length("now").cast("long")} if "n_chars" in columns else {})
    return out.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  The verdict depends on the text alone, so texts decide; nothing else is joined."""
    model = quality.train_line_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; documents left without a word go too."""
    done = _with_text(line_dedup.line_dedup(docs), F.col("kept_text"))
    return done.filter(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) != "")


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return ngram_join.one_of_each_class(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    found = secrets.secret_spans(docs)
    return _with_text(found, secrets.redacted(F.coalesce("row.text", F.lit("")), F.col("spans")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", join_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: The CRF, the MinHash forest and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
