"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are compared without white space (space, U+0009 to U+000D); a null text
is an empty one, and all empty texts are equal.  Rows that repeat a ``doc_id``
are separate rows.  Of equal texts the one with most code points stays, then
the smallest ``doc_id`` (null ids last); of rows equal in all of that, one.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, squeezed, staged

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``doc_id, print, keep_id, group_size, kept`` for every row; ``print`` is the text's hash.

    Three rounds, each on what the one before left: length of the text, hash
    of its first characters, SHA-256 of all of it.  The first two move only
    ids, lengths and hashes; texts are read again only for ids whose length
    and prefix another row shares.  Group sizes and the row that stays are
    aggregated before any shuffle, and the join that hands them back to the
    rows is one Spark can split where a group is large.
    """
    base = id_and_text(docs)
    normal = squeezed(F.col("text"))
    keys = staged(
        base.select("doc_id", F.xxhash64("text").alias("print"), F.length(normal).alias("size"), F.xxhash64(F.substring(normal, 1, prefix_chars)).alias("prefix")),
        "exact-keys",
    )
    # both rounds count rows by aggregates, so that a length or prefix of many rows is one row early on
    prefixes = keys.groupBy("size", "prefix").agg(F.count("*").alias("rows"))
    lengths = prefixes.groupBy("size").agg(F.sum("rows").alias("of_size")).filter("of_size > 1")
    shared = prefixes.join(lengths, "size", "left_semi").filter("rows > 1").select("size", "prefix")
    same_prefix = keys.join(shared, ["size", "prefix"], "left_semi")
    ids = same_prefix.groupBy(F.col("doc_id").alias("open_id")).agg(F.lit(True).alias("open"))

    matches = base["doc_id"].eqNullSafe(ids["open_id"])
    full = staged(
        base.join(ids, matches, "left_semi").select(
            "doc_id", F.xxhash64("text").alias("print"), F.length("text").alias("chars"), F.sha2(squeezed(F.col("text")), 256).alias("digest")
        ),
        "exact-full",
    )
    # all bits turned, ids sort backwards; a null stays null, and nulls are the smallest of a struct's fields
    rank = F.struct("chars", F.bitwise_not("doc_id").alias("back"))
    groups = full.groupBy("digest").agg(F.count("*").alias("group_size"), F.max_by("doc_id", rank).alias("keep_id"), F.max("chars").alias("most"))
    twins = Window.partitionBy("digest", "doc_id").orderBy(F.desc("chars"))
    grouped = (
        full.withColumn("nth", F.row_number().over(twins))
        .join(groups, "digest")
        .select("doc_id", "print", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"))
    )
    alone = keys.join(ids, keys["doc_id"].eqNullSafe(ids["open_id"]), "left_anti").select(
        "doc_id", "print", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    return grouped.unionByName(alone)


def text_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, print, text_sha256`` of the text without white space."""
    return id_and_text(docs).select("doc_id", F.xxhash64("text").alias("print"), F.sha2(squeezed(F.col("text")), 256).alias("text_sha256"))


def dedup_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, rows that repeat an id or lack one included."""
    digests = text_digests(docs).groupBy(F.col("doc_id").alias("at_id"), F.col("print").alias("at_print")).agg(F.any_value("text_sha256").alias("text_sha256"))
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("print") == F.col("at_print"))
    return exact_dedup(docs).join(digests, same).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; ids must be unique here."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")
