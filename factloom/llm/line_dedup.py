"""Line deduplication over three-line windows, with DataFrame functions only.

A text's lines are what ``\\n`` separates, compared as they are.  Windows of
three consecutive lines that all hold nothing but white space (space, U+0009 to
U+000D) are passed over.
A window that occurred before, in the order of (doc_id, text hash, position),
is a later occurrence; all lines that later occurrences cover go.  Texts of
fewer than three lines stay whole, a null text counts as empty, and null ids
come first.  Rows alike in id and text are one document, returned as often as
they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_and_text

WINDOW_LINES = 3


def covered_lines(docs: DataFrame, window_lines: int = WINDOW_LINES) -> DataFrame:
    """``at_id, at_print, gone``: positions of the lines that later occurrences cover.

    ``at_print`` is the text's hash.  Each window becomes two 64-bit hashes;
    texts do not travel with them.  The first occurrence of a window is a
    minimum, so it is aggregated before the shuffle, and the join back to the
    occurrences can be split where a window is frequent.
    """
    base = id_and_text(docs).withColumn("print", F.xxhash64("text"))
    lines = base.select("doc_id", "print", F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= window_lines)
    hashed = lines.select(
        "doc_id",
        "print",
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (F.btrim(x, F.lit(SPACES)) != "").alias("word"))).alias("h"),
    )
    span = range(window_lines)
    at = lambda i, k: F.element_at("h", i + k + 1)
    windows = hashed.select(
        "doc_id",
        "print",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("h") - window_lines),
                lambda i: F.struct(
                    i.alias("pos"),
                    F.xxhash64(*(at(i, k)["a"] for k in span)).alias("a"),
                    F.xxhash64(*(at(i, k)["b"] for k in span)).alias("b"),
                    F.greatest(*(at(i, k)["word"] for k in span)).alias("word"),
                ),
            )
        ).alias("w"),
    ).filter("w.word")
    seen = windows.select(F.struct("doc_id", "print", F.col("w.pos").alias("pos")).alias("place"), F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    first = seen.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("last > first").drop("last")
    later = seen.join(first, ["a", "b"]).filter(F.col("place") > F.col("first"))
    lines_at = F.array(*(F.col("place.pos") + k for k in span))
    return later.groupBy(F.col("place.doc_id").alias("at_id"), F.col("place.print").alias("at_print")).agg(
        F.array_distinct(F.flatten(F.collect_set(lines_at))).alias("gone")
    )


def line_dedup(docs: DataFrame, window_lines: int = WINDOW_LINES) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with ``n_lines, n_removed, kept_text``.

    Texts are shuffled once, to meet their covered positions.
    """
    gone = covered_lines(docs, window_lines)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.select("row", F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("print"))
    same = F.col("row.doc_id").eqNullSafe(F.col("at_id")) & (F.col("print") == F.col("at_print"))
    cut = rows.join(gone, same, "left").select("row", "gone", F.split(F.coalesce("row.text", F.lit("")), "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return cut.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit("")))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n"))
        .alias("kept_text"),
    )
