"""How five filters act on each other, in every order they could be applied in.

A filter fails a document: A under 50 words, B few distinct words, C many
capital letters, D symbols, E a copy of a text with a smaller id.  What an
order of filters removes at a step follows from how many documents fail which
sets of filters, so documents are read for these sets (five bits) and counted;
orders are then evaluated on the counts alone.

Copies are found by refining a partition: code-point length, then hashes of
successive blocks that together cover the text.  After each step, groups in
which no second id is left are dropped.  Texts of the groups that remain are
compared themselves, by the smallest and greatest text of each group, which
combine before any shuffle however large a group is; groups that hold
different texts are split by the texts.

A null text is empty, so empty texts and null ones are copies of each other.
A row without an id is never a copy, and no row is a copy of it.  Rows that
repeat an id are rows of their own, and not copies of each other.  A document
is good (toxic) where any of its labels says so.  An empty table has no parts
and gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, staged

FILTERS = "ABCDE"
#: Code points at which blocks of the refinement start; the last one reaches to the end of the text.
BLOCKS = (0, 64, 1024)
#: What :func:`fails` looks for.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"


def fails(text: Column) -> dict[str, Column]:
    """Conditions of the filters that a text decides alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * n,
        "C": 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def _blocks(text: Column) -> list[Column]:
    """Length, then a hash of each block."""
    ends = [*BLOCKS[1:], None]
    return [F.length(text).alias("key0")] + [
        F.xxhash64(F.substring(text, a + 1, (b - a) if b else 2**31 - 1), F.lit(i)).alias(f"key{i + 1}") for i, (a, b) in enumerate(zip(BLOCKS, ends))
    ]


def refined(keys: DataFrame) -> DataFrame:
    """Of rows ``doc_id, key0, key1, ...`` those that share all keys with another id, step by step."""
    names = [c for c in keys.columns if c.startswith("key")]
    left = keys.filter("doc_id IS NOT NULL")
    for i in range(1, len(names) + 1):
        shared = left.groupBy(*names[:i]).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select(*names[:i])
        left = left.join(shared, names[:i], "left_semi").select(*keys.columns)
    return left


def copies(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """``doc_id, key...`` of rows of ``docs`` whose text a smaller id has.

    ``facts`` has ``doc_id`` and the keys of :func:`_blocks` of each row.
    """
    names = [c for c in facts.columns if c.startswith("key")]
    left = staged(refined(facts.select("doc_id", *names)), "audit-left")
    text = F.coalesce(docs["text"], F.lit(""))
    # texts of other groups than those of ``left`` may be compared as well; no row looks them up
    texts = maybe_in(docs.select("doc_id", text.alias("text"), *_blocks(text)).filter("doc_id IS NOT NULL"), left, names)
    compared = staged(
        texts.groupBy(*names).agg(F.min("doc_id").alias("low"), (F.min("text") == F.max("text")).alias("alike")), "audit-compared"
    )
    found = left.join(compared.filter("alike"), names).filter("doc_id > low").select("doc_id", *names)
    mixed = compared.filter("NOT alike").select(*names)
    if mixed.isEmpty():
        return found
    apart = texts.join(mixed, names, "left_semi")
    lows = apart.groupBy(*names, "text").agg(F.min("doc_id").alias("low"))
    return found.unionByName(apart.join(lows, [*names, "text"]).filter("doc_id > low").select("doc_id", *names))


def failed_filters(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` for every row; bit i of ``mask`` is set where filter i fails the document."""
    text = F.coalesce(docs["text"], F.lit(""))
    own = sum((F.when(c, F.lit(1 << FILTERS.index(f))).otherwise(0) for f, c in fails(text).items()), F.lit(0))
    facts = staged(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), own.alias("own"), *_blocks(text)), "audit-facts")
    names = [c for c in facts.columns if c.startswith("key")]
    found = staged(copies(docs, facts), "audit-copies").distinct().withColumn("copy", F.lit(1 << FILTERS.index("E")))
    # ids and keys together name a row's text: a repeated id may hold several
    marked = facts.join(found, ["doc_id", *names], "left")
    return marked.select("doc_id", "part", (F.col("own") + F.coalesce("copy", F.lit(0))).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, docs, good, toxic``: documents that fail exactly the filters of ``mask``."""
    named = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    rows = masks.join(named, masks["doc_id"] == named["labelled"], "left")
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("docs"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step.

    From ``counts``, each part gets one row of arrays: what survives each of
    the 32 sets of filters, what fails each filter, what fails it alone.  Orders
    and steps are a list that each part's row is opened by.
    """
    sets = range(1 << len(FILTERS))

    def surviving(name: str) -> Column:
        return F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(name)).otherwise(0)) for s in sets)).alias(f"left_{name}")

    bits = [1 << i for i in range(len(FILTERS))]
    alone = F.array(*(F.sum(F.when(F.col("mask") == b, F.col("docs")).otherwise(0)) for b in bits)).alias("alone")
    parts = counts.groupBy("part").agg(surviving("docs"), surviving("good"), surviving("toxic"), alone)

    orders = list(itertools.permutations(range(len(FILTERS))))
    befores = {f: [sum(bits[g] for g in order[: order.index(f)]) for order in orders] for f in range(len(FILTERS))}

    def lost(name: str, before: int | Column, bit: int | Column) -> Column:
        """Removed by a filter after those of ``before``."""
        kept = F.col(f"left_{name}")
        at = (lambda s: kept[s]) if isinstance(before, int) else (lambda s: F.element_at(kept, s + 1))
        return at(before) - at(before + bit)

    def shapley(f: int) -> Column:
        times = {s: befores[f].count(s) for s in sorted(set(befores[f]))}
        return sum((F.lit(n) * lost("docs", s, bits[f]) for s, n in times.items()), F.lit(0))

    parts = parts.withColumn("shapleys", F.array(*(shapley(f) for f in range(len(FILTERS)))))
    steps = [
        ("".join(FILTERS[f] for f in order), k + 1, order[k], sum(bits[f] for f in order[:k])) for order in orders for k in range(len(FILTERS))
    ]
    literal = ", ".join(f"('{o}', {k}, {f}, {s})" for o, k, f, s in steps)
    listed = F.expr(f"inline(transform(array({literal}), x -> named_struct('filter_order', x.col1, 'step', x.col2, 'f', x.col3, 'before', x.col4)))")
    rows = parts.select("*", listed).withColumn("bit", F.element_at(F.array(*map(F.lit, bits)), F.col("f") + 1))
    failing = F.col("left_docs")[0] - F.element_at("left_docs", F.col("bit") + 1)
    removed = lost("docs", F.col("before"), F.col("bit"))
    return rows.select(
        "part", "filter_order", "step",
        F.element_at("left_docs", F.col("before") + F.col("bit") + 1).alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        F.element_at("alone", F.col("f") + 1).alias("unique_fails"),
        lost("good", F.col("before"), F.col("bit")).alias("good_lost"),
        lost("toxic", F.col("before"), F.col("bit")).alias("toxic_lost"),
        F.element_at("shapleys", F.col("f") + 1).alias("shapley"),
    )
