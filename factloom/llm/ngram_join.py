"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

A document is its set of 5-word shingles (of fewer words: the one shingle of all
its words; without words: no shingles and no links).  Two documents are linked
if the Jaccard similarity of their sets is ``threshold`` (0.8) or more.

1. Classes.  Documents with equal sets are one class, represented by its
   smallest doc_id; they are linked to each other and to the same others, so
   only representatives go on and copies are never expanded.
2. Forest.  Each of TREES trees has a label for each representative: DEPTH
   MinHash values of a byte each, which makes a whole number.  All labels are
   sorted once; the bytes that neighbours share are the trie of a tree, and a
   node of depth d is a run in which neighbours share d bytes or more.  A
   representative is joined to the head of the deepest run that it goes on, so
   a node of n texts has n - 1 joins, however large it is.
3. Verification.  The joins at a depth connect candidate groups.  A group is
   compared in cells of two blocks of about BLOCK representatives or
   BLOCK_SHINGLES shingles, whichever is less; texts of one node lie in the same
   blocks, and of a group of several blocks only those are compared that meet in
   a node.  A cell returns, for each representative, how many documents it is
   linked to and the smallest representative it is connected to in the cell.
4. Shortening.  The matched prefix starts as long as a pair at the threshold
   allows to meet with probability START.  Each verified link of similarity s,
   which met with a known probability p(s), stands for 1 / p(s) links, and that
   gives the recall.  Where it is under ``recall``, prefixes are shortened to the
   longest that these links say is enough, and the groups that grow by it are
   verified anew; this ends at the target, or at the depth at which a lone pair at
   the threshold is modelled to meet often enough for it (4 at the defaults).  A
   higher ``recall`` allows shorter prefixes, 1.0 those of one value.
5. Classes of the result are the connected components of verified links.

A group's exact link counts need all of its pairs that may be linked, so the work
of one dense group grows with the square of its different texts, in cells of
bounded size.  Shingles are compared as 64-bit hashes.  Rows that repeat an id
and text count as copies of each other; rows that repeat an id with another text
as one document of each text.  Null ids come last and have no links; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, WordHashes, _arrow_schema, id_and_text, map_batches, maybe_in, mix, rolling, split_words, staged

THRESHOLD = 0.8
TREES = 24
DEPTH = 8
START = 0.999
RECALL = 0.9999
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
_SKETCH = "doc_id long, print long, low long, high long, n_shingles long, labels array<long>"
_JOINS = "a long, b long, shared int, part int, tree int, label long"
#: ``shared`` of the first and the last row of a sorted part, which may go on in the parts beside it.
_FIRST, _LAST = -2, -1


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The distinct shingles, ascending."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    values = hashes.of(words)
    return np.unique(rolling(values, SHINGLE_WORDS)) if len(words) >= SHINGLE_WORDS else rolling(values, len(words), seed=len(words))


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which ``trees`` tries find a pair at the threshold with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@functools.lru_cache(maxsize=4)
def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:count] | np.uint64(1), base[count:]


def signature(values: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values of a set that isn't empty."""
    a, b = _factors(count)
    low = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(values), 512):
        part = values[None, lo : lo + 512] * a[:, None]
        part += b[:, None]
        np.minimum(low, (part ^ (part >> np.uint64(29))).min(axis=1), out=low)
    return low


def forest_labels(values: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One label for each tree: the first ``depth`` of its bytes are MinHash values, the highest byte first."""
    rows = (mix(signature(values, trees * depth)) & np.uint64(0xFF)).reshape(trees, depth)
    return (rows << np.arange(56, 56 - 8 * depth, -8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def meeting(similarity: np.ndarray | float, trees: int, depth: int) -> np.ndarray | float:
    """The probability that two texts share ``depth`` values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def sketches(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    def one(x: dict[str, list], hashes: WordHashes) -> dict[str, object]:
        low, high, sizes, labels = [], [], [], []
        for text in x["text"]:
            found = shingles(split_words(text), hashes)
            whole = xxhash.xxh3_128_intdigest(found.tobytes())
            low.append((whole & (1 << 64) - 1) - (1 << 63))
            high.append((whole >> 64) - (1 << 63))
            sizes.append(len(found))
            labels.append(forest_labels(found, trees, depth) if len(found) else None)
        return {"doc_id": x["doc_id"], "print": x["print"], "low": low, "high": high, "n_shingles": sizes, "labels": labels}

    return map_batches(id_and_text(docs).withColumn("print", F.xxhash64("text")), one, _SKETCH, state=WordHashes)


_EDGE = "a long, b long"
#: A task connects about so many edges, but few edges are still dealt to LEAST_PARTS tasks.
PART_EDGES, LEAST_PARTS = 100_000, 4


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """Edges of each part of ``edges``, replaced by one from each node to the smallest node that the part connects it to.

    Parts are put together by the ``count`` of edges there are about, as a part
    connects the more the larger it is, and as tasks for a few edges each take
    longer to start than to run.
    """
    arrow = _arrow_schema(_EDGE)
    parts = max(LEAST_PARTS, -(-count // PART_EDGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        stars = [(x, r) for x in list(root) if (r := find(x)) != x]
        for lo in range(0, len(stars), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stars[lo : lo + 10_000]), arrow)], schema=arrow)

    return edges.coalesce(parts).mapInArrow(run, _EDGE)


def components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node of each connected component.  ``edges``: ``a, b``; nodes without edges are absent.

    Each task connects what its part of the edges connects.  Then a round gives a
    node's neighbours and itself its smallest neighbour, on the larger side and
    on the smaller side, until all edges lead from a node to the root of its
    component; what a round gives is connected where it was joined and written
    to the shared folder, so lineage stays short and edges never grow in number.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def open_(e: DataFrame) -> bool:
        """Whether a node has edges to two others, or is both below and above another."""
        ends = e.select("a", F.col("b").alias("up")).union(e.select("b", F.lit(None).cast("long")))
        seen = ends.groupBy("a").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.bool_or(F.col("up").isNull()).alias("down"))
        return not seen.filter("low < high OR (low IS NOT NULL AND down)").isEmpty()

    edges = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    # what is read is staged, so counting it takes no other work
    edges = staged(_contracted(edges, edges.count()), label)
    for _ in range(most_rounds):
        if not open_(edges):
            break
        around = both(edges)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = around.join(low, "a").filter("b > a AND b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        edges = staged(_contracted(small.filter("a <> b"), edges.count()), label)
    else:
        raise RuntimeError(f"{label}: components still change after {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def compare_cell(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    """Links between ``rows`` and ``columns`` (places in ``sets``) as a boolean matrix; never of a set with itself."""
    return similarities(sets, rows, columns, threshold) > 0


def similarities(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    """Similarities of ``rows`` and ``columns`` where they are linked, else 0.

    Shared shingles are counted by matrix products over shingles that many sets
    have, and one by one over the rest.
    """
    own = np.concatenate([np.arange(len(rows)), np.arange(len(columns))])
    side = np.concatenate([np.zeros(len(rows), bool), np.ones(len(columns), bool)])
    places = np.concatenate([rows, columns])
    sizes = np.array([len(sets[i]) for i in places])
    owner = np.repeat(np.arange(len(places)), sizes)
    values = np.concatenate([sets[i] for i in places])
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = times[code] > 1
    order = np.argsort(code[keep], kind="stable")
    owner, code = owner[keep][order], code[keep][order]
    shared = np.zeros((len(rows), len(columns)), dtype=np.float32)
    if len(code):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [len(code)]))
        runs = np.diff(edges)
        common = np.repeat(runs > 24, runs)
        rank = np.repeat(np.cumsum(runs > 24) - 1, runs)
        many = int((runs > 24).sum())
        for lo in range(0, many, 2048):
            pick = common & (rank >= lo) & (rank < lo + 2048)
            width = min(2048, many - lo)
            left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(columns), width), np.float32)
            l, r = pick & ~side[owner], pick & side[owner]
            left[own[owner[l]], rank[l] - lo] = 1
            right[own[owner[r]], rank[r] - lo] = 1
            shared += left @ right.T
        for length in np.unique(runs[runs <= 24]):
            first = edges[:-1][runs == length]
            group = owner[first[:, None] + np.arange(length)]
            for i in range(length):
                for j in range(length):
                    a, b = group[:, i], group[:, j]
                    ok = ~side[a] & side[b]
                    np.add.at(shared, (own[a[ok]], own[b[ok]]), 1)
    total = sizes[: len(rows), None] + sizes[None, len(rows) :] - shared
    # shared / total >= threshold on whole numbers, safe against rounding
    links = (shared >= threshold * total - 1e-6) & (total > 0)
    links &= rows[:, None] != columns[None, :]
    return np.where(links, shared / np.maximum(total, 1), 0)


def _spread(links: np.ndarray, labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each connected part of a bipartite link matrix between places ``a`` and ``b``."""
    while True:
        before = labels.copy()
        top = np.iinfo(labels.dtype).max
        for x, y, m in ((a, b, links), (b, a, links.T)):
            near = np.where(m, labels[y][None, :], top).min(axis=1, initial=top)
            labels[x] = np.minimum(labels[x], near)
        if (labels == before).all():
            return labels


_FOUND = "cls long, rep long, links long, root long, root_cls long, odds array<double>"


def _verify(threshold: float, trees: int, depths: int, depth: int):
    def cell(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "rep", "cls"], ignore_index=True)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
        reps, weights, block = group["rep"].to_numpy(np.int64), group["copies"].to_numpy(np.int64), group["block"].to_numpy()
        one, two = int(group["one"].iloc[0]), int(group["two"].iloc[0])
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
        likeness = similarities(sets, a, b, threshold) if len(a) and len(b) else np.zeros((len(a), len(b)))
        links = likeness > 0
        count = np.zeros(len(reps), dtype=np.int64)
        count[a] += links @ weights[b]
        if one != two:
            count[b] += links.T @ weights[a]
        cls = group["cls"].to_numpy(np.int64)
        order = np.lexsort((cls, reps))
        label = np.empty(len(reps), dtype=np.int64)
        label[order] = np.arange(len(reps))
        root = order[_spread(links, label, a, b)]
        hit = np.flatnonzero(count > 0)
        out = pd.DataFrame({"cls": cls[hit], "rep": reps[hit], "links": count[hit], "root": reps[root][hit], "root_cls": cls[root][hit], "odds": None})
        if len(hit):
            # how many links these stand for, and how many of those each depth would find
            s = likeness[links].astype(np.float64)
            p = meeting(s, trees, depth) * (2 if one == two else 1)
            out.at[0, "odds"] = [float((1 / p).sum()), *(float((meeting(s, trees, d) / p).sum()) for d in range(1, depths + 1))]
        return out

    return cell


def prefix(label: Column, depth: int) -> Column:
    """The node at ``depth`` of a label's tree."""
    return F.shiftright(label, 8 * (8 - depth))


def forest_joins(classes: DataFrame, floor: int, top: int = DEPTH) -> DataFrame:
    """``a, b, shared``: representatives ``a`` that share a node, each joined to the head ``b`` of the deepest run it goes on.

    Only depths from ``floor`` to ``top`` count, and a representative has at most
    two joins a tree.  Labels are dealt by ranges of (tree, label, representative), so a node of any
    size is many parts; a part's first row is compared with the last one of the
    part before it, two rows a part.
    """
    arrow = _arrow_schema(_JOINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last = TaskContext.get().partitionId(), None, None
        heads: dict[int, int] = {}  # by depth, the representative that the open run began with
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label, rep = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            first = before is None
            before = (tree[0], label[0]) if first else before
            other = label ^ np.concatenate(([before[1]], label[:-1]))
            own = tree == np.concatenate(([before[0]], tree[:-1]))
            shared = sum(((other.view(np.uint64) >> np.uint64(64 - 8 * d)) == 0).astype(np.int32) for d in range(1, 9)) * own
            if first:
                shared[0] = 0
            head = rep.copy()
            shared = np.minimum(shared, np.int32(top))
            for d in range(floor, top + 1):
                at = np.maximum.accumulate(np.where(shared < d, np.arange(len(rep)), -1))
                run_head = np.where(at >= 0, rep[at], heads.get(d, rep[0]))
                head = np.where(shared >= d, run_head, head)
                heads[d] = int(run_head[-1])
            hit = np.flatnonzero((shared >= floor) & (rep != head))
            out = [rep[hit], head[hit], shared[hit], np.full(len(hit), part), tree[hit], label[hit]]
            if first:
                out = [np.append(x, y) for x, y in zip(out, (rep[0], rep[0], _FIRST, part, tree[0], label[0]))]
            before, last = (tree[-1], label[-1]), (rep[-1], rep[-1], _LAST, part, tree[-1], label[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, arrow)], schema=arrow)

    labels = classes.select("rep", F.posexplode("labels").alias("tree", "label")).select("tree", "label", "rep")
    ordered = labels.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    found = staged(ordered.mapInArrow(run, _JOINS), "join-forest")
    beside = Window.orderBy("part", "shared")  # over the edges of parts alone: two rows a part
    seams = found.filter("shared < 0").select(
        F.col("a"), "shared", F.lag("a").over(beside).alias("b"), (F.lag("tree").over(beside) == F.col("tree")).alias("same"),
        F.col("label").bitwiseXOR(F.lag("label").over(beside)).alias("other"),
    ).filter((F.col("shared") == _FIRST) & F.col("same"))
    depth = functools.reduce(lambda n, d: n + F.when(F.shiftrightunsigned("other", 64 - 8 * d) == 0, 1).otherwise(0), range(1, top + 1), F.lit(0))
    return found.filter("shared > 0").select("a", "b", "shared").union(seams.select("a", "b", depth.alias("shared")).filter(f"shared >= {floor} AND a <> b"))


def _edges(joins: DataFrame, depth: int) -> DataFrame:
    """``a, b`` that connect what ``joins`` of ``depth`` and more connect: each representative with the smallest
    of its heads, and that one with its others, at most two a tree; near copies share their heads."""
    heads = joins.filter(F.col("shared") >= depth).groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("heads"))
    heads = staged(heads, "join-heads")
    others = heads.select(F.explode("heads").alias("a"), "b").filter("a <> b").distinct()
    return heads.select("a", "b").union(others)


def _blocks(members: DataFrame, depth: int, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """``members`` of groups, staged; and with their ``block`` and the ``cells`` (pairs of blocks) it is in."""
    need = lambda part: F.ceil(part * F.greatest(F.count("*") / block, F.sum("n_shingles") / block_shingles))
    members = staged(members.join(members.groupBy("part").agg(need(1).alias("blocks")), "part"), "join-members")
    zero = F.lit(0).cast("long")
    one = members.filter("blocks = 1").withColumns({"block": zero, "cells": F.array(F.struct(zero.alias("one"), zero.alias("two")))})
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return members, one
    # nodes of the first tree stay together, in blocks of their own where they are large
    large = large.withColumn("home", prefix(F.col("labels")[0], depth))
    homes = large.groupBy("part", "home").agg(need(4).alias("pieces"))
    placed = large.join(homes, ["part", "home"]).withColumn(
        "block", F.pmod(F.xxhash64("home"), F.col("blocks")) * (1 << 24) + F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("pieces"))
    )
    placed = staged(placed.drop("home", "pieces"), "join-blocks")
    nodes = placed.select("part", "block", F.posexplode("labels").alias("tree", "label")).select("part", "tree", prefix(F.col("label"), depth).alias("node"), "block").distinct()
    held = nodes.groupBy("part", "tree", "node").agg(F.collect_set("block").alias("held"))
    met = held.select("part", "held", F.explode("held").alias("one")).select("part", "one", F.explode(F.filter("held", lambda x: x >= F.col("one"))).alias("two")).distinct()
    cells = met.union(met.filter("one < two").select("part", F.col("two").alias("one"), F.col("one").alias("two")))
    cells = cells.groupBy("part", F.col("one").alias("block")).agg(F.collect_list(F.struct(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"))).alias("cells"))
    return members, one.unionByName(placed.join(cells, ["part", "block"]))


def _compared(docs: DataFrame, members: DataFrame, blocked: DataFrame, verify) -> DataFrame:
    keys = ("cls", "rep", "copies", "part", "block", "cells")
    # most texts are in no group; they are passed over before the join, which may shuffle texts
    texts = maybe_in(id_and_text(docs).withColumn("print", F.xxhash64("text")), members.select(F.col("rep_print").alias("print")), ["print"])
    with_text = texts.join(blocked.select(*keys, "rep_print"), (F.col("doc_id") == F.col("rep")) & (F.col("print") == F.col("rep_print")))

    def sets(x: dict[str, list], hashes: WordHashes) -> dict[str, object]:
        return {k: x[k] for k in keys} | {"shingles": [shingles(split_words(t), hashes).tobytes() for t in x["text"]]}

    schema = "cls long, rep long, copies long, part long, block long, cells array<struct<one:long,two:long>>, shingles binary"
    shingled = map_batches(with_text.select(*keys, "text"), sets, schema, state=WordHashes)
    cells = shingled.dropDuplicates(["cls"]).withColumn("cell", F.explode("cells")).select("*", "cell.one", "cell.two").drop("cell", "cells")
    return staged(cells.groupBy("part", "one", "two").applyInPandas(verify, _FOUND), "join-verified")


def _verified(
    docs: DataFrame, threshold: float, trees: int, depth: int, start: float, recall: float, block: int, block_shingles: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, classes of equal shingles, and verified links of classes to the smallest one of their cell."""
    sketch = staged(sketches(docs, trees, depth), "join-sketch")
    classes = staged(
        sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("low", "high")
        .agg(F.min(F.struct("doc_id", "print")).alias("first"), F.count("*").alias("copies"), F.any_value("labels").alias("labels"), F.max("n_shingles").alias("n_shingles"))
        .select("low", "high", F.xxhash64("low", "high").alias("cls"), F.col("first.doc_id").alias("rep"), F.col("first.print").alias("rep_print"), "copies", "labels", "n_shingles"),
        "join-classes",
    )
    at = matched_depth(threshold, trees, depth, start)
    joins = staged(forest_joins(classes, matched_depth(threshold, trees, at, 1 - (1 - recall) / 10), at), "join-pairs")
    groups = verified = None
    while True:
        before, groups = groups, staged(components(_edges(joins, at), "join-candidates").withColumnRenamed("root", "part"), "join-groups")
        if before is not None:
            # groups that are just what they were keep their links
            parts = groups.join(before.withColumnRenamed("part", "was"), "node", "left").groupBy("part").agg(F.count_distinct(F.coalesce("was", "node")).alias("n"))
            grown = parts.filter("n > 1").select("part")
            again = groups.join(grown, "part", "left_semi")
            verified = verified.join(again, F.col("rep") == F.col("node"), "left_anti")
        else:
            again = groups
        members = again.join(classes.select("cls", "rep", "rep_print", "copies", "n_shingles", "labels"), F.col("node") == F.col("rep"))
        found = _compared(docs, *_blocks(members, at, block, block_shingles), _verify(threshold, trees, depth, at))
        verified = staged(verified.unionByName(found), "join-verified") if before is not None else found
        odds = verified.select(*(F.sum(F.col("odds")[d]).alias(f"d{d}") for d in range(depth + 1))).first()
        enough = [d for d in range(1, at + 1) if not odds[0] or odds[d] >= recall * odds[0]]
        if at in enough or at == 1 or at <= matched_depth(threshold, trees, at, 1 - (1 - recall) / 10):
            return sketch, classes, verified
        at = max([*enough, 1])


def ngram_join(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES, start: float = START,
) -> DataFrame:
    """``doc_id, print, class_id, n_links, n_copies`` for every row; ``print`` is the text's hash.

    ``class_id`` is the smallest doc_id that chains of links lead to, ``n_links``
    how many other documents are linked directly, ``n_copies`` how many others
    have the same shingles.
    """
    sketch, classes, verified = _verified(docs, threshold, trees, depth, start, recall, block, block_shingles)
    linked = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")), "join-links")

    result = (
        classes.select("low", "high", "cls", "rep", "copies")
        .join(linked, "cls", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("low", "high", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    out = sketch.select("doc_id", "print", "low", "high", "n_shingles").join(result, ["low", "high"], "left")
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & F.col("class_id").isNotNull()
    return out.select(
        "doc_id",
        "print",
        F.when(real, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(real, F.col("links") + F.col("n_copies")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(real, F.col("n_copies")).otherwise(F.lit(0)).cast("long").alias("n_copies"),
    )


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One text of each class of linked texts, that of the smallest doc_id: its rows, all columns.

    Texts are told apart, not ids: of an id with several texts each stays or goes
    by its own links, so only texts that are linked to one that stays are lost.
    Rows alike in id and text all stay, and so do rows without an id or without
    words.
    """
    _, classes, verified = _verified(docs, THRESHOLD, TREES, DEPTH, START, RECALL, BLOCK, BLOCK_SHINGLES)
    roots = components(verified.select(F.col("cls").alias("a"), F.col("root_cls").alias("b")), "join-kept")
    parts = classes.join(roots, F.col("cls") == F.col("node"), "left").withColumn("part", F.coalesce("root", "cls"))
    first = parts.groupBy("part").agg(F.min(F.struct("rep", "rep_print")).alias("first"))
    found = first.select(F.col("first.rep").alias("at_id"), F.col("first.rep_print").alias("at_print"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    has_links = F.col("row.doc_id").isNotNull() & F.coalesce("row.text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    print_ = F.xxhash64(F.coalesce("row.text", F.lit("")))
    kept = rows.filter(has_links).join(found, (F.col("row.doc_id") == F.col("at_id")) & (print_ == F.col("at_print")))
    return kept.select("row.*").union(rows.filter(~has_links).select("row.*"))
