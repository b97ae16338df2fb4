"""Repeated passages: deep nodes of suffix trees over words, partitioned by prefix.

Two windows of 13 words are equal where the suffixes that start in them share a
node of the suffix tree, so windows that several documents have hang together
as runs, which are the maximal repeats.  The tree is never whole anywhere:

1. Prefixes.  A suffix can stand for the windows around it: of the 9 prefixes of
   5 words in a window the one with the smallest hash is its anchor, so equal
   windows have equal anchors at equal places.  One suffix for each anchor
   place goes on, with the up to 9 windows that chose it.  Prefixes are counted,
   in a task's own batches first: two documents of a batch know at once that they
   share a prefix, and one row tells other tasks.  Suffixes whose prefix one
   document alone has meet no other and end here.
2. Groups.  Suffixes are dealt by prefix, with the words of their windows.  The
   prefix is 5 words long where at most GROUP_SUFFIXES suffixes have it.  Where
   more have it, it is lengthened, window by window, to the 13 words that the
   tree is deep; such a group is a single node, and is read in order of doc_id
   with one suffix a node in memory.  So each group fits in memory, and
   a task builds the subtrees of many groups, one memory-full at a time.
3. Subtrees.  The suffixes of a memory-full are sorted by their words; the
   lengths of the prefixes that neighbours share give the internal nodes.  A
   window whose anchor is its k-th word needs a node of depth 13 - k, and the
   k words to the left must be equal too.  All words are compared, no hashes.
   Of the windows in a node, those of all but the smallest doc_id are covered.

Before suffixes are dealt, a task compares those of its own batch: of equal ones
that of the smallest document goes on, once, and the others are covered.  So of
a passage that a third of all documents hold, a batch sends one suffix.

What is found is kept as hashes (64 bits) of covered windows, by which a
document finds all its places of them again.  A null or empty text has no words.
Rows that share a doc_id don't cover each other, but each is cut by what any
smaller doc_id has.  Rows with a null id are returned as they are, an empty
table gives an empty result, and columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ranges, WordHashes, _arrow_schema, id_and_text, split_words, staged

WINDOW_WORDS = 13
PREFIX_WORDS = 5
#: Most anchors in a window, and most windows that choose one place.
PLACES = WINDOW_WORDS - PREFIX_WORDS + 1
#: Most suffixes of a prefix that is not lengthened.
GROUP_SUFFIXES = 50_000
#: Suffixes, and bytes of them, that a task compares before it deals them.
BATCH_SUFFIXES, BATCH_BYTES = 200_000, 32_000_000
#: ``spot`` under 0: so many suffixes of other documents besides, which know that they share their prefix with this one.
_SPOTS = "key long, doc_id long, spot long, known boolean"
#: ``spot`` 0: a prefix that is to be lengthened.
_SHARED = "key long, doc_id long, spot long"
_SUFFIX = "key long, doc_id long, lead int, words binary, gone binary"
_GONE = "doc_id long, gone binary"
_DONE = "doc_id long, n_words long, n_removed long, kept_text string"
_RUNS = "doc_id long, start long, length long"


def anchors(ranges: Ranges, n: int, window: int = WINDOW_WORDS, prefix: int = PREFIX_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window the hash and the place of its prefix; leftmost of equal hashes."""
    grams = ranges.width(prefix, seed=1)
    width = window - prefix + 1
    if n < window:
        return grams[:0], np.empty(0, dtype=np.int64)
    low, at = grams[: n - window + 1].copy(), np.arange(n - window + 1)
    for i in range(1, width):
        there = grams[i : i + len(low)]
        less = there < low
        low[less] = there[less]
        at[less] = np.flatnonzero(less) + i
    return low, at


def _spots(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash of the prefix and spot of each anchor: first window << 8 | words before the anchor << 4 | windows."""
    words = hashes.of(split_words(text))
    n = len(words)
    if n < WINDOW_WORDS:
        return None
    low, at = anchors(Ranges(words), n)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, len(at)))
    return low[first], first << 8 | (at[first] - first) << 4 | count


def _placed(docs: DataFrame) -> DataFrame:
    """The anchors of all texts; those that a batch knows to be shared, and a row for each of their prefixes, beside the others."""
    arrow = _arrow_schema(_SPOTS)

    def compare(docs: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, spot = (np.concatenate(x) for x in zip(*parts))
        doc = np.repeat(np.array(docs, dtype=np.int64), [len(p[0]) for p in parts])
        order = np.argsort(key, kind="stable")
        key, spot, doc = key[order].view(np.int64), spot[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(start, len(key)))
        low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
        known, told = np.repeat(low < high, n), low < high
        # of a shared prefix, two rows tell other tasks: the smallest and the largest document, and how many suffixes
        more = key[start[told]]
        columns = (
            np.concatenate([key, more, more]), np.concatenate([doc, low[told], high[told]]),
            np.concatenate([spot, 1 - n[told], np.full(len(more), -1)]), np.concatenate([known, np.zeros(2 * len(more), bool)]),
        )
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        docs, parts, size = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                for doc, text in zip(*(batch.column(i).slice(lo, 200).to_pylist() for i in range(2))):
                    if (got := _spots(text, hashes)) is not None:
                        docs.append(doc)
                        parts.append(got)
                        size += len(got[0])
                        if size >= BATCH_SUFFIXES:
                            yield compare(docs, parts)
                            docs, parts, size = [], [], 0
        if parts:
            yield compare(docs, parts)

    return docs.mapInArrow(run, _SPOTS)


def _counted(spots: DataFrame, group_suffixes: int) -> DataFrame:
    """Suffixes whose prefix another document has, and prefixes to be lengthened; a prefix has at most a few rows a batch."""
    arrow = _arrow_schema(_SHARED)

    def compare(key: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        shared = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
        long = shared & (np.add.reduceat(np.where(spot > 0, 1, -spot), start) > group_suffixes)
        rows = np.diff(np.append(start, len(key)))
        go = np.flatnonzero(np.repeat(shared, rows) & (spot > 0))
        columns = (np.concatenate([key[go], key[start[long]]]), np.concatenate([doc[go], doc[start[long]]]), np.concatenate([spot[go], np.zeros(long.sum(), np.int64)]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            columns = [np.concatenate(x) for x in zip(held, new)] if held else new
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [c[cut:] for c in columns]  # the last prefix may go on
            if cut:
                yield compare(*(c[:cut] for c in columns))
        if held:
            yield compare(*held)

    open_ = spots.filter("NOT known").select("key", "doc_id", "spot")
    return open_.repartition("key").sortWithinPartitions("key").mapInArrow(run, _SHARED)


def _shared(spots: DataFrame, group_suffixes: int) -> DataFrame:
    """``at_id, spots``: the suffixes of a document whose prefix another one has; negative where it is to be lengthened."""
    counted = staged(_counted(spots, group_suffixes), "substring-counted")
    each = counted.filter("spot > 0").union(spots.filter("known").select("key", "doc_id", "spot"))
    # at most one in group_suffixes suffixes has such a prefix of its own, so Spark mostly finds this side small
    long = counted.filter("spot = 0").select("key", F.lit(True).alias("long"))
    met = each.join(long, "key", "left").select("doc_id", F.when(F.col("long"), -F.col("spot")).otherwise(F.col("spot")).alias("spot"))
    return met.groupBy(F.col("doc_id").alias("at_id")).agg(F.collect_list("spot").alias("spots"))


def _flat(suffixes: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, where each suffix starts among them, and how many words it has."""
    sizes = np.fromiter((s.count(b" ") + 1 for s in suffixes), dtype=np.int64, count=len(suffixes))
    return b" ".join(suffixes).split(b" "), np.cumsum(sizes) - sizes, sizes


def _window_hashes(words: list[bytes], starts: np.ndarray, hashes: WordHashes) -> np.ndarray:
    return Ranges(hashes.of(words)).of(starts, starts + WINDOW_WORDS, seed=3)


def _by_document(doc: np.ndarray, windows: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.lexsort((windows, doc))
    doc, windows = doc[order], windows[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (windows[1:] != windows[:-1])))
    doc, windows = doc[new], windows[new]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return doc[first].tolist(), [x.tobytes() for x in np.split(windows, first[1:])]


def _dealt(rows: DataFrame) -> DataFrame:
    """Suffixes of ``rows(doc_id, text, spots)`` by prefix, and (without words) what a batch found covered."""
    arrow = _arrow_schema(_SUFFIX)

    def compare(found: list[tuple[int, int, int, bytes]], hashes: WordHashes) -> pa.RecordBatch:
        low: dict[tuple[bytes, int], int] = {}
        for _, doc, lead, words in found:
            if low.setdefault((words, lead), doc) > doc:
                low[words, lead] = doc
        rows = {(words, lead): (key, doc, lead, words, None) for key, doc, lead, words in found if low[words, lead] == doc}
        covered = list({(doc, words) for _, doc, lead, words in found if low[words, lead] < doc})
        out = list(rows.values())
        if covered:
            words, starts, sizes = _flat([w for _, w in covered])
            count = sizes - WINDOW_WORDS + 1
            at = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            doc = np.repeat(np.fromiter((d for d, _ in covered), np.int64, len(covered)), count)
            out += [(d, d, 0, None, gone) for d, gone in zip(*_by_document(doc, _window_hashes(words, at, hashes)))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, digest = WordHashes(), xxhash.xxh3_64_intdigest
        found: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                for doc, text, spots in zip(*(batch.column(i).slice(lo, 200).to_pylist() for i in range(3))):
                    words = split_words(text)
                    for spot in spots:
                        deep, spot = spot < 0, abs(spot)
                        first, lead, count = spot >> 8, spot >> 4 & 15, spot & 15
                        if first + count + WINDOW_WORDS - 1 > len(words):
                            continue  # a spot of another text with this id
                        if deep:
                            for i in range(first, first + count):
                                own = b" ".join(words[i : i + WINDOW_WORDS])
                                found.append((digest(own, 1) - (1 << 63), doc, -1, own))
                        else:
                            own = b" ".join(words[first : first + count + WINDOW_WORDS - 1])
                            at = first + lead
                            found.append((digest(b" ".join(words[at : at + PREFIX_WORDS])) - (1 << 63), doc, lead, own))
                        size += len(own)
                        if len(found) >= BATCH_SUFFIXES or size >= BATCH_BYTES:
                            yield compare(found, hashes)
                            found, size = [], 0
        if found:
            yield compare(found, hashes)

    return rows.mapInArrow(run, _SUFFIX)


def suffix_order(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (rows of word numbers) in order, and how many words each shares with the one before (0 for the first)."""
    order = np.lexsort(right.T[::-1])
    other = right[order[1:]] != right[order[:-1]]
    shared = np.where(other.any(axis=1), other.argmax(axis=1), right.shape[1])
    return order, np.concatenate(([0], shared)) if len(order) else shared


def covered_windows(doc: np.ndarray, lead: np.ndarray, words: list[bytes], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each suffix and each of its windows (a column each) whether a smaller document has it.

    ``lead`` is how many words a suffix brings along from before its anchor.
    The internal nodes of the tree follow from the order of the suffixes: those
    of depth d are the runs in which neighbours share d words or more.
    """
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int32, count=len(words))
    anchor, count = starts + lead, sizes - WINDOW_WORDS + 1

    def column(at: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, flat[np.where(there, at, 0)], -1)

    right = np.stack([column(anchor + i, i < sizes - lead) for i in range(WINDOW_WORDS)], axis=1)
    order, shared = suffix_order(right)
    covered = np.zeros((len(doc), PLACES), dtype=bool)
    left = np.zeros(len(doc), dtype=np.int64)  # number of the words before the anchor that a window of this k has
    for k in range(PLACES):
        if k:
            left = np.unique(left * (len(numbers) + 1) + column(anchor - k, k <= lead) + 1, return_inverse=True)[1]
        node = np.empty(len(doc), dtype=np.int64)
        node[order] = np.cumsum(shared < WINDOW_WORDS - k)
        own = np.flatnonzero((k <= lead) & (lead - count < k))
        own = own[np.bincount(node[own], minlength=len(doc) + 1)[node[own]] > 1]
        if len(own):
            _, group = np.unique(node[own] * (int(left.max()) + 1) + left[own], return_inverse=True)
            low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group, doc[own])
            hit = own[doc[own] > low[group]]
            covered[hit, lead[hit] - k] = True
    return covered


def _met(suffixes: DataFrame, group_suffixes: int) -> DataFrame:
    """``doc_id, gone``: hashes of covered windows, from the subtrees of groups."""
    arrow = _arrow_schema(_GONE)

    def found(doc: np.ndarray, lead: np.ndarray, suffix: list[bytes], hashes: WordHashes) -> pa.RecordBatch | None:
        words, starts, sizes = _flat(suffix)
        hit, nth = np.nonzero(covered_windows(doc, np.maximum(lead, 0), words, starts, sizes))
        if not len(hit):
            return None
        # a row for each suffix with covered windows, so that rows are in proportion to the suffixes
        first = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1])))
        ends = (8 * np.append(first, len(hit))).astype(np.int32)
        gone = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(_window_hashes(words, starts[hit] + nth, hashes))])
        return pa.RecordBatch.from_arrays([pa.array(doc[hit[first]], pa.int64()), gone], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[pa.RecordBatch] = []
        rows = 0

        def ready(last: bool) -> tuple[pa.Table, pa.Table | None]:
            """What can be compared now: all groups but the last one, which may go on."""
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            cut = len(key) if last else int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut == 0 and table.column(2)[0].as_py() < 0:
                # a group of one node may be of any size: its smallest documents, which came first, meet the rest
                words = table.column(3).to_pylist()
                heads = sorted({w: i for i, w in reversed(list(enumerate(words)))}.values())
                return table, table.take(heads)
            return table.slice(0, cut), table.slice(cut) if cut < len(key) else None

        for batch in batches:
            known = batch.filter(pc.is_null(batch.column(3)))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(1), known.column(4)], schema=arrow)
            batch = batch.filter(pc.is_valid(batch.column(3)))
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= group_suffixes:
                now, rest = ready(False)
                if now.num_rows:
                    if (out := found(*_columns(now), hashes)) is not None:
                        yield out
                held = rest.combine_chunks().to_batches() if rest is not None else []
                rows = 0  # what stays waits for as many more, so that a long group is not looked through again each time
        if held and (out := found(*_columns(ready(True)[0]), hashes)) is not None:
            yield out

    ordered = suffixes.repartition("key").sortWithinPartitions("key", "doc_id")
    return ordered.mapInArrow(run, _GONE)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return table.column(1).to_numpy(), table.column(2).to_numpy().astype(np.int64), table.column(3).to_pylist()


def _known(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).filter(F.col("doc_id").isNotNull())


def repeated_windows(docs: DataFrame, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``at_id, gone``: hashes of the windows of a document that a smaller doc_id has too."""
    base = _known(docs)
    shared = staged(_shared(staged(_placed(base), "substring-spots"), group_suffixes), "substring-shared")
    suffixes = base.join(shared, F.col("doc_id") == F.col("at_id")).select("doc_id", "text", "spots")
    found = _met(_dealt(suffixes), group_suffixes)
    return found.groupBy(F.col("doc_id").alias("at_id")).agg(F.collect_list("gone").alias("gone"))


def _runs(words: list[bytes], gone: list[bytes] | None, hashes: WordHashes) -> np.ndarray:
    """Which words lie in covered windows."""
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    if gone:
        windows = Ranges(hashes.of(words)).width(WINDOW_WORDS, seed=3)
        start = np.flatnonzero(np.isin(windows, np.frombuffer(b"".join(gone), dtype=np.uint64)))
        edge[start] += 1
        edge[start + WINDOW_WORDS] -= 1
    return np.cumsum(edge[:-1]) > 0


def _per_text(docs: DataFrame, group_suffixes: int, one, schema: str) -> DataFrame:
    """Rows that ``one(doc_id, words, whether each is covered)`` gives for each row of ``docs``."""
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for doc, text, gone in zip(*(batch.column(i).slice(lo, 200).to_pylist() for i in range(3))):
                    words = split_words(text)
                    out += one(doc, words, _runs(words, gone, hashes))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    gone = repeated_windows(docs, group_suffixes)
    # the shuffle of texts by doc_id is the one that repeated_windows has made
    joined = _known(docs).join(gone, F.col("doc_id") == F.col("at_id"), "left").select("doc_id", "text", "gone")
    nameless = id_and_text(docs).filter(F.col("doc_id").isNull()).withColumn("gone", F.lit(None).cast(joined.schema["gone"].dataType))
    return joined.mapInArrow(run, schema).union(nameless.mapInArrow(run, schema))


def substring_dedup(docs: DataFrame, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row; kept words are joined by one space."""

    def cut(doc: int | None, words: list[bytes], covered: np.ndarray) -> list[tuple]:
        left = [words[i] for i in np.flatnonzero(~covered).tolist()] if covered.any() else words
        return [(doc, len(words), len(words) - len(left), b" ".join(left).decode())]

    return _per_text(docs, group_suffixes, cut, _DONE)


def maximal_repeats(docs: DataFrame, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``doc_id, start, length``: each longest run of words that smaller documents have, in words."""

    def spans(doc: int | None, words: list[bytes], covered: np.ndarray) -> list[tuple]:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
        return [(doc, int(a), int(b - a)) for a, b in edge.reshape(-1, 2)]

    return _per_text(docs, group_suffixes, spans, _RUNS)


def kept_digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
