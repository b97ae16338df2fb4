"""Alignment of two tokenizers' tokens over documents, each distinct segment once.

A is a byte-level BPE from a file of the tokenizers library, B a sentencepiece
BPE with byte fallback.  Both encode a space and the text.

1. Cuts.  A text is cut before runs of white space that a character other than
   white space precedes.  A's public pattern starts a new piece there.  B's
   vocabulary is searched for pieces in which a white-space character follows
   another one: only characters for which there is none are cut at
   (:func:`cut_characters`).  So neither can merge across a cut, and the tokens
   of a text are those of its segments, one after the other.
2. Chunks.  Documents are gathered into chunks of CHUNK_CHARS characters.  A
   chunk keeps each distinct segment once with its number, and each document as
   the numbers of its segments.
3. Alignment.  The segments of all chunks are dealt and sorted by themselves, so
   each distinct one is encoded once by both; its groups and links come from the
   byte offsets at which both end.  What a chunk needs goes back to it, packed.
4. Counts.  Each chunk's pairs of ids, with how often its documents hold them
   linked, add up to the counts of the corpus, and a chunk gets those of its own
   pairs by a join.
5. Composition.  A chunk's documents are put together from its segments.  No
   list grows with the corpus: a chunk is bounded by its characters, or is one
   document.

Texts that are null or empty have no tokens.  Nor have those with U+2581, which B
reads as a space, so that its bytes differ from the text; for all others both
give back the text's bytes, which is checked for each segment and an error if
untrue.  Each row is a document of its own, whatever its id.  An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, library_encoder
from .common import _arrow_schema, id_and_text, staged

CHUNK_CHARS = 24_000_000
#: Segments that are encoded and aligned at a time, and about how many characters of them.
BATCH_SEGMENTS = 20_000
BATCH_CHARS = 4_000_000
#: Tokens and numbers that a task holds before it hands them on (about 100 MB).
HELD_TOKENS = 4_000_000
#: What B writes for a space.
SPACE_MARK = "\u2581"
#: All that any of the libraries may take for white space, so that a cut never depends on which does.
_WHITE = r"\s\x1c-\x1f\u180e\u200b\ufeff"


def cut_characters(pieces: list[str], candidates: str = " \n\t\x0b\x0c") -> str:
    """Those ``candidates`` that follow no other character than white space in any piece, so that no merge reaches over the place before them."""
    bad = set()
    for piece in pieces:
        spelled = piece.replace(SPACE_MARK, " ")
        bad.update(re.findall(rf"[^{_WHITE}]([{candidates}])", spelled))
    return "".join(c for c in candidates if c not in bad)


class Models:
    """Both tokenizers of a Python worker, with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encode_a = library_encoder(path_a).encode_chunks
        back = {c: b for b, c in enumerate(byte_letters())}
        model = Tokenizer.from_file(path_a)
        if model.normalizer is not None:
            raise ValueError(f"{path_a} changes texts before it encodes them")
        self.bytes_a = [b""] * model.get_vocab_size()
        for piece, i in model.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(back[c] for c in piece)

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        texts = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        probe = " x  éÅＡ\n"
        if sum(map(self.b.is_byte, range(len(pieces)))) != 256 or self.b.normalize(probe) != SPACE_MARK + probe.replace(" ", SPACE_MARK):
            raise ValueError(f"{path_b} does not spell every text in its own bytes")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = cut_characters(texts)
        #: put before a segment, it keeps the space that B adds apart from what follows; no piece has it
        self.guard = next(c for c in "\n\x0b\x0c\x01" if not any(c in p for p in texts))
        self.guard_ids = len(self.b.encode(self.guard))
        rest = f"(?:(?![{self.cuts}])[{_WHITE}][{_WHITE}]*+)" if self.cuts else f"[{_WHITE}]++"
        self.segment = re.compile(rf"[{_WHITE}]*+(?:[^{_WHITE}]++{rest}?+)*+", re.S)
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)

    def split(self, text: str) -> list[str]:
        """Segments of a space and the text."""
        out = self.segment.findall(f" {text}")
        out.pop()  # the match of nothing at the end
        return out


@functools.lru_cache(maxsize=1)
def models(path_a: str, path_b: str) -> Models:
    return Models(path_a, path_b)


def _batch(arrow: pa.Schema, **columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)


def packed(numbers: np.ndarray) -> bytes:
    halves = (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(halves)


def unpacked(raw: bytes) -> np.ndarray:
    halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype="<u2").astype(np.int64).reshape(2, -1)
    return halves[0] + (halves[1] << 16)


_CHUNKS = "chunk long, doc_id long, numbers binary, number int, segment string, times long"


def chunks(docs: DataFrame, path_a: str, path_b: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows of two kinds: a document with the numbers of its segments, and a segment of a chunk with its number.

    The most frequent segment of a chunk is its number 0, and so on.  ``numbers``
    has the lower 16 bits of all of a document's numbers, then the upper ones,
    which are mostly zero, compressed; null for a document without tokens.
    """
    arrow = _arrow_schema(_CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models(path_a, path_b)
        serial = itertools.count(TaskContext.get().partitionId() << 32)
        ids: list[int | None] = []
        coded: list[np.ndarray | None] = []
        number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        chars = 0

        def closed() -> Iterator[pa.RecordBatch]:
            chunk = next(serial)
            some = [x for x in coded if x is not None]
            times = np.bincount(np.concatenate(some), minlength=len(number)) if some else np.empty(0, dtype=np.int64)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            yield _batch(arrow, chunk=np.full(len(ids), chunk), doc_id=ids, numbers=[None if x is None else packed(place[x]) for x in coded])
            listed, times = list(number), times[order]
            segments = [listed[i] for i in order.tolist()]
            for i in range(0, len(segments), BATCH_SEGMENTS):
                part = segments[i : i + BATCH_SEGMENTS]
                yield _batch(arrow, chunk=np.full(len(part), chunk), number=np.arange(i, i + len(part), dtype=np.int32), segment=part, times=times[i : i + len(part)])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if ids and chars + len(text) > chunk_chars:
                    yield from closed()
                    ids, coded, chars = [], [], 0
                    number = defaultdict(itertools.count().__next__)
                ids.append(doc_id)
                chars += len(text)
                if not text or SPACE_MARK in text:
                    coded.append(None)
                else:
                    segments = m.split(text)
                    coded.append(np.fromiter(map(number.__getitem__, segments), dtype=np.uint32, count=len(segments)))
        if ids:
            yield from closed()

    return id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNKS)


def ragged(flat: np.ndarray, sizes: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Of lists of these sizes, laid one after the other, those that ``take`` names."""
    starts = np.cumsum(sizes) - sizes
    wanted = sizes[take]
    shift = np.repeat(starts[take] - (np.cumsum(wanted) - wanted), wanted)
    return flat[np.arange(int(wanted.sum())) + shift]


class Aligned:
    """Segments with their tokens and groups: how many of each, and all of them one after the other."""

    #: Tokens of A and B and groups of each segment; ids; and tokens of A and B of each group.
    COUNTS, FLAT = ("n_a", "n_b", "n_groups"), (("a", "n_a"), ("b", "n_b"), ("group_a", "n_groups"), ("group_b", "n_groups"))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, segments: list[str], m: Models) -> Aligned:
        """As both tokenizers end at the end of each segment, the offsets at which both end are found for all of them at once."""
        raw = [s.encode() for s in segments]
        a = [np.frombuffer(x, dtype="<u4") for x in m.encode_a(segments)]
        b = [np.array(x[m.guard_ids :], dtype=np.int64) for x in m.b.encode([m.guard + s for s in segments], num_threads=1)]
        for s, x, y in zip(raw, a, b):
            if b"".join(map(m.bytes_a.__getitem__, x.tolist())) != s or b"".join(map(m.bytes_b.__getitem__, y.tolist())) != s:
                raise ValueError(f"tokens do not spell the segment {s[:80]!r}")
        all_a, all_b = np.concatenate(a).astype(np.int64), np.concatenate(b)
        ends_a, ends_b = np.cumsum(m.length_a[all_a]), np.cumsum(m.length_b[all_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        upto_a, upto_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        upto = np.searchsorted(both, np.cumsum([len(s) for s in raw]), side="right")
        return cls(
            n_a=np.array(list(map(len, a))), n_b=np.array(list(map(len, b))), n_groups=np.diff(upto, prepend=0),
            a=all_a, b=all_b, group_a=np.diff(upto_a, prepend=0), group_b=np.diff(upto_b, prepend=0),
        )

    def take(self, which: np.ndarray) -> Aligned:
        return Aligned(**{n: getattr(self, n)[which] for n in self.COUNTS}, **{n: ragged(getattr(self, n), getattr(self, size), which) for n, size in self.FLAT})

    @classmethod
    def joined(cls, parts: list[Aligned]) -> Aligned:
        return parts[0] if len(parts) == 1 else cls(**{n: np.concatenate([getattr(p, n) for p in parts]) for n in (*cls.COUNTS, *(f for f, _ in cls.FLAT))})

    def links(self) -> np.ndarray:
        """The pair of each group's last tokens, as one number."""
        return self.a[np.cumsum(self.group_a) - 1] << 32 | self.b[np.cumsum(self.group_b) - 1]

    def groups(self) -> list[str]:
        """Each segment's groups, spelled."""
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        out, i, j = [], 0, 0
        for x, y in zip(self.group_a.tolist(), self.group_b.tolist()):
            out.append(f"{a[i]}|{b[j]}" if x == y == 1 else f"{','.join(a[i : i + x])}|{','.join(b[j : j + y])}")
            i, j = i + x, j + y
        ends = np.cumsum(self.n_groups).tolist()
        return [";".join(out[x:y]) for x, y in zip([0, *ends], ends)]

    def packed(self, numbers: np.ndarray) -> bytes:
        arrays = [numbers, *(getattr(self, n) for n in self.COUNTS), *(getattr(self, n) for n, _ in self.FLAT)]
        sizes = np.array([len(x) for x in arrays], dtype="<u4")
        return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(sizes.tobytes() + b"".join(x.astype("<u4").tobytes() for x in arrays))

    @classmethod
    def unpacked(cls, raw: bytes) -> tuple[np.ndarray, Aligned]:
        names = ["numbers", *cls.COUNTS, *(n for n, _ in cls.FLAT)]
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype="<u4").astype(np.int64)
        ends = np.cumsum(data[: len(names)]) + len(names)
        arrays = {n: data[e - k : e] for n, e, k in zip(names, ends.tolist(), data[: len(names)].tolist())}
        return arrays.pop("numbers"), cls(**arrays)


def pack_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(np.stack([keys, times]).astype("<i8").tobytes())


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, times = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype="<i8").reshape(2, -1)
    return keys, times


_KNOWN = "chunk long, entries binary, pairs binary"


def aligned(uses: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each chunk, packed alignments of some of its segments, and the pairs of ids they link with how often the chunk's documents hold them."""
    arrow = _arrow_schema(_KNOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models(path_a, path_b)
        last: tuple[str, Aligned] | None = None
        held: defaultdict[int, list[tuple[np.ndarray, np.ndarray, Aligned]]] = defaultdict(list)
        n_held = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for c, parts in held.items():
                own = Aligned.joined([x for _, _, x in parts])
                numbers, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                keys, inverse = np.unique(own.links(), return_inverse=True)
                sums = np.zeros(len(keys), dtype=np.int64)
                np.add.at(sums, inverse, np.repeat(times, own.n_groups))
                yield _batch(arrow, chunk=[c], entries=[own.packed(numbers)], pairs=[pack_pairs(keys, sums)])
            held.clear()

        for batch in batches:
            segments = batch.column("segment").to_pylist()
            chunk, number, times = (batch.column(n).to_numpy() for n in ("chunk", "number", "times"))
            # equal segments stand together; the first may be the last of the batch before
            new = np.array([i == 0 or segments[i] != segments[i - 1] for i in range(len(segments))])
            entry = np.cumsum(new) - 1
            distinct = [segments[i] for i in np.flatnonzero(new).tolist()]
            parts = [last[1]] if last and distinct and last[0] == distinct[0] else []
            at = len(parts)
            while at < len(distinct):
                to, chars = at, 0
                while to < len(distinct) and (to == at or to - at < BATCH_SEGMENTS and chars + len(distinct[to]) <= BATCH_CHARS):
                    chars += len(distinct[to])
                    to += 1
                parts.append(Aligned.of(distinct[at:to], m))
                at = to
            if not parts:
                continue
            known = Aligned.joined(parts)
            last = distinct[-1], known.take(np.array([len(distinct) - 1]))
            for c in np.unique(chunk).tolist():
                rows = np.flatnonzero(chunk == c)
                held[c].append((number[rows], times[rows], known.take(entry[rows])))
            n_held += len(known.a) + len(known.b) + len(segments)
            if n_held > HELD_TOKENS:
                yield from handed_on()
                n_held = 0
        yield from handed_on()

    dealt = uses.select("chunk", "number", "segment", "times").repartition("segment").sortWithinPartitions("segment", "chunk")
    return dealt.mapInArrow(run, _KNOWN)


def pair_counts(known: DataFrame) -> DataFrame:
    """``a, b, pair_count, best``: how many links of the corpus hold the pair, and whether no pair of that ``b`` has more."""
    arrow = _arrow_schema("a int, b int, times long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            parts = [(keys, times), *map(unpack_pairs, batch.column("pairs").to_pylist())]
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            added = np.concatenate([t for _, t in parts])
            times = np.zeros(len(keys), dtype=np.int64)
            np.add.at(times, inverse, added)
        if len(keys):
            yield _batch(arrow, a=(keys >> 32).astype(np.int32), b=(keys & 0xFFFFFFFF).astype(np.int32), times=times)

    summed = known.select("pairs").mapInArrow(run, "a int, b int, times long")
    counts = staged(summed.groupBy("a", "b").agg(F.sum("times").alias("pair_count")), "align-pairs")
    most = counts.groupBy("b").agg(F.max("pair_count").alias("most"))
    return counts.join(most, "b").select("a", "b", "pair_count", (F.col("pair_count") == F.col("most")).alias("best"))


def chunk_pairs(known: DataFrame) -> DataFrame:
    """``chunk, a, b``: each pair that a chunk's segments link, once."""

    def distinct(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(np.concatenate([unpack_pairs(x)[0] for x in rows["pairs"]]))
        return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32)})

    return known.select("chunk", "pairs").groupBy("chunk").applyInPandas(distinct, "chunk long, a int, b int")


_DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per document: tokens of both, groups, links, links that are their B id's most frequent, the sum of links' counts, digest of the groups."""
    laid = staged(chunks(docs, path_a, path_b, chunk_chars), "align-chunks")
    found = staged(aligned(laid.filter("segment IS NOT NULL"), path_a, path_b), "align-known")
    counted = chunk_pairs(found).join(pair_counts(found), ["a", "b"])
    entries = found.select("chunk", "entries")
    known = entries.unionByName(counted, allowMissingColumns=True).withColumnRenamed("chunk", "of_chunk")
    texts = laid.filter("segment IS NULL").select("chunk", "doc_id", "numbers")

    def compose(documents: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        is_pair = known["entries"].isna()
        pair = known[is_pair]
        keys = pair["a"].to_numpy(dtype=np.int64) << 32 | pair["b"].to_numpy(dtype=np.int64)
        order = np.argsort(keys)
        keys, best, count = keys[order], pair["best"].to_numpy(dtype=np.int64)[order], pair["pair_count"].to_numpy(dtype=np.int64)[order]
        done = []
        for raw in known["entries"][~is_pair]:
            numbers, own = Aligned.unpacked(raw)
            at = np.searchsorted(keys, own.links())
            of = np.repeat(np.arange(len(numbers)), own.n_groups)
            sums = np.zeros((2, len(numbers)), dtype=np.int64)
            np.add.at(sums[0], of, best[at])
            np.add.at(sums[1], of, count[at])
            done.append((numbers, np.stack([own.n_a, own.n_b, own.n_groups, *sums]), own.groups()))
        n = sum(len(x) for x, _, _ in done)
        table, groups = np.zeros((5, n), dtype=np.int64), np.empty(n, dtype=object)
        for numbers, values, spelled in done:
            table[:, numbers], groups[numbers] = values, spelled
        rows = []
        for doc_id, numbers in zip(documents["doc_id"].array, documents["numbers"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            if numbers is None:
                rows.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
                continue
            at = unpacked(numbers)
            a, b, n, best, total = table[:, at].sum(axis=1).tolist()
            rows.append((doc_id, a, b, n, n, best, total, hashlib.sha256(";".join(groups[at].tolist()).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGESTS.split(", ")]).astype({"doc_id": "Int64"})

    return texts.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInPandas(compose, _DIGESTS)
