"""Harmonic packing of token sequences.

With capacity C, class k holds the lengths over C // (k + 1) and up to C // k,
and each bin of class k takes k pieces.  The last class, of the shortest pieces,
fills its bins instead: the piece that does not fit is cut there.  Classes are
independent, and so are workers: a worker is one task, which packs what it reads
and shares nothing.
A piece that would leave more than :data:`SLACK` of its bins empty is cut: first
a piece of just C // (k + 1) ids, which fills its own class's bins, then the
rest.  Bins still open at a worker's end are laid end to end, cut every C ids,
so that each worker leaves one short sequence at most.

A null or empty text has the end id alone.  Rows that repeat an id are packed as
separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import library_encoder
from .common import _arrow_schema, id_and_text

CAPACITY = 1024
SLACK = 0.05
#: Pieces of at most this part of the capacity share one class.
CLASSES = 32
#: sequence_id = worker * WORKER_SPAN + the worker's own count.
WORKER_SPAN = 1 << 40
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def cut_lengths(length: int, capacity: int = CAPACITY, slack: float = SLACK, classes: int = CLASSES) -> list[int]:
    """Lengths of the pieces of ``length`` ids, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = min(capacity // rest, classes)
        if k == classes or capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Bins:
    """One worker's open bins; ``add`` and ``close`` give (piece, sequence, offset, sequence's ids)."""

    def __init__(self, first: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next, self.capacity, self.classes = first, capacity, classes
        self.open: dict[int, list[tuple]] = {}
        self.short = 0  # ids in the last class's open bin

    def _fill(self, pieces: list[tuple]) -> list[tuple]:
        total = sum(p[2] for p in pieces)
        at, out = 0, []
        for p in pieces:
            out.append((p, self.next, at, total))
            at += p[2]
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """``piece``: (doc_id, start, length, ids, doc_tokens)."""
        k = min(self.capacity // piece[2], self.classes)
        held = self.open.setdefault(k, [])
        if k == self.classes:
            doc, start, length, ids, tokens = piece
            take = min(length, self.capacity - self.short)
            held.append((doc, start, take, ids[: take * 4], tokens))
            self.short += take
            if self.short < self.capacity:
                return []
            out = self._fill(held)
            rest = length - take
            self.open[k], self.short = [(doc, start + take, rest, ids[take * 4 :], tokens)] if rest else [], rest
            return out
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self._fill(held)

    def close(self) -> list[tuple]:
        out, held, size = [], [], 0
        for k in sorted(self.open):
            for doc, start, length, ids, tokens in self.open[k]:
                while length:
                    take = min(length, self.capacity - size)
                    held.append((doc, start, take, ids[: take * 4], tokens))
                    start, length, ids, size = start + take, length - take, ids[take * 4 :], size + take
                    if size == self.capacity:
                        out += self._fill(held)
                        held, size = [], 0
        self.open, self.short = {}, 0
        return out + (self._fill(held) if held else [])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: where its ids lie in the document and in which sequence.

    ``sequence_tokens`` is what the sequence holds; writers pad it to the
    capacity except at a power of two.  Nothing is shuffled and each task holds
    only its open bins, at most :data:`CLASSES` of them with less than
    ``capacity`` ids each.
    """
    arrow = _arrow_schema(_PIECES)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = library_encoder(tokenizer), Bins(TaskContext.get().partitionId() * WORKER_SPAN, capacity)

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            pieces, sequence, offset, total = zip(*placed)
            doc, start, length, ids, tokens = zip(*pieces)
            columns = (doc, start, length, ids, tokens, sequence, offset, total)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, placed = batch.slice(lo, 256), []
                for doc, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    raw += end
                    at, total = 0, len(raw) // 4
                    for n in cut_lengths(total, capacity):
                        placed += bins.add((doc, at, n, raw[at * 4 : (at + n) * 4], total))
                        at += n
                if placed:
                    yield rows(placed)
        if placed := bins.close():
            yield rows(placed)

    return id_and_text(docs).mapInArrow(run, _PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
