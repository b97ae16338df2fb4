"""Byte-level BPE over documents, by two public libraries.

Both vocabularies split a text by a public pattern before they merge.  That
pattern always starts a new piece at a space that a character other than white
space follows.  So a text is cut at those spaces, and each chunk is encoded on
its own and remembered: most chunks come up again and again.  The ids of a text
are the ids of its chunks, one after the other, whatever its length.

Rows are encoded one by one: rows that repeat an id or a text, or lack an id,
each get their ids, a null text is an empty one and has no ids, and an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches

_NOT_PLAIN = re.compile(r" (?:\s|\Z)")
_CHUNK_START = re.compile(r" (?=\S)")
#: A space and all letters after it, where these and what follows lie below U+0250: one match of the public pattern.
_WORD = re.compile("( [A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++)(?=[\\x00-\u024f]|\\Z)")


class ChunkEncoder:
    """Ids of whole texts from ids of chunks; ``encode_chunks`` does new ones."""

    #: Chunks of more characters are not remembered, so that ``limit`` of them take about 60 MB.
    SHORT = 32

    def __init__(self, encode_chunks: Callable[[list[str]], Iterable[bytes]], limit: int = 300_000, group_chars: int = 1_000_000):
        self.encode_chunks, self.limit, self.group_chars = encode_chunks, limit, group_chars
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        chars = 0
        for text in texts:
            text = text or ""
            group.append(_CHUNK_START.split(text) if _NOT_PLAIN.search(text) else text.split(" "))
            chars += len(text)
            if chars >= self.group_chars:
                out += self._group(group)
                group, chars = [], 0
        return out + self._group(group)

    def _group(self, group: list[list[str]]) -> list[bytes]:
        """The first chunk of a text has no space before it; the others had one."""
        known = self.known
        new = list(set(itertools.chain.from_iterable(parts[1:] for parts in group)).difference(known))
        heads = list({parts[0] for parts in group} - {""})
        coded = list(self.encode_chunks([f" {x}" for x in new] + heads)) if new or heads else []
        known.update(zip(new, coded))
        head = dict(zip(heads, coded[len(new) :]))
        head[""] = b""
        out = [head[parts[0]] + b"".join(map(known.__getitem__, itertools.islice(parts, 1, None))) for parts in group]
        for x in new if len(known) > self.limit else [x for x in new if len(x) > self.SHORT]:
            del known[x]
        return out


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> ChunkEncoder:
    """Chunks by the tokenizers library from a file; one encoder a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    opens = np.zeros(model.get_vocab_size(), dtype=bool)  # ids that begin with a space
    for piece, i in model.get_vocab().items():
        opens[i] = piece.startswith("Ġ")

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_joined(chunks: list[str], joined: int = 64) -> list[bytes]:
        """Chunks that open with their only space are encoded many at a time and cut apart again."""
        out: list[bytes] = [b""] * len(chunks)
        plain = [i for i, x in enumerate(chunks) if x[:1] == " " and " " not in x[1:]]
        single = [i for i, x in enumerate(chunks) if not (x[:1] == " " and " " not in x[1:])]
        groups = [plain[i : i + joined] for i in range(0, len(plain), joined)]
        for group, got in zip(groups, ids(["".join(chunks[i] for i in group) for group in groups])):
            starts = np.flatnonzero(opens[got])
            if len(starts) != len(group):
                single += group
                continue
            raw, ends = got.tobytes(), [*(starts[1:] * 4).tolist(), len(got) * 4]
            for i, a, b in zip(group, (starts * 4).tolist(), ends):
                out[i] = raw[a:b]
        for i, got in zip(single, ids([chunks[i] for i in single])):
            out[i] = got.tobytes()
        return out

    letters = dict(enumerate(byte_letters()))
    tokenize = model.model.tokenize

    def encode_chunks(chunks: list[str]) -> list[bytes]:
        """Words go to the model as they are; what follows one is encoded after a word of one id, which is cut off."""
        found = [_WORD.match(x) for x in chunks]
        words = {m[0]: b"" for m in found if m}
        for word in words:
            got = tokenize(word.encode().decode("latin-1").translate(letters))
            words[word] = array("I", [x.id for x in got]).tobytes()
        rests = list({f" a{x[m.end():]}" if m else x for x, m in zip(chunks, found)} - {" a"})
        coded = {" a": one, **dict(zip(rests, encode_joined(rests)))}
        return [words[m[0]] + coded[f" a{x[m.end():]}"][len(one) :] if m else coded[x] for x, m in zip(chunks, found)]

    one = encode_joined([" a"])[0]
    return ChunkEncoder(encode_chunks)


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file, by rank; ranks must be 0, 1, 2, ... without gaps."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, lines)]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [piece for _, piece in pairs]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    import struct

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model with these byte pieces, id = rank, score = -rank.

    Fields of the public model format: 1 a piece (1 text, 2 score, 3 kind; kind
    2 is the unknown piece, put last), 2 the trainer (3 kind of model, 2 is BPE;
    40 id of the unknown piece), 3 the normaliser (1 name, 3 dummy prefix, 4
    extra white space removed, 5 white space escaped).
    """
    letters = byte_letters()
    body = bytearray()
    for rank, piece in enumerate(pieces):
        body += _field(1, _field(1, "".join(letters[b] for b in piece).encode()) + _field(2, float(-rank)))
    body += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    body += _field(2, _field(3, 2) + _field(40, len(pieces)))
    body += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(body)


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str, pattern: str) -> ChunkEncoder:
    """Pieces of ``pattern`` by a sentencepiece model made from a rank file.

    As with ranks, a piece that is itself in the vocabulary is one id.
    """
    import sentencepiece

    pieces = read_ranks(path)
    whole = {p.decode("latin-1"): i for i, p in enumerate(pieces)}
    model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(pieces))
    table = dict(enumerate(byte_letters()))
    split = regex.compile(pattern).findall

    def encode_chunks(chunks: list[str]) -> list[bytes]:
        cut = [[p.encode().decode("latin-1") for p in split(x)] for x in chunks]
        new = list(set(itertools.chain.from_iterable(cut)) - whole.keys())
        ids = {p: np.array(x, dtype="<u4").tobytes() for p, x in zip(new, model.encode([p.translate(table) for p in new], num_threads=1))} if new else {}
        known = {p: whole[p].to_bytes(4, "little") for p in set(itertools.chain.from_iterable(cut)) & whole.keys()} | ids
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    return ChunkEncoder(encode_chunks)


@functools.lru_cache(maxsize=2)
def _spelled(path: str) -> list[bytes]:
    """Bytes of each id, from the model's letters back."""
    letters = byte_letters()
    back = {c: b for b, c in enumerate(letters)}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(read_ranks(path)))
    return [bytes(back[c] for c in model.id_to_piece(i)) for i in range(model.get_piece_size() - 1)]


def bpe_encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` for every row: ids as little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file that every executor has.  A null or
    empty text has no ids.  Nothing is shuffled.
    """
    return map_batches(
        id_and_text(docs),
        lambda x: {"doc_id": x["doc_id"], "ids": piece_encoder(ranks, pattern).encode(x["text"])},
        "doc_id long, ids binary",
    )


def bpe_decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for."""

    def decode(x: dict[str, list]) -> dict[str, object]:
        spelled = _spelled(ranks)
        text = [b"".join(map(spelled.__getitem__, np.frombuffer(i, dtype="<u4").tolist())) for i in x["ids"]]
        return {"doc_id": x["doc_id"], "ids": x["ids"], "decoded": text}

    return map_batches(encoded.select("doc_id", "ids"), decode, "doc_id long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    decoded = bpe_decode(bpe_encode(docs, ranks, pattern), ranks)
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
