"""Token ids in binary files, with a shared zstandard dictionary.

File format.  A folder holds two Parquet tables that Spark writes and commits,
so that any store Spark reaches will do and lost executors leave no torn files:

``dictionary``  one row: ``hash`` (SHA-256, hex) and ``dictionary`` (bytes).
``shards``      one row for each block of consecutive documents: ``shard`` and
                ``block`` (their order is that of doc_id), ``first_doc``,
                ``last_doc``, ``n_docs``, ``n_null`` (documents without an id,
                which come first), ``n_tokens``, ``dictionary_hash``,
                ``doc_ids`` (signed 64-bit), ``tokens`` (unsigned 64-bit, ids
                of each document), ``offsets`` (unsigned 64-bit, one more than
                documents: where each frame starts in the payload, and its
                end) and ``payload`` (one zstandard frame for each document,
                its ids as unsigned 32-bit integers).  All are little-endian.

Documents are in ascending doc_id, null ids first (each block says how many of
its documents have none; their places in ``doc_ids`` are 0); rows that repeat an id stand side by side.  A null or empty
text has the end id alone.  An empty table gives files without blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import library_encoder
from .common import _arrow_schema, id_and_text, map_batches

#: A dictionary is trained on at most so many documents, and of each on at most so many pieces, spread evenly over all its ids.
SAMPLE_DOCS = 400
SAMPLE_PIECES = 16
PIECE_BYTES = 1024
DICTIONARY_BYTES = 65_536
DOCS_PER_SHARD = 8192
BLOCK_BYTES = 16_000_000
_SHARDS = (
    "shard int, block int, first_doc long, last_doc long, n_docs long, n_null long, n_tokens long, dictionary_hash string, "
    "doc_ids binary, tokens binary, offsets binary, payload binary"
)


def _with_end(ids: list[bytes], end_id: int | None) -> list[bytes]:
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    return [x + end for x in ids]


def spread_pieces(raw: bytes, most: int = SAMPLE_PIECES, size: int = PIECE_BYTES) -> list[bytes]:
    """All of ``raw`` in pieces, or ``most`` of them at even distances from its start to its end."""
    n = -(-len(raw) // size)
    return [raw[i * size : (i + 1) * size] for i in (range(n) if n <= most else (j * (n - 1) // (most - 1) for j in range(most)))]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int | None) -> bytes:
    """A dictionary from the :data:`SAMPLE_DOCS` documents whose ids hash lowest; empty if there is too little."""
    ids = [r[0] for r in docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    if not ids:
        return b""
    picked = id_and_text(docs).filter(F.col("doc_id").isin(ids))

    def pieces(x: dict[str, list]) -> dict[str, object]:
        return {"piece": [p for raw in _with_end(library_encoder(tokenizer).encode(x["text"]), end_id) for p in spread_pieces(raw)]}

    samples = sorted(bytes(r[0]) for r in map_batches(picked, pieces, "piece binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, docs_per_shard: int = DOCS_PER_SHARD) -> None:
    """Encode and write all documents; ``tokenizer`` is a file that every executor has.

    Texts are dealt by ranges of doc_id, once; each task writes its range in
    blocks of about :data:`BLOCK_BYTES`, so memory is bounded by one block.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    base = id_and_text(docs)
    shards = max(1, -(-docs.count() // docs_per_shard))
    ordered = base.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    arrow = _arrow_schema(_SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack, shard, block = library_encoder(tokenizer), _compressor(dictionary), TaskContext.get().partitionId(), 0
        ids, counts, frames, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {
                "shard": shard, "block": block, "first_doc": known[0] if known else None, "last_doc": known[-1] if known else None,
                "n_docs": len(ids), "n_null": len(ids) - len(known), "n_tokens": sum(counts), "dictionary_hash": digest,
                "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "tokens": np.array(counts, "<u8").tobytes(),
                "offsets": np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes(), "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                coded = _with_end(encoder.encode(part.column(1).to_pylist()), end_id)
                for doc, raw in zip(part.column(0).to_pylist(), coded):
                    ids.append(doc)
                    counts.append(len(raw) // 4)
                    frames.append(pack.compress(raw))
                    size += len(frames[-1])
                    if size >= BLOCK_BYTES:
                        yield done()
                        block += 1
                        ids, counts, frames, size = [], [], [], 0
        if ids:
            yield done()

    ordered.mapInArrow(run, _SHARDS).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """``doc_id, start, ids``: each document's ids and how many ids all before it have.

    With ``doc_ids``, only blocks whose range holds one of them are read, and
    only the frames of those documents are decompressed.
    """
    row = spark.read.parquet(f"{path}/dictionary").head()
    dictionary, digest = bytes(row["dictionary"]), row["hash"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary does not match its hash")
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    # 24 bytes for each block of up to 16 MB: a millionth of the data, in one ordered pass
    before = Window.orderBy("at_shard", "at_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select(F.col("shard").alias("at_shard"), F.col("block").alias("at_block"), "n_tokens").select(
        "at_shard", "at_block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )
    if shards.count() <= 100_000:  # 2.4 MB
        starts = F.broadcast(starts)
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    if wanted is not None:
        shards = shards.filter(F.exists(F.lit(wanted).cast("array<long>"), lambda i: (F.col("first_doc") <= i) & (F.col("last_doc") >= i)))
    found = shards.join(starts, (F.col("shard") == F.col("at_shard")) & (F.col("block") == F.col("at_block"))).select(
        "base", "dictionary_hash", "n_null", "doc_ids", "tokens", "offsets", "payload"
    )
    schema = "doc_id long, start long, ids binary"
    arrow = _arrow_schema(schema)
    only = None if wanted is None else np.array(wanted, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _decompressor(dictionary)
        for batch in batches:
            for x in range(batch.num_rows):
                base, hashed, n_null, docs, tokens, offsets, payload = (batch.column(i)[x].as_py() for i in range(7))
                if hashed != digest:
                    raise ValueError("a block was written with another dictionary")
                docs, tokens, offsets = np.frombuffer(docs, "<i8"), np.frombuffer(tokens, "<u8").astype(np.int64), np.frombuffer(offsets, "<u8").tolist()
                start = base + np.cumsum(tokens) - tokens
                take = np.arange(len(docs)) if only is None else np.flatnonzero(np.isin(docs, only) & (np.arange(len(docs)) >= n_null))
                for lo in range(0, len(take), 512):
                    some = take[lo : lo + 512].tolist()
                    ids = [unpack.decompress(payload[offsets[i] : offsets[i + 1]], max_output_size=int(tokens[i]) * 4) for i in some]
                    names = [None if i < n_null else int(docs[i]) for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start[some], pa.int64()), pa.array(ids, pa.binary())], schema=arrow)

    return found.mapInArrow(run, schema)


def id_digests(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
