"""What the operators share: staging, Arrow batches, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, staged  # noqa: F401  the operators take them from here

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SHINGLE_WORDS = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, a null text being empty."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str, *, state: Callable | None = None
) -> DataFrame:
    """Apply ``fn`` to Arrow batches given as column lists.

    With ``state``, each task calls it once and passes its result to every
    ``fn(batch, state)``.  ``fn`` returns columns (lists or arrays) by name.
    """
    names = [f.name for f in _struct(schema)]
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state() if state else None
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = fn(columns, own) if state else fn(columns)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_struct(schema))


class WordHashes(dict):
    """64-bit hash of each word; words of up to 32 bytes are remembered, up to ``limit`` of them (about 60 MB)."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit and len(word) <= 32:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters outside :data:`SPACES`, in UTF-8."""
    return text.encode().split() if text else []


#: Odd multipliers of the rolling combinations (fixed, so that all tasks agree).
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base of polynomial hashes and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            powers = []
            for base in (_BASE, _INVERSE):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                powers.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = powers
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _salt(seed: int) -> np.uint64:
    return np.uint64((seed + 1) * int(_MIX) & (1 << 64) - 1)


class Ranges:
    """64-bit hashes of ranges of a sequence, from the sums of one polynomial over it."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(mix(values) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + _salt(seed))

    def width(self, width: int, seed: int = 0) -> np.ndarray:
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + _salt(seed))


def rolling(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` values; empty if there are fewer."""
    return Ranges(values).width(width, seed)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


#: Words of 64 bits of the table by which rows that no group can hold are passed over: 4 MB, whatever the input.
TABLE_WORDS = 1 << 18


def maybe_in(rows: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` without most of those whose keys are not in ``groups``; none of the others is lost.

    The keys of ``groups`` set bits of a table of fixed size, so it is broadcast
    however many they are; with more keys than bits fewer rows are passed over.
    """
    key = F.xxhash64(*names, F.lit(len(names)))
    word, bit = F.shiftrightunsigned(key, 6).bitwiseAND(TABLE_WORDS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    table = groups.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.join(F.broadcast(table), word == F.col("word")).filter(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def squeezed(column: Column) -> Column:
    """Text without any of :data:`SPACES`."""
    return F.regexp_replace(column, r"[\x20\x09-\x0D]+", "")
