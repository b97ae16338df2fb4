"""Language by compression.

Each language has a raw-content zstandard dictionary: the words of documents
of it, each once, the most frequent last, where references to them are
shortest.  (Running text would let one copied passage decide.)  Case is folded.
A text is cut into chunks, all of it; each chunk is compressed with
each dictionary, and the language with the smallest sum wins (ties: the first
by name).  The score is the share that it saves against the second, 0 to 1;
where that is under ``MARGIN`` the verdict is not accepted, though the best
language is still named.  A null text, or one without letters, is ``und`` with
score 0 and not accepted; so is every text if nothing was learned.  Rows are
judged one by one, whether or not their ids repeat; an empty table gives an
empty result.
"""

from __future__ import annotations

import collections
import functools
import itertools

import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

#: Most documents that a language is learned from, each of them whole.
SAMPLE_DOCS = 60
DICTIONARY_BYTES = 65_536
#: Words of more characters are learned in pieces.
LONGEST_WORD = 40
PIECE_CHARS = 4
CHUNK_BYTES = 2048
LEVEL = 5
MARGIN = 0.01
HELD_OUT = 2


def held_out() -> Column:
    """Whether ``doc_id`` is one that nothing is learned from; null ids aren't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def learn_dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, limit: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each non-null ``lang`` of the rows that are not held out.

    Only ids and languages are ranked, by a hash of the id; Spark keeps the
    first ``sample_docs`` of a language in each task before it shuffles them.
    Their whole texts are counted, word by word, and of the counts only what
    fits into a dictionary reaches the driver.
    """
    rows = docs.filter(~held_out() & docs["lang"].isNotNull() & docs["text"].isNotNull() & docs["doc_id"].isNotNull()).select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sample_docs)
    ids = [r[0] for r in picked.select("doc_id").distinct().collect()]
    if not ids:
        return {}
    words = rows.filter(F.col("doc_id").isin(ids)).select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    # scripts without spaces have no such words; what is too long for one is counted in pieces
    long = F.length("word") > LONGEST_WORD
    words = words.select("lang", F.explode(F.when(long, F.regexp_extract_all("word", F.lit(f".{{1,{PIECE_CHARS}}}"), F.lit(0))).otherwise(F.array("word"))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # a word takes two bytes at least, with its space
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("nth") <= limit // 2)
    found: dict[str, collections.Counter] = {}
    for lang, word, n in ranked.select("lang", "word", "n").collect():
        found.setdefault(lang, collections.Counter())[word.encode()] = n
    return {lang: word_dictionary(n, limit) for lang, n in sorted(found.items())}


def word_dictionary(counts: collections.Counter, limit: int = DICTIONARY_BYTES) -> bytes:
    """The most frequent words that fit, ascending in frequency, one space around each; a word that does not fit is passed over."""
    taken, used = [], 0
    for word in sorted(counts, key=lambda w: (-counts[w], w)):
        if used + len(word) + 1 < limit:
            taken.append(word)
            used += len(word) + 1
    return b" " + b"".join(w + b" " for w in reversed(taken))


@functools.lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[list[str], list[zstandard.ZstdCompressor]]:
    made = []
    for _, content in dictionaries:
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False))
    return [k for k, _ in dictionaries], made


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for every row, from its text alone."""
    learned = tuple(sorted((k, v) for k, v in dictionaries.items() if v))
    letter = regex.compile(r"\p{L}")

    def one(text: str | None) -> tuple[str, float]:
        names, compressors = _compressors(learned)
        if not names or text is None or not letter.search(text):
            return "und", 0.0
        data = text.lower().encode()
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum(map(len, map(c.compress, chunks))) for c in compressors]
        best, *rest = sorted(zip(sizes, names))
        return best[1], (rest[0][0] - best[0]) / rest[0][0] if rest else 1.0

    def predict(x: dict[str, list]) -> dict[str, object]:
        got = [one(t) for t in x["text"]]
        return {
            "doc_id": x["doc_id"],
            "lang_pred": [g[0] for g in got],
            "score": [g[1] for g in got],
            "accepted": [g[0] != "und" and g[1] >= margin for g in got],
        }

    return map_batches(docs.select("doc_id", "text"), predict, "doc_id long, lang_pred string, score double, accepted boolean")
