"""Quality rules over words, and line labelling by a linear-chain CRF.

Words are runs of characters outside space and U+0009 to U+000D; lines are
what ``\\n`` separates.  Each line with a word gets one of two labels, content
or boilerplate, by Viterbi decoding; a document stays if no base rule fails and
lines labelled content hold at least ``share`` of its word characters.  A null
or empty text has no words, fails a base rule, and goes.

The CRF learns from labelled documents.  The lines of a document of quality 0
are boilerplate.  Those of a document of quality 1 are content, but for lines
that at least :data:`REPEATED` documents of the sample hold between other lines
each time, as notices and headings are (a copied document brings its lines
along, so copies don't make their lines boilerplate); in texts of at most
:data:`FEW_LINES` lines all are content, as they are most of the text.  With labels of one kind
only, or none, there is no model and the base rules decide alone.

Rows are judged one by one, whether or not their ids repeat or are null; an
empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SPACES, WordHashes, map_batches, rolling, split_words

SYMBOLS = "#*$%&|<>"
CONTENT_SHARE = 0.5
#: The CRF is fitted on at most so many labelled documents of each quality, whole ones of at most so many lines in all.
SAMPLE_DOCS = 600
SAMPLE_LINES = 40_000
#: Texts of so few lines have a feature of their own.
FEW_LINES = 3
#: From so many documents on, each with other lines around it, a line is boilerplate.
REPEATED = 4
STEPS = 120
#: Texts are judged together, up to about so many characters.
GROUP_CHARS = 1_000_000
_EDGES = {
    "words": (2, 4, 8, 16, 32, 64),
    "word_chars": (2.5, 3.5, 4.5, 5.5, 7.0, 9.0, 12.0),
    "symbols": (0.0, 0.005, 0.02, 0.05, 0.1),
    "upper": (0.0, 0.02, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.0, 0.02, 0.1, 0.3),
    "repeats": (0.0, 0.1, 0.2, 0.35, 0.5, 0.7),
    "marks": (0.0, 0.02, 0.04, 0.08, 0.15),
}
_SLOTS = np.cumsum([0] + [len(e) + 1 for e in _EDGES.values()])
#: Further features: seen before in the text, ends a sentence, is the first line, is the last, is the only one, is one of two or three.
N_FLAGS = 6
N_FEATURES = int(_SLOTS[-1]) + N_FLAGS
#: What a byte of UTF-8 counts as: one character, one that is no white space, and so on.
_CHAR, _INK, _SYMBOL, _UPPER, _DIGIT, _MARK = (1 << i for i in range(6))
_KINDS = np.array(
    [
        _CHAR * (b & 0xC0 != 0x80 and b != 10)
        | _INK * (b & 0xC0 != 0x80 and b not in SPACES.encode())
        | _SYMBOL * (b in SYMBOLS.encode())
        | _UPPER * (65 <= b <= 90)
        | _DIGIT * (48 <= b <= 57)
        | _MARK * (b in b"!.,;:?")
        for b in range(256)
    ],
    dtype=np.uint8,
)
_TABLE = str.maketrans("", "", SPACES)


@dataclass(frozen=True)
class LineModel:
    """``emit``: a weight for each feature and label (0 boilerplate, 1 content); ``move``: from label to label."""

    emit: np.ndarray
    move: np.ndarray


@dataclass(frozen=True)
class Lines:
    """Lines of many texts: feature numbers (a column a kind), further features as 0 or 1, characters that are no white space."""

    slots: np.ndarray
    flags: np.ndarray
    ink: np.ndarray

    def scores(self, model: LineModel) -> np.ndarray:
        last = int(_SLOTS[-1])
        out = self.flags @ model.emit[last:]
        for column in self.slots.T:
            out += model.emit[column]
        return out


def describe(lines: list[str], sizes: list[int]) -> Lines:
    """``lines`` of texts that have ``sizes`` lines each; a line holds a word and no ``\\n``."""
    slots, flags = np.zeros((len(lines), len(_EDGES)), dtype=np.int64), np.zeros((len(lines), N_FLAGS))
    if not lines:
        return Lines(slots, flags, np.zeros(0, dtype=np.int64))
    raw = "\n".join(lines).encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    kind = _KINDS[data]
    kind[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] |= _UPPER  # capital letters U+00C0 to U+00DE
    starts = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    count = lambda bit: np.add.reduceat((kind & bit) != 0, starts, dtype=np.int64)
    chars, ink = np.maximum(count(_CHAR), 1), count(_INK)
    words = [x.split() for x in raw.split(b"\n")]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    distinct = np.fromiter(map(len, map(set, words)), dtype=np.int64, count=len(words))
    values = {
        "words": n, "word_chars": ink / np.maximum(n, 1), "symbols": count(_SYMBOL) / chars, "upper": count(_UPPER) / chars,
        "digits": count(_DIGIT) / chars, "repeats": 1 - distinct / np.maximum(n, 1), "marks": count(_MARK) / chars,
    }
    for j, (name, edges) in enumerate(_EDGES.items()):
        slots[:, j] = _SLOTS[j] + np.searchsorted(edges, values[name], side="left")
    at = 0
    for size in sizes:
        seen: set[str] = set()
        for i in range(at, at + size):
            flags[i, 0] = lines[i] in seen
            seen.add(lines[i])
        flags[at, 2] = flags[at + size - 1, 3] = 1
        flags[at : at + size, 4], flags[at : at + size, 5] = size == 1, 1 < size <= FEW_LINES
        at += size
    flags[:, 1] = [bool(w) and w[-1][-1:] in (b".", b"!", b"?") for w in words]
    return Lines(slots, flags, ink)


def line_features(lines: list[str]) -> np.ndarray:
    """The features each line of one text has, as 0 or 1; a row a line."""
    found = describe(lines, [len(lines)] if lines else [])
    out = np.zeros((len(lines), N_FEATURES), dtype=np.float32)
    np.put_along_axis(out, found.slots, 1, axis=1)
    out[:, int(_SLOTS[-1]) :] = found.flags
    return out


def fit_crf(texts: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, l2: float = 1e-3) -> LineModel | None:
    """Gradient ascent on the likelihood of label sequences; texts are (features of lines, labels of lines).

    Texts of mostly content and of mostly boilerplate count the same in sum.
    """
    if len({int(k) for _, y in texts for k in y}) < 2:
        return None
    texts = sorted(texts, key=lambda t: -len(t[1]))  # at line t only the first texts[:more[t]] go on
    sizes = np.array([len(y) for _, y in texts])
    more = [int((sizes > t).sum()) for t in range(int(sizes[0]))]
    x, gold = np.concatenate([f for f, _ in texts]).astype(np.float64), np.concatenate([y for _, y in texts])
    starts = np.cumsum(sizes) - sizes
    good = np.array([2 * y.sum() >= len(y) for _, y in texts])
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    each, last = np.repeat(weight, sizes), starts + sizes - 1
    follows = np.ones(len(gold), dtype=bool)
    follows[starts] = False
    after = np.flatnonzero(follows)
    hot = np.eye(2)[gold]
    real = np.einsum("ni,nj,n->ij", hot[after - 1], hot[after], each[after])
    emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    grad_e2, grad_m2 = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(steps):
        score = x @ emit
        alpha, beta = score.copy(), np.zeros_like(score)
        for t in range(1, len(more)):
            at = starts[: more[t]] + t
            alpha[at] += np.logaddexp(alpha[at - 1, :1] + move[0], alpha[at - 1, 1:] + move[1])
        for t in range(len(more) - 1, 0, -1):
            at = starts[: more[t]] + t
            on = beta[at] + score[at]
            beta[at - 1] = np.logaddexp(move[:, 0] + on[:, :1], move[:, 1] + on[:, 1:])
        total = np.repeat(np.logaddexp(alpha[last, 0], alpha[last, 1]), sizes)
        share = np.exp(np.clip(alpha + beta - total[:, None], -50, 0))
        pair = alpha[after - 1][:, :, None] + move + (score[after] + beta[after] - total[after, None])[:, None, :]
        g_emit = x.T @ ((hot - share) * each[:, None]) - l2 * emit
        g_move = real - np.einsum("nij,n->ij", np.exp(np.clip(pair, -50, 0)), each[after]) - l2 * move
        grad_e2 += g_emit**2
        grad_m2 += g_move**2
        emit += 0.3 * g_emit / np.sqrt(grad_e2)
        move += 0.1 * g_move / np.sqrt(grad_m2)
    return LineModel(emit, move)


def viterbi(features: np.ndarray, model: LineModel) -> list[int]:
    """The likeliest labels of the lines; ties go to content."""
    return best_path((features @ model.emit).tolist(), model)


def best_path(score: list[list[float]], model: LineModel) -> list[int]:
    """The likeliest labels of lines with these scores of (boilerplate, content)."""
    (bb, bc), (cb, cc) = model.move.tolist()
    back: list[tuple[int, int]] = []
    b, c = score[0]
    for sb, sc in score[1:]:
        from_b, from_c = int(c + cb >= b + bb), int(c + cc >= b + bc)
        b, c = (c + cb if from_b else b + bb) + sb, (c + cc if from_c else b + bc) + sc
        back.append((from_b, from_c))
    labels = [int(c >= b)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def weak_labels(lines: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """Labels of the lines of each document, from (quality, hashes of lines)."""
    around: dict[int, set[tuple[int, int]]] = {}
    for _, own in lines:
        beside = [0, *own.tolist(), 0]
        for before, line, after in zip(beside, beside[1:-1], beside[2:]):
            around.setdefault(line, set()).add((before, after))

    def repeated(line: int) -> bool:
        # as many other lines before it, and after it
        return all(len({x[i] for x in around[line]}) >= REPEATED for i in (0, 1))

    return [np.array([q and not (len(own) > FEW_LINES and repeated(x)) for x in own.tolist()], dtype=np.int64) for q, own in lines]


def train_line_model(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> LineModel | None:
    """A CRF from at most ``sample_docs`` labelled documents of each quality, those whose ids hash lowest.

    They are taken whole, in that order, while they have ``sample_lines`` lines
    together; one that has too many is passed over for the next.  Where all of a
    quality have too many, a warning says so.
    """
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    sizes = docs.select("doc_id", lines.alias("lines")).filter("lines IS NOT NULL").groupBy("doc_id").agg(F.sum("lines").alias("lines"))
    quality: dict[int, int] = {}
    for q in (0, 1):
        # those that could never be taken don't count against the number of documents
        fit = known.filter(F.col("quality") == q).join(sizes.filter(F.col("lines") <= sample_lines), "doc_id")
        left = sample_lines
        for doc_id, n in fit.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "lines").limit(sample_docs).collect():
            if n <= left:
                quality[doc_id] = q
                left -= n
        if left == sample_lines and not known.filter(F.col("quality") == q).join(sizes, "doc_id").isEmpty():
            warnings.warn(f"every labelled document of quality {q} has more than {sample_lines} lines: none of them is learned from", stacklevel=2)
    if not quality:
        return None

    def features(x: dict[str, list]) -> dict[str, object]:
        lines = [_worded((t or "").split("\n")) for t in x["text"]]
        rows = [(d, line_features(y).astype(np.uint8).tobytes(), np.array([xxhash.xxh3_64_intdigest(z) >> 1 for z in y], np.int64).tobytes()) for d, y in zip(x["doc_id"], lines) if y]
        return {"doc_id": [r[0] for r in rows], "features": [r[1] for r in rows], "hashes": [r[2] for r in rows]}

    picked = docs.select("doc_id", "text").filter(F.col("doc_id").isin(list(quality)))
    got = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in map_batches(picked, features, "doc_id long, features binary, hashes binary").collect())
    gold = weak_labels([(quality[d], np.frombuffer(h, np.int64)) for d, _, h in got])
    model = fit_crf([(np.frombuffer(f, np.uint8).reshape(-1, N_FEATURES).astype(np.float32), y) for (_, f, _), y in zip(got, gold)])
    counts = dict(known.groupBy("quality").count().collect())
    return model and with_odds(model, counts.get(1, 1) / counts.get(0, 1))


def with_odds(model: LineModel, odds: float) -> LineModel:
    """The model for texts that are content ``odds`` times as often as boilerplate; it was fitted as if both were as often."""
    emit = model.emit.copy()
    emit[int(_SLOTS[-1]) + 2, 1] += np.log(odds)
    return LineModel(emit, model.move)


def _worded(lines: list[str]) -> list[str]:
    return [y for y in lines if y and not (y.isspace() and not y.translate(_TABLE))]


def repeated_words(hashes: np.ndarray, width: int = SHINGLE_WORDS) -> int:
    """How many words lie in windows of ``width`` words that the text has twice or more."""
    windows = rolling(hashes, width)
    if not len(windows):
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, dtype=np.int32)
    start = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judged(texts: list[str | None], hashes: WordHashes, model: LineModel | None, share: float) -> list[tuple]:
    """Each text's columns of :func:`quality_rules`, in their order; the lines of all texts are described together."""
    held, lines, sizes = [], [], []
    for text in texts:
        text = text or ""
        words = split_words(text)
        own = _worded(text.split("\n")) if words else []
        repeats = repeated_words(hashes.of(words)) if len(words) >= SHINGLE_WORDS else 0
        chars, symbols = len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS))
        held.append((len(words), chars, symbols, len(own) - len(set(own)), repeats, len(words) < 10 or 100 * repeats > 20 * len(words)))
        if own and model is not None:
            lines += own
            sizes.append(len(own))
    found = describe(lines, sizes)
    score, ink = (found.scores(model).tolist(), found.ink.tolist()) if model is not None else ([], [])
    out, at, left = [], 0, iter(sizes)
    for n, *counts, failed in held:
        content = 1.0 if n else 0.0
        if n and model is not None:
            end = at + next(left)
            weights = ink[at:end]
            content = sum(w for w, k in zip(weights, best_path(score[at:end], model)) if k) / sum(weights)
            at = end
        out.append((n, *counts, failed, content, not failed and content >= share))
    return out


def _judged_in_groups(texts: list[str | None], hashes: WordHashes, model: LineModel | None, share: float) -> list[tuple]:
    out, group, chars = [], [], 0
    for text in texts:
        group.append(text)
        chars += len(text or "")
        if chars >= GROUP_CHARS:
            out += judged(group, hashes, model, share)
            group, chars = [], 0
    return out + judged(group, hashes, model, share)


def quality_rules(docs: DataFrame, model: LineModel | None, share: float = CONTENT_SHARE) -> DataFrame:
    """Counts, ``base_failed``, ``content_share`` and ``kept`` for every row.  Nothing is shuffled."""

    def judge(x: dict[str, list], hashes: WordHashes) -> dict[str, object]:
        rows = [(doc, *r) for doc, r in zip(x["doc_id"], _judged_in_groups(x["text"], hashes, model, share))]
        return dict(zip(_COLUMNS, zip(*rows))) if rows else {c: [] for c in _COLUMNS}

    return map_batches(docs.select("doc_id", "text"), judge, _RULES, state=WordHashes)


def keep_good(docs: DataFrame, model: LineModel | None, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns.  The text decides, so rows are filtered as they pass."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            stays = [r[-1] for r in _judged_in_groups(batch.column(place).to_pylist(), hashes, model, share)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
_COLUMNS = [c.split()[0] for c in _RULES.split(", ")]
