"""Long texts, repeated and missing ids, small groups, and the models' verdicts done plainly."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, exact_dedup, language_id, line_dedup, ngram_join, packing, quality, secrets, substring_dedup, token_files

from .test_operators import AWKWARD, SPACE, brute_join, brute_substring, corpus, made

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def rows():
    return corpus(110, seed=11)


@pytest.mark.parametrize("group", [2])
def test_substring_dedup_of_lengthened_prefixes(spark, rows, group):
    for parts in (1, 7):
        got = collections.Counter(tuple(r) for r in substring_dedup.substring_dedup(made(spark, rows, parts), group_suffixes=group).collect())
        assert got == brute_substring(rows)


def test_maximal_repeats(spark, rows):
    found = collections.defaultdict(set)
    unique = [r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    for r in substring_dedup.maximal_repeats(made(spark, unique)).collect():
        assert r.length >= 13 and not {r.start - 1, r.start + r.length} & found[r.doc_id]
        found[r.doc_id] |= set(range(r.start, r.start + r.length))
    kept = collections.Counter()
    for d, t in unique:
        w = re.findall(WORD, t or "")
        kept[d, len(w), len(found[d]), " ".join(x for i, x in enumerate(w) if i not in found[d])] += 1
    assert kept == brute_substring(unique) and any(found.values())


def test_suffix_order_gives_shared_prefixes():
    r = np.random.default_rng(4)
    right = r.integers(0, 2, (200, 13))
    order, shared = substring_dedup.suffix_order(right)
    assert [tuple(x) for x in right[order]] == sorted(map(tuple, right))
    for a, b, n in zip(right[order], right[order][1:], shared[1:]):
        assert n == next((i for i in range(13) if a[i] != b[i]), 13)


def test_blank_windows_of_any_white_space_stay(spark):
    rows = [(1, "\t\n \x0b\n\r\n\t\n \x0b\n\r"), (2, "\t\n \x0b\n\r"), (3, "a\n\t\n b"), (4, "a\n\t\n b")]
    got = {r.row.doc_id: r.n_removed for r in line_dedup.line_dedup(made(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 3}


def test_exact_dedup_of_extreme_ids(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "a b"), (high, "a b"), (0, "ab"), (high, "z"), (low, "z"), (None, "z")]
    got = {(r.doc_id, r.group_size, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(made(spark, rows)).collect()}
    assert got == {(low, 3, low, True), (high, 3, low, False), (0, 3, low, False), (high, 3, low, False), (low, 3, low, True), (None, 3, low, False)}


def test_drop_copies(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (4, " a  b "), (5, None), (6, " ")]
    kept = exact_dedup.drop_copies(made(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6]
    assert set(kept.columns) == set(made(spark, rows).columns)


def test_entropy_of_a_long_candidate_takes_time_in_proportion(spark):
    r = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    times = []
    for n in (1000, 50_000, 200_000):
        text = "".join(r.choice(letters) for _ in range(n))
        start = time.time()
        found = secrets.secret_spans(made(spark, [(1, text), (2, text), (None, text)], 1)).select(secrets.spelled(F.col("spans")).alias("s")).collect()
        times.append(time.time() - start)
        assert [x.s.split(",")[0] for x in found] == [f"entropy:0:{n}"] * 3
    assert times[2] < 12 * times[1] + 20


def test_allow_list_of_long_candidates(spark):
    rows = [(1, "ab-" * 100_000 + "x9"), (2, "0123456789" * 50_000 + "abcdef"), (3, "9" * 300_000)]
    found = secrets.secret_spans(made(spark, rows)).collect()
    assert all(s.kind == 2 for r in found for s in r.spans)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_recall_of_the_forest(spark, rows, threshold):
    got = {(r.doc_id, r.print): r.n_links for r in ngram_join.ngram_join(made(spark, rows), threshold=threshold).collect()}
    want = brute_join(rows, threshold)
    found, there = sum(got.values()), sum(n for (_, _, n), c in want.items())
    assert found >= 0.99 * there and there


def test_prefixes_are_shortened_until_the_recall_is_met(spark):
    """Few trees start with a prefix of which many links are lost; what is found says so."""
    r = random.Random(8)
    rows, doc = [], 0
    for _ in range(80):
        words = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(2):
            mine = list(words)
            for i in r.sample(range(len(mine)), 1):
                mine[i] = f"x{r.randrange(10**6)}"
            rows.append((doc, " ".join(mine)))
            doc += 1
    docs = made(spark, rows)
    there = sum(n for (_, _, n), c in brute_join(rows).items())
    links = lambda recall: sum(x.n_links for x in ngram_join.ngram_join(docs, trees=2, start=0.3, recall=recall).collect())
    assert there and links(0.1) < 0.9 * there and links(0.9999) >= 0.99 * there


def test_forest_joins_connect_nodes(spark):
    r = random.Random(2)
    labels = {i: [r.getrandbits(16) << 48 | r.getrandbits(2) << 8 * k for k in range(3)] for i in range(300)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, [signed(x) for x in v]) for i, v in labels.items()], "rep long, labels array<long>")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    joins = [tuple(x) for x in ngram_join.forest_joins(df, 1).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for depth in range(1, 9):
        def parts(pairs):
            root = {i: i for i in labels}
            for a, b in pairs:
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            out = {}
            for i in labels:
                j = i
                while root[j] != j:
                    j = root[j]
                out[i] = j
            return out

        nodes = collections.defaultdict(list)
        for i, v in labels.items():
            for tree, x in enumerate(v):
                nodes[tree, x >> 8 * (8 - depth)].append(i)
        assert parts((a, b) for a, b, n in joins if n >= depth) == parts((x[0], y) for x in nodes.values() for y in x[1:])


def test_language_by_plain_compression(spark, rows):
    learned = {"aa": b" ab cd ef the word one two ", "bb": b" zz qq rr jj hh ", "cc": b" aaa bbb ccc ddd eee "}
    docs = made(spark, rows)
    want = collections.Counter()
    for d, t in rows:
        if t is None or not any(c.isalpha() for c in t):
            want[d, "und", 0.0] += 1
            continue
        data, sizes = t.lower().encode(), []
        for name, content in learned.items():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            plain = lambda: zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)  # noqa: E731, B023
            sizes.append((sum(len(plain().compress(data[i : i + language_id.CHUNK_BYTES])) for i in range(0, len(data), language_id.CHUNK_BYTES)), name))
        (best, name), (second, _) = sorted(sizes)[:2]
        want[d, name, round((second - best) / second, 9)] += 1
    got = language_id.predict_language(docs, learned).collect()
    assert collections.Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got) == want
    assert all(r.accepted == (r.lang_pred != "und" and r.score >= language_id.MARGIN) for r in got)


def test_dictionaries_count_whole_texts(spark):
    late = "filler " * 3000 + "kestrel " * 5000
    rows = [(i, late if i % 2 else "vogel " * 50) for i in range(40)]
    docs = made(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    learned = language_id.learn_dictionaries(docs)
    assert learned == {"de": b" vogel ", "en": b" filler kestrel "}


def test_kept_by_plain_decoding(spark, rows):
    r = np.random.default_rng(6)
    model = quality.LineModel(r.normal(size=(quality.N_FEATURES, 2)), r.normal(size=(2, 2)))
    got = collections.Counter((x.doc_id, x.kept, round(x.content_share, 9)) for x in quality.quality_rules(made(spark, rows), model).collect())
    want = collections.Counter()
    for d, t in rows:
        lines = [y for y in (t or "").split("\n") if re.search(WORD, y)]
        words = re.findall(WORD, t or "")
        if not lines:
            want[d, False, 0.0] += 1
            continue
        score = quality.line_features(lines) @ model.emit
        if len(lines) <= 8:
            total = lambda y: sum(score[i, k] for i, k in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
            best = max(itertools.product((1, 0), repeat=len(lines)), key=total)
        else:
            best = quality.viterbi(quality.line_features(lines), model)
        ink = [len(re.sub(SPACE, "", y)) for y in lines]
        share = sum(n for n, k in zip(ink, best) if k) / sum(ink)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        times, hit = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            hit |= set(range(i, i + 5)) if times[g] > 1 else set()
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        want[d, not failed and share >= quality.CONTENT_SHARE, round(share, 9)] += 1
    assert got == want


def test_labels_change_within_a_text():
    notice, lines = 999, itertools.count(1)
    texts = [(1, np.array([next(lines), next(lines), notice, next(lines)])) for _ in range(quality.REPEATED)]
    copied = np.array([next(lines) for _ in range(5)])
    labels = quality.weak_labels([*texts, *[(1, copied)] * 9, (0, copied), (1, np.array([notice]))])
    assert [x.tolist() for x in labels] == [[1, 1, 0, 1]] * quality.REPEATED + [[1] * 5] * 9 + [[0] * 5, [1]]
    r = np.random.default_rng(0)
    gold = [np.array([1] * 6 + [0] * 6) for _ in range(40)] + [np.array([0] * 12) for _ in range(10)]
    made_up = []
    for y in gold:
        x = (r.random((12, quality.N_FEATURES)) < 0.1).astype(np.float32)
        x[np.arange(12), y] = 1
        made_up.append((x, y))
    model = quality.fit_crf(made_up)
    assert all(quality.viterbi(x, model) == y.tolist() for x, y in made_up)
    assert quality.fit_crf([(np.zeros((2, quality.N_FEATURES), np.float32), np.array([1, 1]))]) is None


def test_packed_ids_are_those_of_the_library(spark, rows):
    from tokenizers import Tokenizer

    tok = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(tok)
    model.encode_special_tokens = True
    unique = list({r[0]: r for r in rows if r[0] is not None}.values())
    parts = collections.defaultdict(list)
    for p in packing.pack(made(spark, unique), tok).collect():
        parts[p.doc_id].append((p.start, bytes(p.ids)))
    for d, t in unique:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        assert b"".join(x for _, x in sorted(parts[d])) == np.array(ids, "<u4").tobytes()


def test_caches_do_not_hold_long_chunks():
    encoder = bpe.library_encoder.__wrapped__(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"a {chr(0x4E00 + i) * 9000} b" for i in range(50)]
    assert len(encoder.encode(texts)) == 50
    assert all(len(x) <= encoder.SHORT for x in encoder.known)


def test_pieces_are_spread_over_the_whole():
    raw = bytes(range(256)) * 400
    pieces = token_files.spread_pieces(raw)
    assert len(pieces) == token_files.SAMPLE_PIECES and pieces[0] == raw[:1024] and raw.endswith(pieces[-1])
    assert b"".join(token_files.spread_pieces(raw[:5000])) == raw[:5000]


SF = "/root/testdata/sf0.001"


def test_pipeline_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert after.count() == 0, name
        if name != "packing":
            assert after.columns == docs.columns
            docs = after


def test_pipeline_stages_of_awkward_rows(spark):
    """Nulls, repeated ids with other texts, repeated rows, a very long text, columns of names the stages use."""
    r = random.Random(9)
    words = [[f"w{k}x{i}" for i in range(80)] for k in range(5)]
    long = " ".join(f"l{r.randrange(10**7)}" for _ in range(200_000))
    good = [(7, " ".join(words[0])), (7, " ".join(words[1])), (8, " ".join(words[2])), (8, " ".join(words[2])), (None, " ".join(words[3])), (None, " ".join(words[4])), (9, long)]
    docs = made(spark, [*good, *AWKWARD])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        texts = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
        assert not collections.Counter(good) - collections.Counter(texts), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    lengths = collections.Counter()
    for p in pieces:
        lengths[p.doc_id] += p.length
    assert lengths[9] == next(p.doc_tokens for p in pieces if p.doc_id == 9) > 200_000


def test_digest_of_kept_words(spark, rows):
    got = {(r.doc_id, r.kept_sha256) for r in substring_dedup.kept_digests(substring_dedup.substring_dedup(made(spark, rows))).collect()}
    assert got == {(d, hashlib.sha256(kept.encode()).hexdigest()) for d, _, _, kept in brute_substring(rows)}


def test_words_and_what_follows_them_are_encoded_as_the_library_would():
    from tokenizers import Tokenizer

    from factloom.llm.bpe import library_encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a b", " a", "can't don'ts", "xɐy zжa", "é́a b́", "a  b \n c", "", " a  ", "ÀĀ's ’s", "a a a", " a.", " Ab12 c3", "aʰ bʰc ƻx̀", " Wort.\nNeu wort.\nneu, wort"]
    library = Tokenizer.from_file(path)
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder = library_encoder(path)
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]  # all chunks are known now
