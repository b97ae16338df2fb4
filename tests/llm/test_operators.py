"""Each operator against a plain version of itself, and against awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import bpe, exact_dedup, language_id, line_dedup, ngram_join, packing, quality, secrets, substring_dedup, token_files

SPACE = r"[\x20\x09-\x0D]"
#: Nulls, empty and blank texts, ties, repeated rows, characters outside the usual planes, a long text.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (None, None), (6, "a b"), (7, "ab "), (8, "\U0001f600 é x\u0000y"),
    (9, "word " * 3000), (10, "\n\n\n\n"), (11, "x\ny\nz\nx\ny\nz"), (12, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (13, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (14, "<|endoftext|> 'll  don't   \n\n  x"), (15, "y" * 5000),
]


def made(spark, rows, parts=3):
    """Rows with more columns, of names the operators use themselves."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame(rows, schema).repartition(parts)
    extra = {c: F.lit(None).cast("string") for c in ("row", "print", "digest", "size", "node", "rep", "spans", "gone", "a", "class_id", "kept", "at_id", "key", "ids")}
    return df.withColumns(extra | {"lang": F.lit("xx"), "n_chars": F.length("text").cast("long")})


def corpus(n=220, seed=5):
    """Random texts with copies, near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(400)]
    shared = [" ".join(r.choices(vocabulary, k=30)) for _ in range(6)]
    lines = [" ".join(r.choices(vocabulary, k=6)) for _ in range(12)]
    texts = []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            t = r.choice(texts)
        elif texts and kind < 0.45:
            words = re.split("( |\n)", r.choice(texts))
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            t = "".join(words)
        else:
            words = r.choices(vocabulary, k=r.randint(1, 120))
            if r.random() < 0.5:
                words.insert(r.randrange(len(words)), r.choice(shared))
            t = "".join(w + r.choice([" ", " ", " ", " ", "\n", "  "]) for w in words)
            if r.random() < 0.3:
                k = r.randrange(len(lines) - 3)
                t += "\n" + "\n".join(lines[k : k + r.randint(3, 5)])
        texts.append(t)
    ids = r.sample(range(10 * n), n)
    return list(zip(ids, texts)) + AWKWARD


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return made(spark, rows).cache()


@pytest.fixture(params=[3, 10_000])
def batches(spark, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, before)


def test_empty_tables(spark):
    none = made(spark, [])
    tok, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df in (
        exact_dedup.exact_dedup(none), bpe.encode_digests(none, ranks, public_tokenizers.PATTERN), substring_dedup.substring_dedup(none), line_dedup.line_dedup(none),
        secrets.secret_spans(none), ngram_join.ngram_join(none), language_id.predict_language(none, {}), packing.pack(none, tok), quality.quality_rules(none, None),
    ):
        assert df.count() == 0
    assert language_id.learn_dictionaries(none) == {}


def test_exact_dedup(docs, rows):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[re.sub(SPACE, "", text or "")].append((-len(text or ""), math.inf if doc is None else doc, doc))
    want = collections.Counter()
    for held in groups.values():
        held.sort(key=lambda x: x[:2])
        for i, (_, _, doc) in enumerate(held):
            want[doc, held[0][2], len(held), i == 0] += 1
    assert got == want


def test_dedup_digests_keep_every_row(docs, rows):
    """Null and repeated ids, with equal and with other texts."""
    digest = lambda t: hashlib.sha256(re.sub(SPACE, "", t or "").encode()).hexdigest()
    got = exact_dedup.dedup_digests(docs).collect()
    assert collections.Counter((r.doc_id, r.text_sha256) for r in got) == collections.Counter((d, digest(t)) for d, t in rows)
    sizes = collections.Counter(digest(t) for _, t in rows)
    assert all(r.group_size == sizes[r.text_sha256] for r in got)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter(list(sizes))


def test_text_digests(docs, rows):
    got = collections.Counter((r.doc_id, r.text_sha256) for r in exact_dedup.text_digests(docs).collect())
    assert got == collections.Counter((d, hashlib.sha256(re.sub(SPACE, "", t or "").encode()).hexdigest()) for d, t in rows)


def test_byte_bpe(docs, rows):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, path, public_tokenizers.PATTERN).collect())
    want = collections.Counter()
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want


def test_chunk_cache_may_be_full():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = bpe.library_encoder(path)
    small = bpe.ChunkEncoder(whole.encode_chunks, limit=3, group_chars=10)
    texts = ["a b  c", "d e f g", " a", "", None, "b  ", "\n x"]
    assert small.encode(texts) == whole.encode(texts)


def brute_substring(rows, window=13):
    low = {}
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                low[key] = min(d, low.get(key, d))
    out = collections.Counter()
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if low[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        out[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def test_substring_dedup(docs, rows, batches):
    got = collections.Counter(tuple(r) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == brute_substring(rows)


def test_substring_dedup_compares_within_small_batches(spark, rows, monkeypatch):
    """Many tiny batches: entries of one prefix come from several, branching or not."""
    for parts in (1, 40):
        got = collections.Counter(tuple(r) for r in substring_dedup.substring_dedup(made(spark, rows, parts)).collect())
        assert got == brute_substring(rows)


@pytest.mark.parametrize("batch_rows", [1, 3, 10_000])
def test_substring_dedup_of_passages_repeated_inside_a_document(spark, batch_rows):
    """The smaller holder is in another task, and a prefix branches only across tasks and Arrow batches."""
    word = lambda *x: "w" + "x".join(map(str, x))
    rows = []
    for n in (13, 14, 20, 40):
        p, x, y = ([word(n, k, i) for i in range(n)] for k in range(3))
        rows += [(5 + n * 10, " ".join(x + p + y + x + p)), (3 + n * 10, " ".join(y[::-1] + p)), (7 + n * 10, " ".join(x + p + p + x + p + y))]
    docs = made(spark, rows, 1)
    one_each = docs.repartitionByRange(len(rows), "doc_id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        got = collections.Counter(tuple(r) for r in substring_dedup.substring_dedup(one_each).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_substring(rows)


def test_substring_dedup_of_other_texts_with_one_id(spark):
    words = [[f"w{k}x{i}" for i in range(200)] for k in range(3)]
    rows = [(3, " ".join(words[0][:100])), (7, " ".join(words[0][:100])), (7, " ".join(words[1])), (7, " ".join(words[2][:50] + words[0][:60])), (9, " ".join(words[1][20:90]))]
    for parts in (1, 5):
        got = collections.Counter(tuple(r) for r in substring_dedup.substring_dedup(made(spark, rows, parts)).collect())
        assert got == brute_substring(rows)


def test_anchors_are_those_of_the_window():
    r = np.random.default_rng(1)
    values = r.integers(0, 5, 200).astype(np.uint64)
    from factloom.llm.common import Ranges

    low, at = substring_dedup.anchors(Ranges(values), len(values))
    grams = Ranges(values).width(5, seed=1)
    for i in range(len(at)):
        own = grams[i : i + 9]
        assert at[i] == i + int(own.argmin()) and low[i] == own.min()


def test_line_dedup(docs, rows):
    got = collections.Counter((r.row.doc_id, r.row.text, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs).collect())
    prints = {r.text: r.p for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    seen, gone = set(), collections.defaultdict(set)
    for d, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, prints[x[1]])):
        lines = (t or "").split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(" \t\n\x0b\x0c\r") for x in w):
                if w in seen:
                    gone[d, t] |= {i, i + 1, i + 2}
                seen.add(w)
    want = collections.Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        want[d, t, len(lines), len(gone[d, t]), "\n".join(x for i, x in enumerate(lines) if i not in gone[d, t])] += 1
    assert got == want


SECRETS = [
    "password = 'abcdefghijkl'", "token=secret=abcdefghijklm", "token: secret: abcdefghijklmnop", 'PassWord:"xxxxxxxxxxxxxxx1" and api_key=short api-key', "AKIA" + "A" * 14 + " AKIAKIA" + "B" * 20,
    "é\U0001f600 0123456789abcdef0 deadbeef", "x" * 50 + "9", "kd83HFke92ksKE83jfKSLe93kfGH20 fine", "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3A= end",
    "DEADBEEF01234567ABCDEF98DEADBEEF76543210 secret: DEADBEEF01234567ABCDEF98DEADBEEF76543210", "EXAMPLEm9vYmFyMTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1", "aQ1-" * 12,
]


def entropy(text, width):
    best = 0.0
    for i in range(len(text) - width + 1):
        w = text[i : i + width]
        best = max(best, -sum(w.count(c) / width * math.log2(w.count(c) / width) for c in set(w)))
    return round(best, 6)


def test_secrets(spark, rows):
    rows = rows + [(10**6 + i, t) for i, t in enumerate(SECRETS)]
    got = collections.Counter((r.row.doc_id, r.row.text, r.s, r.cut) for r in secrets.secret_spans(made(spark, rows)).select(
        "row", secrets.spelled(F.col("spans")).alias("s"), secrets.redacted(F.coalesce("row.text", F.lit("")), F.col("spans")).alias("cut")).collect())
    kind = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    want = collections.Counter()
    for d, t in rows:
        text = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({kind})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        more = set()
        for _, chars, width, least in secrets.CLASSES:
            for m in re.finditer(f"[{chars}]+", text):
                if len(m[0]) >= width and re.search("[0-9]", m[0]) and not any(re.search(p, m[0]) for p in secrets.ALLOW) and entropy(m[0], width) >= least:
                    if not any(a < m.end() and m.start() < b for a, _, b in spans):
                        more.add((m.start(), 3, m.end()))
        spans = sorted([*spans, *more])
        cut, at = "", 0
        for a, _, b in spans:
            if a >= at:
                cut += text[at:a] + "[SECRET]"
            at = max(at, b)
        want[d, t, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans), cut + text[at:]] += 1
    assert got == want
    assert any("entropy" in k[2] for k in want)


def test_entropy_spans_that_base_spans_cover_in_part(spark):
    key = "kD83HFke92ksKE83jfKSLe93kfGH20QwZx71VbNm"
    texts = {f"id 1234567890123456789-{key}, end": "hex:3:22,entropy:3:63", f"{'0af9' * 5}/{key}": "hex:0:20,entropy:0:61", f"{key}-{'0af9' * 5}": "entropy:0:61,hex:41:61",
             f"AKIA{'B7' * 8}{key} x": "access:0:20,entropy:0:60", f"secret: {key}": "assign:0:48"}
    found = secrets.secret_spans(made(spark, list(enumerate(texts)))).select("row.text", secrets.spelled(F.col("spans")).alias("s"), secrets.redacted(F.col("row.text"), F.col("spans")).alias("cut")).collect()
    assert {r.text: r.s for r in found} == texts
    assert not any(key in r.cut for r in found)


def brute_join(rows, threshold=0.8):
    sets = {}
    for d, t in dict.fromkeys(rows):
        if d is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[d, t] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    times = collections.Counter(r for r in rows if r[0] is not None)
    links, root = collections.Counter(), {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for ((a, sx), x), ((b, sy), y) in itertools.combinations(sets.items(), 2):
        if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
            links[a, sx] += times[b, sy]
            links[b, sy] += times[a, sx]
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    out = collections.Counter()
    for r in rows:
        copies = times[r] - 1 if r in sets and sets[r] else 0
        out[r[0], find(r[0]) if r in sets else r[0], links[r] + copies] += 1
    return out


@pytest.mark.parametrize(("block", "block_shingles"), [(1024, 1 << 20), (5, 1 << 20), (1024, 40)])
def test_ngram_join(docs, rows, block, block_shingles):
    done = ngram_join.ngram_join(docs, block=block, block_shingles=block_shingles)
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in done.collect())
    assert got == brute_join(rows)


def test_one_of_each_class(docs, rows):
    """Of each class of linked texts one stays, of its smallest id; texts are told apart, not ids."""
    kept = ngram_join.one_of_each_class(docs)
    assert kept.columns == docs.columns
    shingles = {}
    for d, t in dict.fromkeys(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if d is not None and w:
            shingles[d, t] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    classes = [{x} for x in shingles]
    for x, y in itertools.combinations(shingles, 2):
        a, b = shingles[x], shingles[y]
        if len(a & b) >= 0.8 * len(a | b) - 1e-9:
            one, two = (next(c for c in classes if z in c) for z in (x, y))
            if one is not two:
                classes.remove(two)
                one |= two
    got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    for c in classes:
        stays = {x for x in got if x in c}
        assert len(stays) == 1 and next(iter(stays))[0] == min(d for d, _ in c)
    times, found = collections.Counter(rows), collections.Counter(got)
    assert all(found[x] == times[x] for x in found)
    assert all(found[x] == times[x] for x in times if x not in shingles)


def test_one_of_each_class_keeps_every_other_text(spark):
    """Texts without an id, and texts that share one, count by themselves."""
    words = [[f"w{k}x{i}" for i in range(60)] for k in range(6)]
    text = [" ".join(w) for w in words]
    near = [" ".join(w[:-1]) for w in words]
    keep = [(None, text[0]), (None, text[1]), (None, text[0]), (7, text[2]), (7, text[2]), (7, text[3]), (3, near[4]), (8, None), (8, ""), (8, " \n"), (1, text[5]), (None, None)]
    drop = [(9, text[2]), (9, near[3]), (11, text[4]), (10, text[4]), (2, near[5])]
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each_class(made(spark, keep + drop)).select("doc_id", "text").collect())
    assert got == collections.Counter(keep)


def test_matched_depth():
    k = ngram_join.matched_depth(0.8, 24, 8, 0.999)
    assert 1 - (1 - 0.8**k) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** 24


def test_compare_cell_counts_both_ways():
    r = np.random.default_rng(3)
    base = r.choice(10_000, 300, replace=False)
    sets = [np.unique(np.concatenate([base[r.random(300) > 0.05], r.integers(10_000, 20_000, r.integers(0, 30))])).astype(np.uint64) for _ in range(60)]
    a, b = np.arange(30), np.arange(20, 60)
    got = ngram_join.compare_cell(sets, a, b, 0.8)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s, t = set(sets[x].tolist()), set(sets[y].tolist())
            assert got[i, j] == (x != y and len(s & t) >= 0.8 * len(s | t) - 1e-9)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language_id.learn_dictionaries(docs)
    found = language_id.predict_language(docs, learned)
    rows = found.join(docs, "doc_id").filter(language_id.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_texts(docs, rows):
    learned = {"xx": b" ab cd ef word one two ", "yy": b" zz qq rr "}
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict_language(docs, learned).collect()}
    for d, t in AWKWARD:
        if t is None or not any(c.isalpha() for c in t):
            assert (d, "und") in got
    assert {p for _, p in got} <= {"xx", "yy", "und"}
    assert {r.lang_pred for r in language_id.predict_language(docs, {}).collect()} == {"und"}


def test_token_files(spark, docs, rows, tmp_path):
    path, tok = str(tmp_path / "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(docs, path, tok, end_id=2, docs_per_shard=40)
    read = token_files.read_token_files(spark, path)
    got = read.orderBy("start").collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tok)
    model.encode_special_tokens = True
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (d, t) in zip(got, want, strict=True):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, bytes(r.ids)) == (d, at, ids)
        at += len(ids) // 4
    some = [w[0] for w in want if w[0] is not None][::50]
    few = {(r.doc_id, r.start, bytes(r.ids)) for r in token_files.read_token_files(spark, path, some).collect()}
    assert few == {(r.doc_id, r.start, bytes(r.ids)) for r in got if r.doc_id in some}
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.id_digests(read).collect()}
    assert all(digests[r.doc_id, r.start] == zlib.crc32(bytes(r.ids)) for r in got)


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(made(spark, []), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing(docs, rows):
    tok = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, tok).collect()
    encoder = bpe.library_encoder(tok)
    want = collections.Counter((d, encoder.encode([t])[0] + bytes(4)) for d, t in rows)
    sequences, whole = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        sequences[p.sequence_id].append(p)
        whole[p.doc_id, p.doc_tokens] += p.length
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and {p.sequence_tokens for p in held} == {at}
    tokens = collections.Counter()
    for (d, ids), n in want.items():
        tokens[d, len(ids) // 4] += n * len(ids) // 4
    assert whole == tokens
    unique = {d: ids for d, ids in want if sum(1 for x, _ in want if x == d) == 1 and want[d, ids] == 1}
    parts = collections.defaultdict(list)
    for p in pieces:
        parts[p.doc_id].append((p.start, bytes(p.ids)))
    for d, ids in unique.items():
        assert b"".join(x for _, x in sorted(parts[d])) == ids
    # padding, at most one short sequence a worker and a twentieth of the others
    pad = sum(0 if n & (n - 1) == 0 else 1024 - n for n in ({p.sequence_id: p.sequence_tokens for p in pieces}).values())
    assert pad <= 0.05 * sum(p.length for p in pieces) + 1024 * len({p.sequence_id // packing.WORKER_SPAN for p in pieces})


def test_packing_of_short_documents(spark):
    """Sequences of documents of 1 to 30 ids are full but for the last one."""
    tok, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    rows = [(i, " ".join(["the"] * r.randint(0, 29))) for i in range(3000)]
    encoder = bpe.library_encoder(tok)
    pieces = packing.pack(made(spark, rows, 1), tok).collect()
    sizes = {p.sequence_id: p.sequence_tokens for p in pieces}
    assert sorted(sizes.values())[1:] == [1024] * (len(sizes) - 1)
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        parts[p.doc_id].append((p.start, bytes(p.ids)))
    for i, held in sequences.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == sizes[i]
    assert {i: b"".join(x for _, x in sorted(parts[i])) for i, _ in rows} == {i: encoder.encode([t])[0] + bytes(4) for i, t in rows}


def test_cut_lengths():
    for n in range(1, 5000):
        cut = packing.cut_lengths(n)
        assert sum(cut) == n and all(0 < x <= 1024 for x in cut)
        assert len(cut) <= n // 1024 + 4


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, hit = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_base(docs, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs, None).collect())
    assert got == collections.Counter((d, *brute_rules(t)) for d, t in rows)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(2)
    for n in range(1, 9):
        model = quality.LineModel(r.normal(size=(quality.N_FEATURES, 2)), r.normal(size=(2, 2)))
        x = r.integers(0, 2, (n, quality.N_FEATURES)).astype(np.float32)
        score = x @ model.emit
        total = lambda y: sum(score[i, k] for i, k in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:]))
        assert total(quality.viterbi(x, model)) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=n))))


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.quality_rules(docs, quality.train_line_model(docs, labels)).join(labels, "doc_id").collect()
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    bad = [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_line_features_of_odd_lines():
    for line in ("x", "É", "   ", "a\x1cb", "ÀÉ × Þ", "|" * 50):
        assert quality.line_features([line, line]).shape == (2, quality.N_FEATURES)
    assert quality.line_features([]).shape == (0, quality.N_FEATURES)
