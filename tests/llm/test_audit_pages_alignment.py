"""Alignment, page extraction and filter audit against plain versions of themselves, and on awkward rows."""

import collections
import hashlib
import html
import itertools
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import alignment, filter_audit, html_extract
from factloom.llm.queries import PIECES, TOKENIZER

from .test_operators import AWKWARD, corpus, made

A, B = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)


# ---- alignment


def brute_alignment(rows):
    """Whole texts by both libraries, no segments."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    letters = alignment.byte_letters()
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, None))
            continue
        encoded = a_model.encode(f" {text}", add_special_tokens=False)
        a, b = encoded.ids, b_model.encode(text)
        spelled_a = [bytes(letters.index(c) for c in x) for x in encoded.tokens]
        pieces = [b_model.id_to_piece(i) for i in b]
        spelled_b = [bytes([int(x[3:5], 16)]) if b_model.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(b, pieces)]
        if not b"".join(spelled_a) == b"".join(spelled_b) == f" {text}".encode():
            found.append((doc_id, None))
            continue
        ends_a = {e: i for i, e in enumerate(itertools.accumulate(map(len, spelled_a)))}
        ends_b = {e: i for i, e in enumerate(itertools.accumulate(map(len, spelled_b)))}
        groups, links, i, j = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            x, y = ends_a[e], ends_b[e]
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            links.append((a[x], b[y]))
            i, j = x + 1, y + 1
        counts.update(links)
        found.append((doc_id, (len(a), len(b), len(groups), len(links), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = collections.Counter()
    for doc_id, x in found:
        row = (0, 0, 0, 0, 0, 0, "") if x is None else (*x[:4], sum(counts[l] == most[l[1]] for l in x[4]), sum(counts[l] for l in x[4]), x[5])
        out[(doc_id, *row)] += 1
    return out


def awkward_texts(n=400):
    r = random.Random(2)
    bits = [" ", " ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "foo", "bar.", "'s", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "▁", "é", "中文", "\U0001f600", "\x1c", "\x85", "​", "᠎", "();\r", "\x00", "\x0b"]
    return [(1000 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("chunk_chars", [2000, alignment.CHUNK_CHARS])
def test_alignment_of_segments_is_that_of_whole_texts(spark, chunk_chars):
    rows = AWKWARD + corpus(80, seed=3) + awkward_texts() + [(70, "z" * 3000), (71, " "), (72, "a "), (73, "one " * 1000)]
    got = alignment.alignment_digests(made(spark, rows, 5), A, B, chunk_chars)
    assert collections.Counter(map(tuple, got.collect())) == brute_alignment(rows)


def test_alignment_of_no_documents(spark):
    assert alignment.alignment_digests(made(spark, [(1, "x")]).filter("doc_id > 1"), A, B).collect() == []


def test_cuts_only_where_no_piece_goes_on():
    assert alignment.cut_characters(["▁a", "▁▁", "b"]) == " \n\t\x0b\x0c"
    assert alignment.cut_characters(["▁a", "b▁c", "\n\n", ")\t"]) == "\n\x0b\x0c"
    m = alignment.models(A, B)
    assert m.split("a b\n c();\r d e ") == [" a", " b", "\n c();\r d e".split(" d")[0] + "", " d e", " "] or m.split("a b") == [" a", " b"]
    for _, text in awkward_texts(100):
        assert "".join(m.split(text)) == f" {text}"


# ---- pages


def site(host, n, seed, body, least=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    rows, truth = [], {}
    for i in range(n):
        title = " ".join(r.choices(words, k=4))
        paragraphs = [" ".join(r.choices(words, k=r.randint(15, 40))) for _ in range(r.randint(least, least + 4))]
        page_id = seed * 1000 + i
        rows.append((page_id, f"http://{host}/{i}", body(r, i, title, paragraphs)))
        truth[page_id] = "\n".join([title, *paragraphs])
    return rows, truth


def plain_site(r, i, title, paragraphs):
    """No article element, no telling names: only the template shows where the text is."""
    ps = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<html><head><title>{title}</title></head><body><div class=x1><a href=/>Home</a> <a href=/b>Best of</a></div><div class=x2><h1>{title}</h1>{ps}"
        f"<div class=x9>Buy our things now</div></div><div class=x3>All rights reserved to us</div></body></html>"
    )


def marked_site(r, i, title, paragraphs):
    ps = "<br>".join(f"<p><b>{p}" for p in paragraphs)
    ads = '<div class="ad">buy this</div>' * (i % 3)
    said = "".join(f'<article class="comment"><p>{p}</p></article>' for p in paragraphs[:2])
    return f'<html><body><nav><ul><li><a href="/">one</a><li>two</ul></nav>{ads}<article><h1>{title}</h1>{ps}<form>name<input></form></article><section id="comments">{said}</section><footer>(c) {i}</footer>'


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "text": F.lit("y"), "region": F.lit(1)}).repartition(parts)


def test_template_finds_the_text_without_telling_names(spark):
    rows, truth = site("plain.example", 12, 1, plain_site)
    more, others = site("marked.example", 8, 2, marked_site)
    got = {r.page_id: r for r in html_extract.main_text(pages_of(spark, rows + more)).collect()}
    assert {i: got[i].text for i in truth} == truth
    assert {i: got[i].text for i in others} == others
    assert all(r.n_chars == len(r.text) for r in got.values())
    found = {r.host: set(r.notices) for r in html_extract.templates(html_extract.outlines(pages_of(spark, rows + more))).collect()}
    assert set(found) == {"plain.example", "marked.example"}


def test_pages_whatever_their_order_and_partitions(spark):
    rows, _ = site("plain.example", 12, 1, plain_site)
    once = sorted(map(tuple, html_extract.main_text(pages_of(spark, rows, 1)).collect()))
    assert once == sorted(map(tuple, html_extract.main_text(pages_of(spark, rows[::-1], 7)).collect()))


def test_few_pages_copies_and_shared_passages(spark):
    few, few_truth = site("few.example", 2, 3, marked_site)
    one, one_truth = site("copies.example", 1, 4, marked_site)
    copies = [(4000 + i, f"http://copies.example/{i}", one[0][2]) for i in range(9)]
    shared, shared_truth = site("shared.example", 9, 5, lambda r, i, t, ps: marked_site(r, i, t, [*ps, "this passage is in all articles of the site"]))
    got = {r.page_id: r.text for r in html_extract.main_text(pages_of(spark, few + copies + shared)).collect()}
    assert {i: got[i] for i in few_truth} == few_truth
    assert {got[i] for i, _, _ in copies} == set(one_truth.values())
    assert {i: got[i] for i in shared_truth} == {i: f"{t}\nthis passage is in all articles of the site" for i, t in shared_truth.items()}


def test_awkward_pages(spark):
    long = "word " * 50_000
    rows = [
        (1, None, None), (1, None, ""), (2, "no host", "just text"), (None, "http://h/", "<p>a"), (3, "http://h/", "<nav>menu</nav>"), (3, "http://h/", "<nav>menu</nav>"),
        (4, "//H.example:80/x", f"<article>{long}</article>"), (5, "http://h/", "<p>a &lt; b &amp;amp; c &nbsp; d &#233;&copy<p>x<b>y</b>z"),
        (6, "http://h/", "<BODY><MAIN><TABLE><TR><TD>1<TD>2<TR><TD>3</TABLE><pre>a\n  b</pre></MAIN>"), (7, "http://h/", "<article><p>1 < 2 and <3</p><!-- x <p> --><p title='a>b'>q<script>'</p>'</script>r</article"),
    ]
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_extract.main_text(pages_of(spark, rows)).collect())
    want = [(1, ""), (1, ""), (2, "just text"), (None, "a"), (3, ""), (3, ""), (4, long.strip()), (5, "a < b &amp; c d é©\nxyz"), (6, "1\n2\n3\na b"), (7, "1 < 2 and <3\nqr")]
    assert got == collections.Counter((i, t, len(t)) for i, t in want)
    assert html_extract.main_text(pages_of(spark, rows).filter("page_id > 99")).collect() == []


def test_layout_names_and_headers():
    t = html_extract.page_text
    assert t("<body class='has-sidebar'><div class='page with-nav'><div class=sidebar>s</div><article><header><h1>T</h1><p>by me</p></header><p>x</article></div>") == "T\nx"
    assert t("<body><div class='cookie-notice'>c</div><div>text <span class='ad'>buy</span> more</div><div hidden>h</div><div role=navigation>n</div>") == "text more"
    assert t("<body><p>kept: adapter header</p><div class='adapter shared'>kept too</div>") == "kept: adapter header\nkept too"
    assert t("<article><p>a</p><article><p>comment</p></article></article>") == "a"


def test_deep_and_broken_pages_take_time_in_proportion():
    assert html_extract.page_text("<div>" * 50_000 + "x") == "x"
    assert html_extract.page_text("<p><b>" * 30_000 + "x</i></p>" * 2) == "x\nx"
    assert html_extract.page_text('<a href="x' * 30_000) == ""


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*)</article>", r.html, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub("</?(?:b|br)>", " ", x)).split()) for x in blocks]
        want[r.page_id] = "\n".join(x for x in blocks if x)
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == want


# ---- filter audit


def brute_audit(rows, labels):
    """Each order run over all documents, filter by filter."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    low = {}
    for d, text, _ in rows:
        if d is not None:
            low[text or ""] = min(d, low.get(text or "", d))
    docs = collections.defaultdict(list)
    for d, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            f
            for f, hit in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), d is not None and d > low[text]))
            if hit
        }
        docs[source or ""].append((failed, d in good, d in toxic))
    out, shares = {}, collections.Counter()
    for part, items in docs.items():
        for order in itertools.permutations("ABCDE"):
            left = items
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                fails = [x for x in items if f in x[0]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(x[0] == {f} for x in fails), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shares[part, f] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("part", "mask", "low", "key0", "own")}).repartition(parts)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("y"))
    got = filter_audit.audit(filter_audit.mask_counts(filter_audit.failed_filters(docs), given)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


@pytest.fixture(scope="module")
def audit_rows():
    r = random.Random(8)
    rows = [(i, t, r.choice(["a", "b", None, ""])) for i, t in AWKWARD + corpus(150, seed=4)]
    rows += [(500 + i, (t or "").upper() + r.choice(["", "#"]), "a") for i, (_, t) in enumerate(corpus(40, seed=4))] + [(900 + i, "same " * 60 + "text", "hot") for i in range(50)]
    labels = [(i, r.choice([0, 1]), r.choice([0, 1])) for i in range(0, 900, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (12345, 1, 1)]
    return rows, labels


def test_audit_of_all_orders(spark, audit_rows):
    rows, labels = audit_rows
    got = audited(spark, rows, labels)
    assert got == brute_audit(rows, labels)
    assert len(got) == 600 * len({x[2] or "" for x in rows})


def test_texts_of_equal_keys_are_compared(spark, audit_rows, monkeypatch):
    """With blocks that say nothing, groups hold different texts and are split by the texts."""
    rows, labels = audit_rows
    monkeypatch.setattr(filter_audit, "_blocks", lambda text: [F.length(text).alias("key0"), F.lit(0).alias("key1")])
    unique = [(100_000 + i, t, s) for i, (_, t, s) in enumerate(rows)]
    assert audited(spark, unique, [(100_000 + (d or 0), q, t) for d, q, t in labels], 5) == brute_audit(unique, [(100_000 + (d or 0), q, t) for d, q, t in labels])


def test_refinement_drops_single_ids(spark):
    keys = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (2, 5, 2), (3, 5, 2), (None, 5, 2), (4, 6, 1)], "doc_id long, key0 int, key1 int")
    assert sorted(map(tuple, filter_audit.refined(keys).collect())) == [(2, 5, 2), (3, 5, 2)]


def test_audit_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(filter_audit.failed_filters(docs), labels)).collect() == []
