"""Cases in which text, ids or lines were once lost or took time with the square of their number."""

import collections
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import language_id, ngram_join, quality, secrets, token_files

from .test_operators import made


def test_texts_of_an_id_stay_or_go_by_their_own_links(spark):
    words = [[f"w{k}x{i}" for i in range(60)] for k in range(3)]
    a, b, c = (" ".join(w) for w in words)
    rows = [(3, a), (7, f"{a} more"), (7, b), (9, c), (11, f"{b} more")]
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each_class(made(spark, rows)).select("doc_id", "text").collect())
    assert got == collections.Counter([(3, a), (7, b), (9, c)])


def spans_and_cut(spark, rows):
    found = secrets.secret_spans(made(spark, rows, 1))
    return found.select("row.doc_id", secrets.spelled(F.col("spans")).alias("s"), F.size("spans").alias("n"), secrets.redacted(F.coalesce("row.text", F.lit("")), F.col("spans")).alias("cut"))


def test_many_spans_take_time_in_proportion(spark):
    r = random.Random(7)
    text = lambda n: " ".join("".join(r.choice("0123456789abcdef") for _ in range(20)) for _ in range(n))
    spans_and_cut(spark, [(1, text(100))]).collect()
    took = {}
    for n in (5_000, 100_000):
        began = time.time()
        (row,) = spans_and_cut(spark, [(1, text(n))]).collect()
        took[n] = time.time() - began
        assert row.n == n and row.cut == " ".join(["[SECRET]"] * n)
    assert took[100_000] < 20


def test_spans_over_borders_of_pieces(spark):
    r = random.Random(9)
    for size in (secrets._PIECE - 30, secrets._PIECE, 2 * secrets._PIECE - 1, 3 * secrets._PIECE):
        lead = "".join(r.choice("xyzé \U0001f600\n") for _ in range(size))
        text = f"{lead} {'0af9' * 5} middle {'1b' * 700} {lead} {'77ac' * 6}"
        (row,) = spans_and_cut(spark, [(1, text)]).collect()
        want, at = "", 0
        for x in row.s.split(","):
            _, a, b = x.split(":")
            if int(a) >= at:
                want += text[at : int(a)] + "[SECRET]"
            at = max(at, int(b))
        assert row.n >= 3 and row.cut == want + text[at:]


def test_random_characters_around_a_repeated_one_are_a_secret(spark):
    key = "kD83HFke92ksKE83jfKSLe93kfGH20QwZx71VbNm"
    rows = [(1, f"{key}AAAAAAAA{key}"), (2, f"{key[:10]}AAAAAAAA{key[:10]}"), (3, f"{key}example"), (4, f"my{key[:15]}example")]
    assert {r.doc_id: r.n for r in spans_and_cut(spark, rows).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_words_that_do_not_fit_are_passed_over(spark):
    counts = collections.Counter({b"the": 5, b"x" * 70_000: 3, b"and": 2, b"of": 1})
    assert language_id.word_dictionary(counts) == b" of and the "
    rows = [(i, ("漢字仮名" * 40 + f"{i} ") * 3) for i in range(60)]
    learned = language_id.learn_dictionaries(made(spark, rows).withColumn("lang", F.lit("zh")))
    assert "漢字仮名".encode() in learned["zh"] and max(map(len, learned["zh"].split())) <= 4 * language_id.LONGEST_WORD


def lined(n, q, seed):
    """Lines of random words, calm ones or shouted ones full of symbols."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    line = (lambda: " ".join(word() for _ in range(12)) + ".") if q else (lambda: " ".join(f"${word().upper()}#%" for _ in range(3)))
    return "\n".join(line() for _ in range(n))


def test_long_labelled_documents_are_learned_from(spark):
    rows = [(i, lined(70, i % 2, i)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train_line_model(made(spark, rows), labels)
    assert model is not None
    got = {r.doc_id: r.kept for r in quality.quality_rules(made(spark, [(100, lined(70, 1, 100)), (101, lined(70, 0, 101))]), model).collect()}
    assert got[100] and not got[101]


def test_a_sample_that_has_no_documents_says_so(spark):
    rows = [(i, lined(70, i % 2, i)) for i in range(10)] + [(10, lined(3, 0, 10))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="quality 1"):
        assert quality.train_line_model(made(spark, rows), labels, sample_lines=50) is None


def test_the_smallest_id_and_no_id_are_told_apart(spark, tmp_path):
    low = -(2**63)
    rows = [(low, "smallest"), (None, "none"), (None, ""), (0, "zero"), (2**63 - 1, "greatest")]
    path = str(tmp_path / "files")
    tok = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(made(spark, rows), path, tok, end_id=2)
    read = token_files.read_token_files(spark, path).collect()
    assert collections.Counter(r.doc_id for r in read) == collections.Counter(d for d, _ in rows)
    size = {d: len(r.ids) for d in (low, 0) for r in read if r.doc_id == d}
    some = token_files.read_token_files(spark, path, [0, low, *range(5, 4000)]).collect()
    assert {r.doc_id: len(r.ids) for r in some} == size


def test_documents_of_white_space_go_after_line_dedup(spark):
    rows = [(1, "\t\n\t"), (2, " \n\x0b"), (3, "a b"), (4, None), (5, "")]
    assert [r.doc_id for r in corpus_pipeline.line_stage(spark, made(spark, rows), "").collect()] == [3]


def test_scans_carry_their_state_over_runs(spark):
    n = 3 * secrets._RUN + 7
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("items"))
    done = secrets._scan(F.col("items"), F.lit(0), lambda s, x: (s + x, s + x), "int")
    (row,) = df.select(done["out"].alias("out"), done["state"].alias("last"), secrets._scan(F.array().cast("array<int>"), F.lit(5), lambda s, x: (s + x, x), "int")["state"].alias("none")).collect()
    assert row.out == np.cumsum(np.arange(1, n + 1)).tolist() and row.last == row.out[-1] and row.none == 5


def test_few_edges_are_connected_by_few_tasks(spark):
    edges = spark.range(2000).selectExpr("id + 1 AS a", "id AS b").repartition(40)
    met = ngram_join._contracted(edges, 2000)
    assert met.rdd.getNumPartitions() == ngram_join.LEAST_PARTS
    assert ngram_join._contracted(edges, 10 * ngram_join.PART_EDGES + 1).rdd.getNumPartitions() == 11
    roots = ngram_join.components(edges, "test-few")
    assert roots.count() == 2001 and {r.root for r in roots.select("root").distinct().collect()} == {0}


def test_texts_of_no_group_are_passed_over_before_they_are_joined(spark, monkeypatch):
    words = [[f"w{k}x{i}" for i in range(60)] for k in range(400)]
    rows = [(k, " ".join(w)) for k, w in enumerate(words)] + [(1000 + k, f"{' '.join(words[k])} more") for k in range(5)]
    left = []
    passed_over = ngram_join.maybe_in

    def counted(*args):
        left.append(passed_over(*args))
        return left[-1]

    monkeypatch.setattr(ngram_join, "maybe_in", counted)
    got = {r.doc_id: r.class_id for r in ngram_join.ngram_join(made(spark, rows)).filter("n_links > 0").collect()}
    assert got == {x: k for k in range(5) for x in (k, 1000 + k)}
    assert left and all(10 <= x.count() < 40 for x in left)
