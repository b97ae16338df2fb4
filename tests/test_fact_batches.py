"""Batches of many tables: all at once or not at all, once however often they are written."""

import pytest
from pyspark.sql import functions as F

from factloom.sources import fact_batches as batches

from .test_access_links import SOURCES
from .test_code import SHOP

SCOPE = {"service_id": "s", "commit_sha": "c1"}


def table(spark, n, name="x"):
    return spark.range(n).select("id", F.lit(name).alias("name"))


def counts(spark, root, *names):
    return {n: batches.read_table(spark, root, n).count() for n in names}


def test_a_batch_fails_between_two_tables(spark, tmp_path):
    root = str(tmp_path / "facts")
    assert batches.write_batch(spark, root, "b1", SCOPE, {"one": table(spark, 3), "two": table(spark, 4)})
    broken = table(spark, 5).withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        batches.write_batch(spark, root, "b2", SCOPE, {"one": table(spark, 9), "two": broken})
    assert counts(spark, root, "one", "two") == {"one": 3, "two": 4}
    # the same batch goes through later
    assert batches.write_batch(spark, root, "b2", SCOPE, {"one": table(spark, 9), "two": table(spark, 5)})
    assert counts(spark, root, "one", "two") == {"one": 9, "two": 5}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "facts")
    assert batches.write_batch(spark, root, "b1", SCOPE, {"one": table(spark, 3)})
    assert batches.write_batch(spark, root, "b2", SCOPE, {"one": table(spark, 2)})
    assert not batches.write_batch(spark, root, "b1", SCOPE, {"one": table(spark, 7)})
    assert counts(spark, root, "one") == {"one": 2}


def test_scopes_and_tables_that_a_batch_lacks(spark, tmp_path):
    root = str(tmp_path / "facts")
    other = {"service_id": "t", "commit_sha": "c9"}
    batches.write_batch(spark, root, "b1", SCOPE, {"one": table(spark, 3), "two": table(spark, 1)})
    batches.write_batch(spark, root, "b2", other, {"one": table(spark, 5).withColumn("more", F.lit(1))})
    got = {r.scope_service_id: r.n for r in batches.read_table(spark, root, "one").groupBy("scope_service_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"s": 3, "t": 5} and batches.read_table(spark, root, "one", service_id="t").count() == 5
    batches.write_batch(spark, root, "b3", SCOPE, {"one": table(spark, 8)})
    with pytest.raises(ValueError):
        batches.read_table(spark, root, "two")


def test_a_manifest_cut_short_is_passed_over(spark, tmp_path):
    root = tmp_path / "facts"
    batches.write_batch(spark, str(root), "b1", SCOPE, {"one": table(spark, 3)})
    (root / "manifests" / "000000000002.json").write_text('{"batches": ["b1", "b2"], "tab')
    assert counts(spark, str(root), "one") == {"one": 3}
    assert batches.write_batch(spark, str(root), "b3", SCOPE, {"one": table(spark, 4)})
    assert counts(spark, str(root), "one") == {"one": 4}


def test_facts_of_a_service(spark, tmp_path):
    yaml = "pubsub:\n  publisher:\n    topic-id: projects/p/topics/T.ORDERS\nkafka:\n  topics:\n    x:\n      topic-name: K\n"
    rows = [("s", "m/src/main/java/OrderController.java", SHOP), ("s", "m/src/main/resources/application.yaml", yaml), ("s", "m/src/main/java/P.java", "package p; public class OrderPublisher { }"), ("s", "bad.java", "class {")]
    rows += [("s", f"m/src/main/java/{k}.java", v) for k, v in SOURCES.items()]
    files = spark.createDataFrame(rows, "service_id string, path string, text string")
    facts = batches.index_facts(files)
    assert batches.write_batch(spark, str(tmp_path / "f"), "b", SCOPE, facts)
    read = lambda n: batches.read_table(spark, str(tmp_path / "f"), n)
    linked = {(r.short_id, r.linked_class_fqn, r.confidence) for r in read("pubsub_resource_facts").collect()}
    assert linked == {("T.ORDERS", "p.OrderPublisher", 0.85), ("K", "p.OrderPublisher", 0.85)}
    assert {r.path for r in read("unsupported_construct_facts").collect()} == {"bad.java"}
    assert read("data_access_facts").filter("evidence_source = 'HANDLER_LINKER+CATALOG'").count() > 0 and read("accessor_method_facts").count() > 4
    assert {r.symbol_kind for r in read("symbol_facts").collect()} == {"CLASS", "METHOD", "ENDPOINT"}


def test_merge_order(spark):
    schema = "service_id string, source_symbol string, http_method string, path_text string, client string, confidence double"
    one = spark.createDataFrame([("s", "A#m", "GET", "/x", "RestTemplate", 0.9), ("s", "A#m", None, None, "WebClient", 0.9)], schema)
    two = spark.createDataFrame([("s", "A#m", "GET", "/x", "Kafka", 0.99), ("s", "A#m", "POST", "/x", "Kafka", 0.9)], schema)
    assert {(r.http_method, r.client) for r in batches.merged_outbound(one, two).collect()} == {("GET", "RestTemplate"), (None, "WebClient"), ("POST", "Kafka")}


def test_sources_are_read_once(spark, monkeypatch):
    """Facts that say what could not be read take what is read already."""
    from factloom.sources import extract

    labels, staged = [], extract.staged
    monkeypatch.setattr(extract, "staged", lambda df, label: labels.append(label) or staged(df, label))
    files = spark.createDataFrame([("s", "A.java", "package a; class A { }"), ("s", "B.java", "class B {"), ("s", "n.java", None)], "service_id string, path string, text string")
    facts = batches.index_facts(files)
    assert labels.count("sources") == 1
    assert sorted(r.path for r in facts["unsupported_construct_facts"].collect()) == ["B.java", "n.java"]
