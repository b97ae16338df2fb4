"""Classes linked to topics and subscriptions: each rung of the ladder, its confidence, and stable ties."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import class_links
from factloom.sources import extract

RESOURCE = "resource_id int, service_id string, resource_kind string, short_id string, role string, spring_key string, module_name string, attributes string, linked_class_fqn string, linked_method string, evidence_source string, confidence double"
KAFKA = '{"transport":"KAFKA"}'


def topic(i, key, module="m", short="T.X", role="PUBLISH", attributes=None, service="s", linked=None):
    return (i, service, "TOPIC" if role == "PUBLISH" else "SUBSCRIPTION", short, role, key, module, attributes, linked, None, "YAML", 1.0)


def source(path, body, service="s"):
    return (service, f"{path}.java", f"package p; public {body}")


def linked(spark, resources, sources, rules=None, kafka=None):
    parsed = extract.light_parse(spark.createDataFrame(sources, "service_id string, path string, text string")) if sources else spark.createDataFrame([], "service_id string, path string, class_fqn string, text string")
    rule = "position int, role string, module_name string, {} string, class_fqn string, method string"
    one = spark.createDataFrame(rules, rule.format("spring_key_leaf")) if rules else None
    two = spark.createDataFrame(kafka, rule.format("short_id")) if kafka else None
    got = class_links.link_resources(spark.createDataFrame(resources, RESOURCE).withColumn("b", F.lit(1)), class_links.message_classes(parsed), one, two).collect()
    assert len(got) == len(resources)
    return {r.resource_id: (r.linked_class_fqn, r.linked_method, r.evidence_source, round(r.confidence, 2)) for r in got}


def test_publishers(spark):
    sources = [
        source("m/src/main/java/B", "class BPublisher { String t = \"other\"; }"), source("m/src/main/java/A", "class APublisher { Object t = ids.get(\"freedomumo\"); void m() { sendUpdateManageOfferEvent(); } }"),
        source("n/src/main/java/C", "class OrderPublishService { PubSubMsgGateway publishGateway; }"), source("n/src/main/java/D", "class PlainPublishService { }"), source("n/src/main/java/E", "class Not { /* Publisher */ }"),
        source("m/src/main/java/Z", "class ZPublisher { String k = \"pubsub.publisher.topicId.offerUpdate\"; }", "t"),
    ]
    got = linked(spark, [
        topic(1, "pubsub.publisher.topicId.freedomumo"), topic(2, "pubsub.x.unmentioned"), topic(3, "pubsub.x.unmentioned", "n"), topic(4, "a.freedomumo", "n"), topic(5, "a.nothing", "elsewhere"),
        topic(6, "pubsub.publisher.topicId.offerUpdate", service="t"), topic(7, None, None), topic(8, "a.b", service="nobody", linked="old.C"),
    ], sources)
    a = ("p.APublisher", "sendUpdateManageOfferEvent", "JAVA_INFERRED")
    assert got == {
        1: (*a, 0.95), 2: (*a, 0.85), 3: ("p.OrderPublishService", "publishEvent", "JAVA_INFERRED", 0.85), 4: ("p.OrderPublishService", "publishEvent", "JAVA_INFERRED", 0.85),
        5: (*a, 0.80), 6: ("p.ZPublisher", "publishEvent", "JAVA_INFERRED", 0.95), 7: (*a, 0.80), 8: ("old.C", None, "YAML", 1.0),
    }


def test_kafka_producers(spark):
    sources = [
        source("m/src/main/java/A", "class AEventProducer { SyncProducer p; }"), source("m/src/main/java/B", "class BProducer { KafkaTemplate<A, B> p; String t = \"SHOP.REBATE.EVENTS\"; }"),
        source("m/src/main/java/C", "class CProducer { AsyncProducer p; void rebateTopicName() { } }"), source("m/src/main/java/D", "class DProducer { }"),
    ]
    key = "kafka.topics.rebate."
    got = linked(spark, [topic(1, key + "rebateTopic"), topic(2, key + "none", short="SHOP.REBATE.EVENTS"), topic(3, key + "none"), topic(4, "x.none", attributes=KAFKA, module="far"), topic(5, "x.none")], sources)
    assert got == {
        1: ("p.CProducer", "publishEvent", "JAVA_INFERRED", 0.95), 2: ("p.BProducer", "publishEvent", "JAVA_INFERRED", 0.90), 3: ("p.AEventProducer", "publishEvent", "JAVA_INFERRED", 0.85),
        4: ("p.AEventProducer", "publishEvent", "JAVA_INFERRED", 0.80), 5: (None, None, "YAML", 1.0),
    }


def test_consumers(spark):
    sources = [
        source("m/src/main/java/A", "class AConsumerApplication { }"), source("m/src/main/java/B", "class BConsumer { }"), source("m/src/main/java/C", "class CConsumer { @KafkaListener(topics = \"x\") void processSalesCanonicalEvent() { } }"),
        source("m/src/main/java/D", "class ACommentConsumer { // @KafkaListener\n }"),
    ]
    got = linked(spark, [topic(1, "consumer.x.subscription-id", role="SUBSCRIBE"), topic(2, "kafka.topics.x", role="SUBSCRIBE"), topic(3, "kafka.topics.x", "far", role="SUBSCRIBE"), topic(4, "kafka.topics.x", role="OTHER")], sources)
    assert got == {
        1: ("p.BConsumer", "onMessage", "JAVA_INFERRED", 0.90), 2: ("p.CConsumer", "processSalesCanonicalEvent", "JAVA_INFERRED", 0.90),
        3: ("p.CConsumer", "processSalesCanonicalEvent", "JAVA_INFERRED", 0.85), 4: (None, None, "YAML", 1.0),
    }


def test_rules_come_first(spark):
    rules = [(1, "SUBSCRIBE", None, "umo", "r.Sub", None), (2, "publish", None, "UMO", "r.Leaf", "send"), (3, None, "m", None, "r.Module", None), (4, "PUBLISH", "x", "umo", " ", "blank")]
    sources = [source("m/src/main/java/A", "class APublisher { String k = \"umo\"; }")]
    got = linked(spark, [topic(1, "a.umo", "x"), topic(2, "a.other", "M"), topic(3, "a.other", "y"), topic(4, None, None)], sources, rules)
    assert got == {1: ("r.Leaf", "send", "RULE_PACK", 0.99), 2: ("r.Module", None, "RULE_PACK", 0.99), 3: ("p.APublisher", "publishEvent", "JAVA_INFERRED", 0.80), 4: ("r.Leaf", "send", "RULE_PACK", 0.99)}


def test_kafka_rules_with_and_without_their_module(spark):
    kafka = [(1, "PUBLISH", "eval", "Q.EVENTS", "k.Eval", "post"), (2, None, "other", "Q.EVENTS", "k.Other", None)]
    got = linked(spark, [topic(1, "kafka.topics.a", "other", "q.events"), topic(2, "kafka.topics.a", "common", "Q.EVENTS"), topic(3, "plain.a", "eval", "Q.EVENTS"), topic(4, "kafka.topics.a", "eval", "Q.ELSE")], [], None, kafka)
    assert got == {1: ("k.Other", None, "RULE_PACK", 0.99), 2: ("k.Eval", "post", "RULE_PACK", 0.97), 3: (None, None, "YAML", 1.0), 4: (None, None, "YAML", 1.0)}


@pytest.mark.parametrize(("text", "words"), [
    ("a.freedomUmo.x-id", {"a", "freedomumo", "freedom", "umo", "x-id", "a.freedomumo.x-id", "x", "id", "xid"}), ("PDN_T.UMO", {"pdn_t.umo", "pdn_t", "umo", "pdn", "t", "pdnt"}), ("", set()),
])
def test_mentioned_words(spark, text, words):
    got = set(spark.range(1).select(class_links.mentioned_words(F.lit(text)).alias("w")).head().w)
    assert got <= words | {"a"} and {w for w in words if "." in w or w in ("umo", "freedomumo", "x-id")} <= got


def test_schemas_get_topics(spark):
    schemas = spark.createDataFrame([("s", "a.P", None, 0.85), ("s", "a.P", "OWN", 0.85), ("s", "a.Q", None, 0.85), ("s", None, None, 0.7)], "service_id string, linked_class_fqn string, topic_short_id string, confidence double")
    resources = spark.createDataFrame([("s", "a.P", "T.B"), ("s", "a.P", "T.A"), ("t", "a.Q", "T.C"), ("s", None, "T.D")], "service_id string, linked_class_fqn string, short_id string")
    got = sorted(((r.linked_class_fqn or "", r.topic_short_id or "", r.confidence) for r in class_links.schemas_to_topics(schemas, resources).collect()))
    assert got == [("", "", 0.7), ("a.P", "OWN", 0.95), ("a.P", "T.A", 0.95), ("a.Q", "", 0.85)]
