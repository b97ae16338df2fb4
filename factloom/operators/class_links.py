"""Classes that publish to topics and consume subscriptions (I-07).

All resources are settled at once.  Each way a resource can get its class gives
candidates with a rank; the smallest (rank, path, class) is taken, so ties fall
the same way in every run.  No way compares all resources with all classes:
rules and resources meet on keys, mentions on words, and "any publisher" needs
only the first one of a module or service.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_name, simple_name

#: What senders hold, and what methods are named where the source says nothing else.
_GATEWAYS = r"PubSubMsgGateway|publishGateway"
_PRODUCERS = r"SyncProducer|AsyncProducer|KafkaTemplate"
#: Base confidence in a module and in the whole service.
MODULE, SERVICE = 0.90, 0.85
#: A name of more camel-case words is taken as a whole only.
MOST_WORDS = 8


def _leaf(key: Column | str) -> Column:
    return F.nullif(F.substring_index(key, ".", -1), F.lit(""))


def is_kafka() -> Column:
    """A resource of a Kafka setting, or whose attributes say so."""
    return F.coalesce(F.contains("spring_key", F.lit("kafka.topics")), F.lit(False)) | F.coalesce(F.contains("attributes", F.lit('"transport":"KAFKA"')), F.lit(False))


def message_classes(parsed: DataFrame) -> DataFrame:
    """``service_id, path, class_fqn, module_name, text`` of classes that send or receive, and what they are.

    ``publisher``: named so, or a publish service with a gateway.  ``producer``:
    a publisher, or named so and holding a Kafka producer.  ``consumer``: named
    so, applications apart; ``listener``: one with a Kafka listener.
    """
    simple = simple_name("class_fqn")
    publisher = F.contains("class_fqn", F.lit("Publisher")) | F.endswith(simple, F.lit("PublishService")) & F.col("text").rlike(_GATEWAYS)
    producer = publisher | F.endswith(simple, F.lit("Producer")) & F.col("text").rlike(_PRODUCERS)
    consumer = F.endswith(simple, F.lit("Consumer"))
    listener = consumer & F.contains("text", F.lit("@KafkaListener"))
    out = parsed.select("service_id", "path", "class_fqn", module_name("path").alias("module_name"), "text", publisher.alias("publisher"), producer.alias("producer"), consumer.alias("consumer"), listener.alias("listener"))
    return out.filter("producer OR consumer")


def mentioned_words(text: Column | str) -> Column:
    """Names in a text, in lower case: whole, by their dotted parts, and by runs of camel-case words of those.

    A key counts as mentioned where it is one of these; one that only lies
    within a word of a name does not.
    """
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w[\w.\-]*"), F.lit(0)))
    parts = F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(n, r"\."))))
    camel = F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"), F.lit(0)))
    short = F.filter(camel, lambda w: (F.size(w) > 1) & (F.size(w) <= MOST_WORDS))
    runs = F.transform(short, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.size(w) - i + 1), lambda n: F.array_join(F.slice(w, i, n), "")))))
    return F.array_distinct(F.transform(F.concat(names, parts, F.flatten(runs)), lambda w: F.lower(w)))


def _ruled(resources: DataFrame, rules: DataFrame, keys: list[str], loose: str | None) -> DataFrame:
    """``resource_id, position, class_fqn, method`` of rules that fit; an absent value of a rule fits all, and an absent one of a resource fits any rule.

    Each side goes to every key under which it may meet the other, so rules and
    resources are joined on equal keys.  The role of a rule needs one of the resource.
    """

    def side(c: str, rule: bool) -> Column:
        value = F.lower(c)
        if rule:
            return F.when(value.isNull(), F.array(F.lit("any"), F.lit("none"))).otherwise(F.array(F.concat(F.lit("="), value), *([] if c == "role" else [F.lit("none")])))
        return F.when(value.isNull(), F.array(F.lit("none"))).otherwise(F.array(F.concat(F.lit("="), value), F.lit("any")))

    used = [k for k in keys if k != loose]
    left = resources.select("resource_id", *(side(k, False).alias(k) for k in used))
    right = rules.filter("class_fqn IS NOT NULL AND trim(class_fqn) <> ''").select("position", "class_fqn", "method", *(side(k, True).alias(k) for k in used))
    for k in used:
        left, right = left.withColumn(k, F.explode(k)), right.withColumn(k, F.explode(k))
    return left.join(right, used).select("resource_id", "position", "class_fqn", "method").distinct()


def link_resources(resources: DataFrame, classes: DataFrame, pubsub_rules: DataFrame | None = None, kafka_rules: DataFrame | None = None) -> DataFrame:
    """Every row of ``resources``, with ``linked_class_fqn``, ``linked_method``, ``evidence_source`` and ``confidence`` of its class.

    ``resources(resource_id, service_id, resource_kind, short_id, role, spring_key,
    module_name, attributes, linked_class_fqn, linked_method, evidence_source,
    confidence)``; ids are unique.  ``classes``: see :func:`message_classes`.
    Rules: ``(position, role, module_name, spring_key_leaf | short_id, class_fqn, method)``.

    In this order: rules; Kafka rules with their module (0.99), then without
    (0.97); classes of the resource's module, then of its service.  Among classes,
    a publishing Kafka topic takes a producer that mentions its key (0.95), its
    topic (base), or any (base - 0.05); then, as all publishing topics, a
    publisher that mentions the key (0.95), or any (base - 0.05).  A Kafka
    subscription takes a listener, then as all subscriptions a consumer (base).
    What finds no class stays as it is.
    """
    facts = resources.withColumns({"leaf": _leaf("spring_key"), "kafka": is_kafka()})
    found = []
    columns = ["resource_id", "rank", "tie", "class_fqn", "method", "evidence", "score"]

    def rule(rows: DataFrame, rank: int, score: float) -> DataFrame:
        return rows.select("resource_id", F.lit(rank).alias("rank"), F.format_string("%010d", "position").alias("tie"), "class_fqn", "method", F.lit("RULE_PACK").alias("evidence"), F.lit(score).alias("score"))

    if pubsub_rules is not None:
        keyed = facts.select("resource_id", "role", "module_name", F.col("leaf").alias("spring_key_leaf"))
        found.append(rule(_ruled(keyed, pubsub_rules, ["role", "module_name", "spring_key_leaf"], None), 0, 0.99))
    if kafka_rules is not None:
        kafka = facts.filter("kafka")
        found.append(rule(_ruled(kafka, kafka_rules, ["role", "module_name", "short_id"], None), 1, 0.99))
        found.append(rule(_ruled(kafka, kafka_rules, ["role", "module_name", "short_id"], "module_name"), 2, 0.97))

    text = F.col("text")
    sends = F.when(F.contains(text, F.lit("sendUpdateManageOfferEvent")), "sendUpdateManageOfferEvent").otherwise("publishEvent")
    hears = F.when(F.contains(text, F.lit("processSalesCanonicalEvent")), "processSalesCanonicalEvent").when(F.contains(text, F.lit("publishEvent")), "publishEvent").otherwise("onMessage")
    tie = F.concat_ws("\0", "path", "class_fqn")

    def candidates(where: Column, method: Column) -> DataFrame:
        return classes.filter(where).select("service_id", F.col("module_name").alias("of_module"), tie.alias("tie"), "class_fqn", method.alias("method"), "text")

    def first_of(of: DataFrame, mine: DataFrame, rank: int, module: float, service: float) -> None:
        """Any candidate will do: the first of each module and of each service."""
        smallest = F.min(F.struct("tie", "class_fqn", "method")).alias("c")
        whole = of.groupBy("service_id").agg(smallest)
        by_module = of.filter("of_module IS NOT NULL").groupBy("service_id", F.col("of_module").alias("module_name")).agg(smallest)
        for of_all, keys, at, score in ((by_module, ["service_id", "module_name"], rank, module), (whole, ["service_id"], rank + 20, service)):
            found.append(mine.join(of_all, keys).select("resource_id", F.lit(at).alias("rank"), "c.tie", "c.class_fqn", "c.method", F.lit("JAVA_INFERRED").alias("evidence"), F.lit(score).alias("score")))

    def mentions(of: DataFrame, mine: DataFrame, keys: list[str], rank: int, module: float, service: float) -> None:
        """Candidates one of whose words is a key of the resource, and whose text has the key as it is written."""
        words = of.withColumn("word", F.explode(mentioned_words("text")))
        wanted = mine.select("resource_id", "service_id", "module_name", F.explode(F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))).alias("key")).withColumn("word", F.lower("key"))
        hits = wanted.join(words, ["service_id", "word"]).filter(F.contains("text", F.col("key"))).drop("text", "word", "key").distinct()
        near = F.col("module_name").eqNullSafe(F.col("of_module")) & F.col("module_name").isNotNull()
        for kept, at, score in ((hits.filter(near), rank, module), (hits, rank + 20, service)):
            found.append(kept.select("resource_id", F.lit(at).alias("rank"), "tie", "class_fqn", "method", F.lit("JAVA_INFERRED").alias("evidence"), F.lit(score).alias("score")))

    publish, subscribe = facts.filter("role = 'PUBLISH'"), facts.filter("role = 'SUBSCRIBE'")
    producers, publishers = candidates(F.col("producer"), sends), candidates(F.col("publisher"), sends)
    mentions(producers, publish.filter("kafka"), ["leaf", "spring_key"], 10, 0.95, 0.95)
    mentions(producers, publish.filter("kafka"), ["short_id"], 11, MODULE, SERVICE)
    first_of(producers, publish.filter("kafka"), 12, MODULE - 0.05, SERVICE - 0.05)
    mentions(publishers, publish, ["leaf", "spring_key"], 13, 0.95, 0.95)
    first_of(publishers, publish, 14, MODULE - 0.05, SERVICE - 0.05)
    first_of(candidates(F.col("listener"), hears), subscribe.filter("kafka"), 15, MODULE, SERVICE)
    consumers = candidates(F.col("consumer"), F.lit("onMessage"))
    first_of(consumers, subscribe, 16, MODULE, SERVICE)

    every = reduce(DataFrame.union, (f.select(*columns) for f in found))
    best = every.groupBy(F.col("resource_id").alias("__of")).agg(F.min(F.struct("rank", "tie", "class_fqn", "method", "evidence", "score")).alias("__won"))
    out = resources.join(best, F.col("resource_id") == F.col("__of"), "left")
    own = {
        "linked_class_fqn": F.coalesce("__won.class_fqn", "linked_class_fqn"), "linked_method": F.when(F.col("__won").isNotNull(), F.coalesce("__won.method", "linked_method")).otherwise(F.col("linked_method")),
        "evidence_source": F.coalesce("__won.evidence", "evidence_source"), "confidence": F.coalesce("__won.score", "confidence"),
    }
    return out.select(*((own[c] if c in own else F.col(c)).alias(c) for c in resources.columns))


def schemas_to_topics(schemas: DataFrame, resources: DataFrame) -> DataFrame:
    """I-07: schemas without a topic get one of their class's topics, the smallest; with a topic the confidence is 0.95."""
    topics = resources.filter("linked_class_fqn IS NOT NULL").groupBy("service_id", "linked_class_fqn").agg(F.min("short_id").alias("__topic"))
    topic = F.coalesce("topic_short_id", "__topic")
    out = schemas.join(topics, ["service_id", "linked_class_fqn"], "left")
    own = {"topic_short_id": topic, "confidence": F.when(topic.isNotNull(), 0.95).otherwise(F.col("confidence"))}
    return out.select(*((own[c] if c in own else F.col(c)).alias(c) for c in schemas.columns))
