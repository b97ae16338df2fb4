"""Topics, publishers, subscribers and flows across services (F-01 to F-13, F-38 to F-40).

``resources(org_id, service_id, repo, resource_kind, short_id, env_lane, role,
linked_class_fqn, attributes, confidence)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_match, gate_state, hop_transport, subscription_topic, topic_stem, transport
from ..session import staged
from .relational import best_wins, distinct_on


def inventory(resources: DataFrame, registry: DataFrame | None = None, short_id: str | None = None, role: str | None = None, kind: str | None = None) -> DataFrame:
    """F-01, F-02: of a service, or of an organisation with its registered services; role and kind in any case."""
    df = resources if registry is None else resources.join(registry.filter("enabled").select("service_id", "service_name"), "service_id")
    for name, value in (("short_id", short_id), ("role", role), ("resource_kind", kind)):
        if value:
            df = df.filter(F.col(name) == value if name == "short_id" else F.upper(name) == value.upper())
    return df.orderBy("service_id", "resource_kind", F.asc_nulls_last("short_id"))


def gates_of_package(gates: DataFrame, nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """F-04: gates on symbols of the package, or one DEPENDS_ON or INVOKES edge away from it."""
    inside = nodes.filter(F.startswith("symbol_fqn", F.lit(prefix))).select(F.col("id").alias("from_node"))
    near = edges.filter("edge_type IN ('DEPENDS_ON', 'INVOKES')").join(inside, "from_node", "left_semi").select(F.col("to_node").alias("id")).distinct()
    classes = nodes.join(near, "id", "left_semi").select(F.col("symbol_fqn").alias("__c")).distinct()
    with_class = gates.withColumn("__c", F.split_part("guarded_symbol", F.lit("#"), F.lit(1)))
    own = with_class.filter(F.startswith("__c", F.lit(prefix)))
    return own.union(with_class.join(classes, "__c", "left_semi").select(*with_class.columns)).drop("__c").distinct()


def flow_steps(resources: DataFrame, schemas: DataFrame, accesses: DataFrame, gates: DataFrame) -> DataFrame:
    """F-05: one row for each handler of a service's topics: its publishes and subscribes, schemas, reads, writes and gates.

    Facts are grouped by handler on their own before they meet, so nothing multiplies.
    """
    own = F.coalesce("linked_class_fqn", "service_id").alias("handler")
    steps = resources.groupBy("service_id", own).agg(
        F.sort_array(F.collect_set(F.when(F.col("role") == "PUBLISH", F.col("short_id")))).alias("publishes"),
        F.sort_array(F.collect_set(F.when(F.col("role") == "SUBSCRIBE", F.col("short_id")))).alias("subscribes"),
    )
    shape = schemas.groupBy("service_id", F.col("linked_class_fqn").alias("handler")).agg(F.sort_array(F.collect_set("payload_proto")).alias("schemas"))
    data = accesses.groupBy("service_id", F.col("handler_class_fqn").alias("handler")).agg(
        F.sort_array(F.collect_set(F.when(F.col("operation") == "READ", F.col("table_or_entity")))).alias("reads"),
        F.sort_array(F.collect_set(F.when(F.col("operation") == "WRITE", F.col("table_or_entity")))).alias("writes"),
    )
    guard = gates.groupBy("service_id", F.split_part("guarded_symbol", F.lit("#"), F.lit(1)).alias("handler")).agg(F.sort_array(F.collect_set("gate_key")).alias("gates"))
    out = steps
    for part in (shape, data, guard):
        out = out.join(part, ["service_id", "handler"], "left")
    none = F.array().cast("array<string>")
    return out.select("service_id", "handler", *(F.coalesce(c, none).alias(c) for c in ("publishes", "subscribes", "schemas", "reads", "writes", "gates")))


def flow_gaps(steps: DataFrame, resources: DataFrame) -> DataFrame:
    """F-06: ``gap_type, service_id, subject``."""
    unlinked = resources.filter("linked_class_fqn IS NULL").select(
        F.when((transport("attributes") == "KAFKA") & (F.col("role") == "PUBLISH"), "UNLINKED_KAFKA_PUBLISHER").otherwise("UNLINKED_PUBSUB").alias("gap_type"),
        "service_id", F.col("short_id").alias("subject"),
    )
    shapeless = steps.filter(F.size("schemas") == 0).select(F.lit("MISSING_SCHEMA"), "service_id", "handler")
    unguarded = steps.filter((F.size("gates") == 0) & (F.size("writes") > 0)).select(F.lit("UNGUARDED_STEP"), "service_id", "handler")
    return unlinked.union(shapeless).union(unguarded).distinct()


def canonical_topics(topics: DataFrame, aliases: DataFrame, column: str = "topic") -> DataFrame:
    """C-10: an alias, whatever its case, becomes its topic, the smallest where it has several; others stay."""
    known = aliases.groupBy(F.upper(F.trim("alias")).alias("__a")).agg(F.min("topic").alias("__t"))
    out = topics.withColumn("__a", F.upper(F.trim(column))).join(known, "__a", "left")
    return out.withColumn(column, F.coalesce("__t", column)).drop("__a", "__t")


def topic_steps(resources: DataFrame) -> DataFrame:
    """``topic, next_topic``: services that subscribe to the one publish the other."""
    subs = resources.filter("role = 'SUBSCRIBE'").select("service_id", subscription_topic("short_id").alias("topic")).distinct()
    pubs = resources.filter("role = 'PUBLISH'").select("service_id", F.col("short_id").alias("next_topic")).distinct()
    return subs.join(pubs, "service_id").filter("topic <> next_topic").select("topic", "next_topic").distinct()


def trace_topics(resources: DataFrame, start: str, max_hops: int = 10, follow: DataFrame | None = None) -> DataFrame:
    """F-07: ``topic, hop``: topics in breadth-first order from ``start``, at most ``max_hops`` of them.

    A level's topics are in the order of the topic that led to them, then by
    name; a topic is taken where it is met first.  ``follow(service_id)``
    keeps the walk to those subscribers (F-08).
    """
    used = resources if follow is None else resources.filter("role = 'PUBLISH'").unionByName(
        resources.filter("role = 'SUBSCRIBE'").join(follow.select("service_id").distinct(), "service_id", "left_semi").select(*resources.columns)
    )
    steps = staged(topic_steps(used), "topic-steps")
    level = staged(resources.sparkSession.createDataFrame([(start, 0)], "topic string, hop int"), "hops")
    found, taken = level, 1
    while taken < max_hops:
        met = level.join(steps, "topic").groupBy(F.col("next_topic").alias("topic")).agg(F.min("hop").alias("led"))
        new = met.join(found.select("topic"), "topic", "left_anti")
        # a level has at most max_hops rows after this limit
        rows = new.orderBy("led", "topic").limit(max_hops - taken).collect()
        if not rows:
            break
        level = resources.sparkSession.createDataFrame([(r["topic"], taken + i) for i, r in enumerate(rows)], "topic string, hop int")
        found, taken = found.union(level), taken + len(rows)
    return found


def canonical_resources(resources: DataFrame, aliases: DataFrame) -> DataFrame:
    """F-07: resources under their topics' canonical names; a subscription takes that of its topic."""
    topic = F.when(F.col("role") == "SUBSCRIBE", subscription_topic("short_id")).otherwise(F.col("short_id"))
    return canonical_topics(resources.withColumn("short_id", topic), aliases, "short_id")


def trace_all(resources: DataFrame, starts: DataFrame, aliases: DataFrame | None = None, max_hops: int = 10) -> DataFrame:
    """F-07 for every topic of ``starts(start)`` at once: ``start, topic, hop``, at most ``max_hops`` topics a start, in the order of :func:`trace_topics`.

    With ``aliases(alias, topic)``, starts and resources go by canonical names,
    so a walk passes from a name to another of the same topic.  A round takes
    one level of all starts; each keeps what its own budget leaves.
    """
    known = resources if aliases is None else canonical_resources(resources, aliases)
    steps = staged(topic_steps(known), "topic-steps")
    first = starts.select("start").distinct()
    level = first.withColumn("topic", F.col("start"))
    level = staged((level if aliases is None else canonical_topics(level, aliases)).withColumn("hop", F.lit(0)), "hops")
    found = level
    while True:
        met = level.join(steps, "topic").groupBy("start", F.col("next_topic").alias("topic")).agg(F.min("hop").alias("led"))
        new = met.join(found.select("start", "topic"), ["start", "topic"], "left_anti")
        taken = found.groupBy("start").agg(F.count("*").alias("taken"))
        nth = F.row_number().over(Window.partitionBy("start").orderBy("led", "topic"))
        rows = new.withColumn("nth", nth).join(taken, "start").withColumn("hop", (F.col("taken") + F.col("nth") - 1).cast("int"))
        level = staged(rows.filter(F.col("hop") < max_hops).select("start", "topic", "hop"), "hops")
        if level.isEmpty():
            return found
        found = found.union(level)


def hop_participants(hops: DataFrame, resources: DataFrame) -> DataFrame:
    """F-07, F-12: publishers and subscribers of each hop's topic, by equality, subscription name or stem; best confidence of a service and role."""
    key = hops.select("topic", "hop", topic_stem("topic").alias("stem"))
    named = resources.select(
        "service_id", "role", "confidence", transport("attributes").alias("transport"),
        F.when(F.col("role") == "SUBSCRIBE", subscription_topic("short_id")).otherwise(F.col("short_id")).alias("topic"),
    )
    exact = key.join(named, "topic").select("topic", "hop", "service_id", "role", "confidence", "transport")
    stems = named.filter("role = 'SUBSCRIBE'").withColumn("stem", topic_stem("topic")).drop("topic")
    like = key.join(stems, "stem").select("topic", "hop", "service_id", "role", "confidence", "transport")
    return best_wins(exact.union(like), ["topic", "service_id", "role"], "confidence", [F.asc("transport")])


def hop_transports(participants: DataFrame) -> DataFrame:
    """C-13."""
    return participants.groupBy("topic", "hop").agg(hop_transport(F.collect_set("transport")).alias("transport"))


def runtime_subscribers(resources: DataFrame, triggers: DataFrame, registry: DataFrame) -> DataFrame:
    """F-08: subscribers with a linked class, or services other than libraries with a trigger on the topic."""
    subs = resources.filter("role = 'SUBSCRIBE'").withColumn("__topic", subscription_topic("short_id"))
    linked = subs.filter("linked_class_fqn IS NOT NULL").select("service_id")
    hit = triggers.filter("trigger_kind IN ('PUBSUB_SUBSCRIBE', 'KAFKA_SUBSCRIBE')").select("service_id", subscription_topic("path_pattern").alias("__topic")).distinct()
    apps = registry.filter("module_type <> 'library'").select("service_id")
    triggered = subs.join(hit, ["service_id", "__topic"], "left_semi").join(apps, "service_id", "left_semi").select("service_id")
    return linked.union(triggered).distinct()


#: What follow modes ask for becomes: a mode and perhaps a warning.
def follow_mode(asked: str | None, include_manifest: bool = False) -> tuple[str, str | None]:
    """F-08: ``causal`` is not available and falls back to ``runtime``."""
    warning = "causal is not available; runtime is used" if asked == "causal" else None
    return ("inventory" if include_manifest or asked == "inventory" else "runtime"), warning


def gap_of_hop(manifest_only: Column, topic: Column, has_publisher: Column, has_subscriber: Column, indexed: Column, terminal: Sequence[str] = ()) -> Column:
    """F-09: the first that holds; null without a gap."""
    ends = F.lit(False)
    for pattern in terminal:
        ends = ends | glob_match(topic, pattern)
    return (
        F.when(has_subscriber & ~manifest_only, None)
        .when(manifest_only, "MANIFEST_ONLY")
        .when(ends, "TERMINAL_EXTERNAL")
        .when(~has_publisher, "NO_RUNTIME_PUBLISHER")
        .when(~indexed, "NO_SUBSCRIBER_INDEX_GAP")
        .otherwise("NO_SUBSCRIBER")
    )


def hop_gaps(hops: DataFrame, participants: DataFrame, terminal: Sequence[str] = (), missing_repos: bool = False) -> DataFrame:
    """F-09, F-10: ``topic, hop, gap_type``."""
    roles = participants.groupBy("topic").agg(F.max(F.col("role") == "PUBLISH").alias("pub"), F.max(F.col("role") == "SUBSCRIBE").alias("sub"))
    no = lambda c: F.coalesce(c, F.lit(False))
    gap = gap_of_hop(F.lit(False), F.col("topic"), no("pub"), no("sub"), F.lit(not missing_repos), terminal)
    return hops.join(roles, "topic", "left").select("topic", "hop", gap.alias("gap_type")).filter("gap_type IS NOT NULL")


def missing_repos(bundle: DataFrame, registry: DataFrame) -> DataFrame:
    """F-10: repositories of a bundle that are not registered."""
    return bundle.select("repo").distinct().join(registry.select("repo"), "repo", "left_anti")


def terminal_retries(hops: DataFrame, participants: DataFrame, retries: DataFrame, triggers: DataFrame) -> DataFrame:
    """F-11: hops without subscriber whose topic or stem a dead-letter path names, with the cron job of that name.

    ``retries(service_id, linked_topic, env_lane, job_name)``.
    """
    subscribed = participants.filter("role = 'SUBSCRIBE'").select("topic")
    open_hops = hops.join(subscribed, "topic", "left_anti").withColumn("stem", topic_stem("topic"))
    path = retries.select(F.col("linked_topic").alias("topic"), topic_stem("linked_topic").alias("__s"), "job_name")
    exact = open_hops.join(path, "topic").select("topic", "hop", "job_name")
    like = open_hops.join(path.drop("topic"), F.col("stem") == F.col("__s")).select("topic", "hop", "job_name")
    cron = triggers.filter("trigger_kind IN ('CRON_K8S', 'CRON_SPRING')").select("trigger_id", F.regexp_extract("path_pattern", "([^/]+)$", 1).alias("job_name"))
    first = distinct_on(exact.union(like), ["topic"], [F.asc("job_name")])
    return first.join(cron, "job_name", "left").select("topic", "hop", "job_name", "trigger_id", F.lit("TERMINAL_BATCH_RETRY").alias("gap_type"))


def first_hop_triggers(hops: DataFrame, participants: DataFrame, triggers: DataFrame) -> DataFrame:
    """F-13: inbound triggers of the first hop's publishers."""
    first = participants.filter("role = 'PUBLISH' AND hop = 0").select("service_id").distinct()
    inbound = triggers.filter("trigger_kind IN ('REST_INBOUND', 'WEBHOOK_INBOUND', 'CRON_SPRING', 'CRON_K8S')")
    return inbound.join(first, "service_id", "left_semi")


def flow_summary(hops: DataFrame, participants: DataFrame, gaps: DataFrame) -> DataFrame:
    """F-12: one line for each hop."""
    of = lambda role: F.array_join(F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("service_id")))), ", ")
    people = participants.groupBy("topic").agg(of("PUBLISH").alias("publishers"), of("SUBSCRIBE").alias("subscribers"))
    none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("nobody"))
    out = hops.join(people, "topic", "left").join(gaps.select("topic", "gap_type"), "topic", "left")
    line = F.concat_ws(" ", "topic", F.lit("from"), none("publishers"), F.lit("to"), none("subscribers"), F.when(F.col("gap_type").isNotNull(), F.concat(F.lit("("), "gap_type", F.lit(")"))))
    return out.select("hop", "topic", line.alias("narrative")).orderBy("hop")


def live_gates(gates: DataFrame, live: DataFrame, secret: str = "(?i)(password|secret|token|key)") -> DataFrame:
    """F-38: gates with the live value of their key and their state; values of secret-looking keys are ``***``."""
    out = gates.join(live.select(F.col("config_key").alias("gate_key"), "live_value"), "gate_key", "left")
    shown = F.when(F.col("gate_key").rlike(secret) & F.col("live_value").isNotNull(), "***").otherwise(F.col("live_value"))
    return out.withColumn("state", gate_state("required_value", "live_value")).withColumn("live_value", shown)


def verify_subscriptions(resources: DataFrame, live: DataFrame) -> DataFrame:
    """F-39: declared subscriptions against a live snapshot ``(short_id, topic, error)``."""
    subs = resources.filter("resource_kind = 'SUBSCRIPTION'").select("service_id", "short_id", subscription_topic("short_id").alias("expected")).distinct()
    state = (
        F.when(F.col("error").isNotNull(), "ERROR").when(F.col("topic").isNull(), "SUBSCRIPTION_MISSING").when(F.col("topic") != F.col("expected"), "TOPIC_MISMATCH").otherwise("OK")
    )
    return subs.join(live.select("short_id", "topic", "error"), "short_id", "left").select("service_id", "short_id", "expected", "topic", state.alias("status"))


def drift(resources: DataFrame) -> DataFrame:
    """F-40: ``short_id, topic, drift_status`` of each subscription: whether the topic it implies is declared."""
    subs = resources.filter("resource_kind = 'SUBSCRIPTION'").select("org_id", "short_id", subscription_topic("short_id").alias("topic")).distinct()
    topics = resources.filter("resource_kind = 'TOPIC'").select("org_id", F.col("short_id").alias("topic")).distinct().withColumn("there", F.lit(True))
    return subs.join(topics, ["org_id", "topic"], "left").select("org_id", "short_id", "topic", F.when(F.col("there"), "LINKED_OK").otherwise("MISSING_TOPIC").alias("drift_status"))
