"""Entry triggers and what they start (F-22 to F-26)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_part, in_package, in_source_roots, simple_name, subscription_topic
from .relational import distinct_on, in_lane, ranked, where_given

#: Triggers are shown in this order of kind.
SUBSCRIPTION_KINDS = ("KAFKA_SUBSCRIBE", "PUBSUB_SUBSCRIBE")
KIND_ORDER = ("REST_INBOUND", "WEBHOOK_INBOUND", "PUBSUB_SUBSCRIBE", "KAFKA_SUBSCRIBE", "CRON_SPRING", "CRON_K8S")


def entry_triggers(
    triggers: DataFrame, service_id: str | None = None, kind: str | None = None, env: str | None = None, package: str | None = None,
    roots: Sequence[str] = (), with_mains: bool = False,
) -> DataFrame:
    """F-22."""
    df = in_lane(where_given(triggers, service_id=service_id, trigger_kind=kind), env, "env_lane")
    if not with_mains and kind != "SPRING_BOOT_MAIN":
        df = df.filter("trigger_kind <> 'SPRING_BOOT_MAIN'")
    if package:
        # a handler known by its interface counts by that; subscriptions belong to no package
        face = F.get_json_object("attributes", "$.handlerInterfaceFqn") if "attributes" in df.columns else F.lit(None).cast("string")
        own = in_package("linked_handler_fqn", package) | in_package(face, package)
        df = df.filter(F.coalesce(own, F.lit(False)) | F.col("trigger_kind").isin(*SUBSCRIPTION_KINDS))
    df = df.filter(in_source_roots("source_ref", roots))
    return df.orderBy(ranked("trigger_kind", KIND_ORDER), F.asc_nulls_last("path_pattern"), "trigger_id")


def impact_by_handler(triggers: DataFrame, handlers: DataFrame) -> DataFrame:
    """F-23: ``handler, trigger_id, service_id, env_lane, match_kind`` for ``handlers(handler, class_fqn, method)``.

    Exact classes (the handler's, or the interface or implementation kept in the
    attributes), with the method if one is given; only where that finds nothing,
    equal simple names.  Both tiers are equi-joins.
    """
    names = F.array_distinct(
        F.filter(
            F.array(class_part("linked_handler_fqn"), F.get_json_object("attributes", "$.interfaceFqn"), F.get_json_object("attributes", "$.implementationFqn")),
            lambda x: x.isNotNull(),
        )
    )
    own = triggers.select("trigger_id", "service_id", "env_lane", F.split_part("linked_handler_fqn", F.lit("#"), F.lit(2)).alias("own_method"), F.explode(names).alias("own_class"))
    exact = handlers.join(own, F.col("class_fqn") == F.col("own_class")).filter("method IS NULL OR own_method = '' OR method = own_method")
    one = exact.select("handler", "trigger_id", "service_id", "env_lane", F.when(F.col("method").isNotNull() & (F.col("method") == F.col("own_method")), "METHOD").otherwise("EXACT").alias("match_kind"))
    rest = handlers.join(one.select("handler").distinct(), "handler", "left_anti").withColumn("simple", simple_name("class_fqn"))
    two = rest.join(own.withColumn("simple", simple_name("own_class")), "simple").select("handler", "trigger_id", "service_id", "env_lane", F.lit("SIMPLE_NAME").alias("match_kind"))
    return distinct_on(one.union(two), ["handler", "service_id", "trigger_id", "env_lane"], [F.desc("match_kind")])


def trace_entries(triggers: DataFrame, accesses: DataFrame, gates: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """F-24: for each trigger its handler with reads, writes, gates and the targets it is wired to."""
    own = triggers.select("trigger_id", "service_id", "trigger_kind", class_part("linked_handler_fqn").alias("handler"))
    data = accesses.groupBy("service_id", F.col("handler_class_fqn").alias("handler")).agg(
        F.sort_array(F.collect_set(F.when(F.col("operation") == "READ", F.col("table_or_entity")))).alias("reads"),
        F.sort_array(F.collect_set(F.when(F.col("operation") == "WRITE", F.col("table_or_entity")))).alias("writes"),
    )
    guard = gates.groupBy("service_id", class_part("guarded_symbol").alias("handler")).agg(F.sort_array(F.collect_set("gate_key")).alias("gates"))
    at = nodes.select("id", "symbol_fqn")
    wires = (
        edges.filter("edge_type = 'WIRES'")
        .join(at.select(F.col("id").alias("from_node"), F.col("symbol_fqn").alias("handler")), "from_node")
        .join(at.select(F.col("id").alias("to_node"), F.col("symbol_fqn").alias("target")), "to_node")
        .groupBy("handler")
        .agg(F.sort_array(F.collect_set("target")).alias("wired"))
    )
    return own.join(data, ["service_id", "handler"], "left").join(guard, ["service_id", "handler"], "left").join(wires, "handler", "left")


def chain_topics(triggers: DataFrame, resources: DataFrame) -> DataFrame:
    """F-25: the topic a trigger's chain goes on with: of its subscription, else the handler's first published, else its path's."""
    published = resources.filter("role = 'PUBLISH'").groupBy("service_id", F.col("linked_class_fqn").alias("handler")).agg(F.min("short_id").alias("published"))
    own = triggers.withColumn("handler", class_part("linked_handler_fqn")).join(published, ["service_id", "handler"], "left")
    sub = F.when(F.col("trigger_kind") == "PUBSUB_SUBSCRIBE", subscription_topic("path_pattern"))
    path = F.when(F.contains("path_pattern", F.lit("_S.")), subscription_topic("path_pattern"))
    return own.select("trigger_id", F.coalesce(sub, "published", path).alias("topic"))


def processor_routing(routes: DataFrame, edges: DataFrame, nodes: DataFrame, handler_id: str) -> DataFrame:
    """F-26: routes of factories the handler invokes, directly or two steps away with a name ending in ``Factory``; else all."""
    step = edges.filter("edge_type = 'INVOKES'").select("from_node", "to_node").distinct()
    one = step.filter(F.col("from_node") == handler_id).select(F.col("to_node").alias("id"))
    two = step.join(one.select(F.col("id").alias("from_node")), "from_node", "left_semi").select(F.col("to_node").alias("id"))
    name = nodes.select("id", "symbol_fqn")
    near = one.join(name, "id").union(two.join(name.filter(F.endswith("symbol_fqn", F.lit("Factory"))), "id")).select(F.col("symbol_fqn").alias("factory_class_fqn")).distinct()
    found = routes.join(near, "factory_class_fqn", "left_semi")
    none = found.agg((F.count("*") == 0).alias("none"))
    return found.unionByName(routes.join(F.broadcast(none.filter("none").drop("none")), how="cross").select(*found.columns))
