"""Consistency scenarios, hints and gaps (F-14 to F-21, I-20).

``accesses(service_id, handler_class_fqn, dao_method, operation, store_type,
table_or_entity)``; ``scenarios(service_id, scenario_id, pattern, scope_kind,
scope_ref, participants array<struct<storeType,physicalName,role,via,lagClass>>,
source)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_name, normalize_table
from .relational import best_wins, distinct_on

#: Roles that a co-table pattern needs written.
WRITTEN_ROLES = ("PRIMARY", "REQUIRED", "REQUIRED_CHILD", "SECONDARY")
CO_TABLE = ("CO_TABLE_INVARIANT", "MULTI_TABLE_DOMAIN")


def infer_scenarios(accesses: DataFrame, mirrors: DataFrame | None = None) -> DataFrame:
    """I-20: ``service_id, handler_class_fqn, dao_method, pattern, tables, stores`` from what a handler's method reads and writes."""
    group = ["service_id", "handler_class_fqn", "dao_method"]
    sets = lambda df: df.groupBy(*group).agg(
        F.sort_array(F.collect_set("table_or_entity")).alias("tables"), F.sort_array(F.collect_set("store_type")).alias("stores"), F.count("*").alias("rows")
    )
    writes = sets(accesses.filter("operation = 'WRITE'")).filter("rows >= 2")
    pattern = F.when(F.size("stores") > 1, "CROSS_STORE_WRITE").when(F.size("tables") > 1, "MULTI_TABLE_DOMAIN").otherwise("DUAL_WRITE_SAME_HANDLER")
    reads = sets(accesses.filter("operation = 'READ'")).filter(F.size("stores") >= 2)
    cols = [*group, "pattern", "tables", "stores"]
    out = writes.withColumn("pattern", pattern).select(*cols).union(reads.withColumn("pattern", F.lit("DUAL_READ_FALLBACK")).select(*cols))
    if mirrors is not None:
        out = out.union(sets(mirrors).withColumn("pattern", F.lit("ASYNC_MIRROR")).select(*cols))
    return out


def all_scenarios(indexed: DataFrame, rules: DataFrame) -> DataFrame:
    """F-14: a rule with flow steps replaces the indexed scenario of its id, one without only fills in."""
    order = F.when(F.size(F.coalesce("flow_steps", F.array().cast("array<string>"))) > 0, 0).otherwise(2)
    both = indexed.withColumn("flow_steps", F.lit(None).cast("array<string>")).withColumn("rank", F.lit(1)).unionByName(rules.withColumn("rank", order))
    return distinct_on(both, ["service_id", "scenario_id"], [F.asc("rank"), F.asc("pattern")]).drop("rank")


def _names(table: Column) -> Column:
    return F.array_distinct(F.array(normalize_table(table), normalize_table(entity_name(table))))


def match_scenarios(scenarios: DataFrame, accesses: DataFrame) -> DataFrame:
    """F-15: ``service_id, scenario_id, handler_class_fqn, matched_by``; a scenario's id is unique in its service.

    A co-table scenario needs all of its PRIMARY, required and secondary
    participants written by the handler; others match by handler scope, else by
    a participant that the handler touches.

    Scenarios and handlers meet in the tables that both name, so nothing is
    compared that shares none; a co-table scenario matches where as many of its
    participants are met as it needs.
    """
    key = ["service_id", "scenario_id"]
    names = accesses.select("service_id", "handler_class_fqn", F.explode(_names(F.col("table_or_entity"))).alias("name"), (F.col("operation") == "WRITE").alias("written"))
    index = names.groupBy("service_id", "name", "handler_class_fqn").agg(F.max("written").alias("written"))
    name = lambda p: normalize_table(p["physicalName"])

    both = F.col("pattern").isin(*CO_TABLE)
    needed = F.filter("participants", lambda p: p["role"].isin(*WRITTEN_ROLES))
    co = scenarios.filter(both).select(*key, F.size(needed).alias("needs"), F.posexplode(needed).alias("nth", "p"))
    co = co.select(*key, "needs", "nth", F.explode(F.array(name(F.col("p")), F.concat(name(F.col("p")), F.lit("entity")))).alias("name"))
    met = co.join(index.filter("written"), ["service_id", "name"]).groupBy(*key, "needs", "handler_class_fqn").agg(F.count_distinct("nth").alias("met"))
    found = met.filter("met = needs").select(*key, "handler_class_fqn", F.lit("CO_TABLE").alias("matched_by"))

    rest = scenarios.filter(~F.coalesce(both, F.lit(False)))
    handlers = accesses.select("service_id", "handler_class_fqn").distinct()
    scoped = rest.filter("scope_kind = 'HANDLER'").select(*key, F.split_part("scope_ref", F.lit("#"), F.lit(1)).alias("handler_class_fqn")).distinct()
    by_scope = scoped.join(handlers, ["service_id", "handler_class_fqn"]).select(*key, "handler_class_fqn", F.lit("HANDLER").alias("matched_by"))
    listed = rest.select(*key, F.explode("participants").alias("p")).select(*key, name(F.col("p")).alias("name")).distinct()
    by_table = listed.join(index, ["service_id", "name"]).select(*key, "handler_class_fqn").distinct()
    by_table = by_table.join(by_scope, [*key, "handler_class_fqn"], "left_anti").select(*key, "handler_class_fqn", F.lit("TABLE").alias("matched_by"))
    return found.union(by_scope).union(by_table)


def consistency_gaps(accesses: DataFrame, scenarios: DataFrame, mirrors: DataFrame | None = None) -> DataFrame:
    """F-16: ``gap_type, service_id, subject``."""
    writes = accesses.filter("operation = 'WRITE'").groupBy("service_id", "handler_class_fqn", "dao_method").agg(F.count("*").alias("writes")).filter("writes >= 2")
    scoped = scenarios.filter("scope_kind = 'HANDLER'").select("service_id", F.split_part("scope_ref", F.lit("#"), F.lit(1)).alias("handler_class_fqn")).distinct()
    dual = writes.join(scoped, ["service_id", "handler_class_fqn"], "left_anti").select(
        F.lit("UNDOCUMENTED_DUAL_WRITE").alias("gap_type"), "service_id", F.concat_ws("#", "handler_class_fqn", "dao_method").alias("subject")
    )
    handlers = accesses.select("service_id", "handler_class_fqn").distinct()
    orphan = scenarios.filter("source = 'RULE_PACK' AND scope_kind = 'HANDLER'").withColumn("handler_class_fqn", F.split_part("scope_ref", F.lit("#"), F.lit(1)))
    out = dual.union(orphan.join(handlers, ["service_id", "handler_class_fqn"], "left_anti").select(F.lit("ORPHAN_RULE_PACK"), "service_id", "scenario_id"))
    if mirrors is not None:
        known = accesses.select("service_id", normalize_table("table_or_entity").alias("t")).distinct()
        loose = mirrors.withColumn("t", normalize_table("table_or_entity")).join(known, ["service_id", "t"], "left_anti")
        out = out.union(loose.select(F.lit("UNLINKED_MIRROR"), "service_id", "table_or_entity"))
    return out.distinct()


def overlay_hints(hints: DataFrame) -> DataFrame:
    """F-18: ``hints(step, scenario_id, pattern, participants array<string>, curated)``.

    An inferred hint goes if a curated one of its step has the same pattern and
    participants, and any hint goes if its participants are a proper part of
    another's with that pattern.  Only hints of one step and pattern meet.
    """
    flat = hints.withColumn("have", F.array_distinct("participants"))
    other = flat.select("step", "pattern", F.col("scenario_id").alias("o_id"), F.col("have").alias("o_have"), F.col("curated").alias("o_curated"))
    inside = F.size(F.array_except("have", "o_have")) == 0
    equal = inside & (F.size("have") == F.size("o_have"))
    beaten = (~F.col("curated") & F.col("o_curated") & equal) | (inside & (F.size("have") < F.size("o_have")))
    gone = flat.join(other, ["step", "pattern"]).filter((F.col("scenario_id") != F.col("o_id")) & beaten).select("step", "scenario_id").distinct()
    return hints.join(gone, ["step", "scenario_id"], "left_anti").select(*hints.columns)


#: Most flow-step rules.
MOST_RULES = 1000


def enrich_hints(steps: DataFrame, rules: DataFrame, matches: DataFrame, scenarios: DataFrame) -> DataFrame:
    """F-17: flow steps of a step's handler by rules on its class, and the scenarios matched there; else all of the service.

    ``steps(service_id, handler_class_fqn)``, ``rules(class_contains, flow_step)``.
    Rules are configuration, at most :data:`MOST_RULES` of them, and become one
    expression, so no steps are shuffled or multiplied for them.
    """
    known = rules.select("class_contains", "flow_step").dropna().distinct().limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hit = F.array(*(F.when(F.contains("handler_class_fqn", F.lit(r[0])), F.lit(r[1])) for r in known)).cast("array<string>")
    named = steps.withColumn("flow_step", F.explode_outer(F.filter(hit, lambda x: x.isNotNull())))
    flow = named.groupBy("service_id", "handler_class_fqn").agg(F.sort_array(F.collect_set("flow_step")).alias("flow_steps"))
    direct = matches.groupBy("service_id", "handler_class_fqn").agg(F.sort_array(F.collect_set("scenario_id")).alias("direct"))
    every = scenarios.groupBy("service_id").agg(F.sort_array(F.collect_set("scenario_id")).alias("every"))
    out = flow.join(direct, ["service_id", "handler_class_fqn"], "left").join(every, "service_id", "left")
    return out.select("service_id", "handler_class_fqn", "flow_steps", F.coalesce("direct", "every", F.array().cast("array<string>")).alias("scenarios"))


def derive_invariants(rules: DataFrame, scenarios: DataFrame, writes: DataFrame, gates: DataFrame) -> DataFrame:
    """F-19: ``service_id, kind, description``: of rules, scenarios, co-writes and gates; the first source of a description stays."""
    cols = ["service_id", "kind", "description"]
    co = writes.filter("operation = 'WRITE'").groupBy("service_id", "handler_class_fqn").agg(F.sort_array(F.collect_set("table_or_entity")).alias("t")).filter(F.size("t") >= 2)
    parts = [
        rules.select(*cols, F.lit(0).alias("rank")),
        scenarios.select("service_id", F.col("pattern").alias("kind"), F.concat_ws(": ", "pattern", "scope_ref").alias("description"), F.lit(1)),
        co.select("service_id", F.lit("ROW_EXISTS"), F.concat_ws(" and ", "t"), F.lit(2)),
        gates.filter("gate_kind = 'BUSINESS_RULE'").select("service_id", F.lit("STATE_TRANSITION"), "gate_key", F.lit(3)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return distinct_on(out, cols, [F.asc("rank")]).select(*cols, "rank")


def downstream_gates(writers: DataFrame, gates: DataFrame) -> DataFrame:
    """F-20: ``writers(hop, table_or_entity)`` and business gates of later hops ``gates(hop, gate_key)`` whose key starts with the table's name."""
    w = writers.select(F.col("hop").alias("writer_hop"), normalize_table(entity_name("table_or_entity")).alias("prefix")).distinct()
    g = gates.filter("gate_kind = 'BUSINESS_RULE'").select(F.col("hop").alias("gate_hop"), "gate_key", normalize_table(F.split_part("gate_key", F.lit("."), F.lit(1))).alias("prefix"))
    return w.join(g, "prefix").filter("gate_hop > writer_hop")


def batch_hints(triggers: DataFrame, accesses: DataFrame, kinds: tuple[str, ...] = ("CRON",)) -> DataFrame:
    """F-21: handlers of these trigger kinds that write; extractors name CRON_SPRING and CRON_K8S, so the default finds none."""
    cron = triggers.filter(F.col("trigger_kind").isin(*kinds)).select("service_id", F.split_part("linked_handler_fqn", F.lit("#"), F.lit(1)).alias("handler_class_fqn")).distinct()
    return accesses.filter("operation = 'WRITE'").join(cron, ["service_id", "handler_class_fqn"], "left_semi").select("service_id", "handler_class_fqn", "table_or_entity").distinct()


def lag_hints(participants: DataFrame, topology: DataFrame) -> DataFrame:
    """F-21: the longest configured lag between two stores of a scenario; ``participants(scenario_id, store)``, ``topology(from_store, to_store, lag_ms)``."""
    one, two = participants.select("scenario_id", F.col("store").alias("from_store")), participants.select("scenario_id", F.col("store").alias("to_store"))
    pairs = one.join(topology, "from_store").join(two, ["scenario_id", "to_store"])
    return best_wins(pairs, ["scenario_id"], "lag_ms", [F.asc("from_store"), F.asc("to_store")])
