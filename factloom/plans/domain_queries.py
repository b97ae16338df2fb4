"""More queries of the domain operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, catalog, consistency, contracts, entry_flow, graph_projection, messaging
from ..sources import extract, files
from ..streaming import jobs
from .adapters import base, fact
from .queries import AS_OF, query


@query("SELECT id, CASE WHEN regexp_matches(s, '(Repository|Repo|Dao)$') THEN regexp_replace(s, '(Repository|Repo|Dao)$', '') END AS entity, regexp_replace(s, 'Entity$', '') AS name FROM (SELECT id, regexp_replace(symbol_fqn, '^.*\\.', '') || CASE WHEN node_type = 'CLASS' THEN 'Repo' ELSE 'Entity' END AS s FROM f_nodes WHERE symbol_fqn IS NOT NULL)")
def c08_entities(spark, sf):
    n = fact(spark, sf, "nodes").filter("symbol_fqn IS NOT NULL")
    s = F.concat("symbol_fqn", F.when(F.col("node_type") == "CLASS", "Repo").otherwise("Entity"))
    return n.select("id", T.accessor_entity(s).alias("entity"), T.entity_name(s).alias("name"))


@query("SELECT c_custkey, coalesce(n_name, c_mktsegment) AS topic FROM customer LEFT JOIN nation ON upper(trim(n_name)) = upper(trim(c_mktsegment))")
def c10_aliases(spark, sf):
    aliases = base(spark, sf, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("topic"))
    c = base(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("topic"))
    return messaging.canonical_topics(c, aliases)


@query("SELECT id FROM f_nodes WHERE symbol_fqn IS NOT NULL AND starts_with(symbol_fqn, 'com.acme.n1') AND regexp_matches(symbol_fqn, '^[\\w.$]+$')")
def c18_c28_packages(spark, sf):
    return fact(spark, sf, "nodes").filter(T.in_package("symbol_fqn", "com.acme.n1") & T.is_class_fqn("symbol_fqn")).select("id")


@query("SELECT service_id, symbol_fqn FROM f_symbols WHERE NOT regexp_matches(symbol_fqn, '(Test|IT|IntTest)$') AND starts_with(file_path, 'src/main/')")
def c19_c20_scopes(spark, sf):
    return fact(spark, sf, "symbols").filter(T.is_production_handler("symbol_fqn") & T.in_source_roots("file_path", ["src/main/"])).select("service_id", "symbol_fqn")


@query("SELECT service_id, gate_key, CASE WHEN l.v IS NULL THEN 'UNKNOWN' WHEN required_value = 'true' AND lower(l.v) = 'true' OR required_value = l.v THEN 'OPEN' ELSE 'CLOSED' END AS state FROM f_gates LEFT JOIN (SELECT 'gate.O' AS k, 'TRUE' AS v UNION ALL SELECT 'gate.F', 'y') l ON l.k = gate_key")
def c22_f38_live_gates(spark, sf):
    live = spark.createDataFrame([("gate.O", "TRUE"), ("gate.F", "y")], "config_key string, live_value string")
    return messaging.live_gates(fact(spark, sf, "gates"), live).select("service_id", "gate_key", "state")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'YAML+RULE_PACK' ELSE 'RULE_PACK+YAML' END AS evidence FROM part")
def c26_evidence(spark, sf):
    tags = F.when(F.col("p_size") > 25, "YAML").otherwise("RULE_PACK+YAML")
    return base(spark, sf, "part").select("p_partkey", T.append_evidence(tags, "RULE_PACK").alias("evidence"))


@query("SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN 0 ELSE 1 END AS n FROM events")
def c32_json_lists(spark, sf):
    listed = T.json_structs(F.concat(F.lit("["), "props", F.lit("]")), "k:long")
    return base(spark, sf, "events").select("event_id", F.size(F.filter(listed, lambda x: x["k"].isNotNull())).alias("n"))


@query("""SELECT 'svc' || CAST(s_suppkey AS STRING) || '::class::a.F' AS from_node, 'svc' || CAST(c_custkey AS STRING) || '::class::b.I' || CAST(c_custkey AS STRING) AS to_node FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > 9000""")
def g20_list_routes(spark, sf):
    f = base(spark, sf, "supplier").select(F.concat(F.lit("svc"), "s_suppkey").alias("factory_service"), F.lit("a.F").alias("factory_fqn"), F.concat(F.lit("T"), "s_nationkey").alias("list_type"))
    i = base(spark, sf, "customer").select(F.concat(F.lit("svc"), "c_custkey").alias("impl_service"), F.concat(F.lit("b.I"), "c_custkey").alias("impl_fqn"), F.concat(F.lit("T"), "c_nationkey").alias("interface_fqn"), (F.col("c_acctbal") <= 9000).alias("abstract"))
    return graph_projection.project_list_routes(f, i).select("from_node", "to_node")


@query("SELECT bean, arg_min(class_fqn, (r, class_fqn)) AS class_fqn FROM (SELECT 'n' || CAST(c_nationkey AS STRING) AS bean, 'a.Customer' || CAST(c_custkey AS STRING) AS class_fqn, 1 AS r FROM customer UNION ALL SELECT 'supplier' || CAST(s_suppkey AS STRING), 'a.Supplier' || CAST(s_suppkey AS STRING), 2 FROM supplier UNION ALL SELECT 'n3', 'rule.N3', 0) GROUP BY 1")
def g23_beans(spark, sf):
    c = base(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("name"), F.concat(F.lit("a.Customer"), "c_custkey").alias("class_fqn"))
    s = base(spark, sf, "supplier").select(F.lit(None).cast("string").alias("name"), F.concat(F.lit("a.Supplier"), "s_suppkey").alias("class_fqn"))
    return graph_projection.bean_index(c.union(s), spark.createDataFrame([("n3", "rule.N3")], "bean string, class_fqn string"))


@query("""SELECT DISTINCT service_id || '::maven::' || module_path AS from_node, 'gav::' || to_group || ':' || to_artifact || ':' || coalesce(to_version, 'UNRESOLVED') AS to_node FROM f_dependencies""")
def g28_maven_edges(spark, sf):
    d = fact(spark, sf, "dependencies").withColumns({"confidence": F.lit(0.9), "cross_repo": F.lit(False), "linked_service_id": F.lit(None).cast("string")})
    m = spark.createDataFrame([], "service_id string, module_path string, parent_path string")
    return graph_projection.project_maven(m, d).select("from_node", "to_node")


@query(f"""WITH l AS (SELECT service_id, arg_max(status, (enqueued_at, job_id)) AS status, arg_max(coalesce(completed_at, TIMESTAMP '1970-01-01'), (enqueued_at, job_id)) AS done FROM f_runs GROUP BY 1)
SELECT service_id, repo, CASE WHEN status IS NULL THEN 'NOT_INDEXED' WHEN status IN ('RUNNING', 'QUEUED') THEN 'INDEXING' WHEN status <> 'COMPLETE' THEN 'NOT_INDEXED' WHEN done > {AS_OF} - INTERVAL 60 MINUTE THEN 'CURRENT' ELSE 'STALE' END AS freshness FROM f_registry LEFT JOIN l USING (service_id) WHERE enabled""")
def e02_org_status(spark, sf):
    return analysis.org_status(fact(spark, sf, "registry"), fact(spark, sf, "runs"), F.expr(AS_OF)).select("service_id", "repo", "freshness")


@query("SELECT o.* FROM f_outbound o WHERE http_method IS NOT NULL AND split_part(source_symbol, '#', 1) IN (SELECT 'com.acme.n1.Supplier' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_acctbal > 0) ")
def e08_downstream(spark, sf):
    s = base(spark, sf, "supplier").filter("s_acctbal > 0")
    changed = s.select(F.concat(F.lit("svc"), "s_suppkey").alias("service_id"), F.concat(F.lit("com.acme.n1.Supplier"), "s_suppkey").alias("symbol_fqn"))
    return analysis.downstream_calls(changed, fact(spark, sf, "outbound"))


@query(r"""WITH c AS (SELECT DISTINCT service_id, symbol_fqn, regexp_replace(symbol_fqn, '^.*\.', '') AS simple FROM f_symbols WHERE starts_with(file_path, 'src/main/java')), t AS (SELECT DISTINCT service_id, regexp_replace(symbol_fqn, '^.*\.', '') AS test FROM f_symbols WHERE starts_with(file_path, 'src/test/java'))
SELECT service_id, symbol_fqn FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.service_id = c.service_id AND (test IN (simple || 'Test', simple || 'Tests', simple || 'IT') OR starts_with(test, 'Test' || simple)))""")
def e11_missing_tests(spark, sf):
    s = fact(spark, sf, "symbols")
    return analysis.missing_tests(s, s.filter(F.startswith("file_path", F.lit("src/test/java"))))


@query("""WITH d AS (SELECT DISTINCT to_group, to_artifact, to_version AS version FROM f_dependencies WHERE service_id = 'svc7' AND commit_sha = 'new' AND resolved),
b AS (SELECT to_group, to_artifact, min(to_version) AS previous FROM f_dependencies WHERE service_id = 'svc7' AND commit_sha = 'old' GROUP BY 1, 2),
o AS (SELECT DISTINCT d.to_group, d.to_artifact, d.version, x.service_id FROM d JOIN f_dependencies x ON x.to_group = d.to_group AND x.to_artifact = d.to_artifact AND x.service_id <> 'svc7' AND x.commit_sha = 'new' AND x.to_version <> d.version),
n AS (SELECT to_group, to_artifact, version, count(*) AS c FROM o GROUP BY ALL)
SELECT to_artifact, version, previous, coalesce(c, 0) AS others FROM d LEFT JOIN b USING (to_group, to_artifact) LEFT JOIN n USING (to_group, to_artifact, version) WHERE (previous IS NULL OR previous <> version) AND (previous IS NOT NULL OR c IS NOT NULL)""")
def e12_artifact_impact(spark, sf):
    d = fact(spark, sf, "dependencies")
    when = F.when(F.col("commit_sha") == "new", F.lit(2)).otherwise(F.lit(1))
    runs = d.select("service_id", "commit_sha", F.lit("COMPLETE").alias("status"), when.alias("completed_at")).distinct()
    extra = base(spark, sf, "supplier").select(F.concat(F.lit("svc"), "s_suppkey").alias("service_id"), F.lit("new").alias("commit_sha"), F.lit("COMPLETE").alias("status"), F.lit(2).alias("completed_at"))
    out = analysis.artifact_impact(d, runs.union(extra), "svc7", "new")
    return out.select("to_artifact", "version", "previous", F.coalesce(F.size("downstream"), F.lit(0)).cast("long").alias("others"))


@query("SELECT service_id, json_extract_string(metadata, '$.description') AS description, NULL::VARCHAR AS owner, json_extract_string(metadata, '$.domain') AS domain FROM f_registry")
def e14_descriptions(spark, sf):
    return analysis.service_description(fact(spark, sf, "registry"))


@query("SELECT job_id, 'QUEUED' AS status, 1 AS attempt FROM f_runs WHERE status = 'DLQ'")
def e17_replay(spark, sf):
    return analysis.replayable(fact(spark, sf, "runs")).select("job_id", "status", F.col("attempt").cast("int").alias("attempt"))


@query("SELECT r.short_id, r.role, g.service_name, count(*) AS n FROM (SELECT 'svc' || CAST(c_nationkey AS STRING) AS service_id, 'PDN_S.N' || CAST(c_nationkey AS STRING) AS short_id, 'SUBSCRIBE' AS role FROM customer) r JOIN f_registry g USING (service_id) WHERE g.enabled GROUP BY ALL")
def f02_org_inventory(spark, sf):
    r = base(spark, sf, "customer").select(F.concat(F.lit("svc"), "c_nationkey").alias("service_id"), F.concat(F.lit("PDN_S.N"), "c_nationkey").alias("short_id"), F.lit("SUBSCRIBE").alias("role"), F.lit("SUBSCRIPTION").alias("resource_kind"))
    return messaging.inventory(r, fact(spark, sf, "registry")).groupBy("short_id", "role", "service_name").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT id, symbol_fqn FROM f_nodes), near AS (SELECT DISTINCT t.symbol_fqn AS c FROM f_edges e JOIN n s ON s.id = e.from_node JOIN n t ON t.id = e.to_node WHERE e.edge_type IN ('DEPENDS_ON', 'INVOKES') AND starts_with(s.symbol_fqn, 'com.acme.n1.')),
g AS (SELECT id AS guarded_symbol, symbol_fqn || '#m' AS s, 'k' AS gate_key FROM f_nodes WHERE symbol_fqn IS NOT NULL)
SELECT DISTINCT s AS guarded_symbol FROM g WHERE starts_with(s, 'com.acme.n1.') OR split_part(s, '#', 1) IN (SELECT c FROM near)""")
def f04_package_gates(spark, sf):
    nodes, edges = fact(spark, sf, "nodes"), fact(spark, sf, "edges")
    gates = nodes.filter("symbol_fqn IS NOT NULL").select(F.concat("symbol_fqn", F.lit("#m")).alias("guarded_symbol"), F.lit("k").alias("gate_key"))
    return messaging.gates_of_package(gates, nodes, edges, "com.acme.n1.").select("guarded_symbol")


_STEPS = """h AS (SELECT DISTINCT service_id, handler_class_fqn AS handler FROM f_accesses), w AS (SELECT service_id, handler_class_fqn AS handler, count(DISTINCT table_or_entity) FILTER (operation = 'READ') AS n_reads, count(DISTINCT table_or_entity) FILTER (operation = 'WRITE') AS n_writes FROM f_accesses GROUP BY 1, 2),
s AS (SELECT service_id, linked_class_fqn AS handler, count(DISTINCT payload_proto) AS n_schemas FROM f_schemas GROUP BY 1, 2), g AS (SELECT service_id, split_part(guarded_symbol, '#', 1) AS handler, count(DISTINCT gate_key) AS n_gates FROM f_gates GROUP BY 1, 2),
x AS (SELECT h.*, n_reads, n_writes, coalesce(n_schemas, 0) AS n_schemas, coalesce(n_gates, 0) AS n_gates FROM h LEFT JOIN w USING (service_id, handler) LEFT JOIN s USING (service_id, handler) LEFT JOIN g USING (service_id, handler))"""


def _steps(spark, sf):
    a = fact(spark, sf, "accesses")
    r = a.select("service_id", F.col("handler_class_fqn").alias("linked_class_fqn"), F.lit("PUBLISH").alias("role"), F.lit("T").alias("short_id"), F.lit("{}").alias("attributes")).distinct()
    return messaging.flow_steps(r, fact(spark, sf, "schemas"), a, fact(spark, sf, "gates")), r


@query("WITH " + _STEPS + " SELECT * FROM x")
def f05_flow_steps(spark, sf):
    steps, _ = _steps(spark, sf)
    return steps.select("service_id", "handler", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("reads", "writes", "schemas", "gates")))


@query("WITH " + _STEPS + " SELECT 'MISSING_SCHEMA' AS gap_type, service_id, handler AS subject FROM x WHERE n_schemas = 0 UNION SELECT 'UNGUARDED_STEP', service_id, handler FROM x WHERE n_gates = 0 AND n_writes > 0")
def f06_flow_gaps(spark, sf):
    return messaging.flow_gaps(*_steps(spark, sf))


@query("SELECT DISTINCT n_name || 'x' AS repo FROM nation WHERE n_name || 'x' NOT IN (SELECT repo FROM f_registry) UNION SELECT DISTINCT n_name FROM nation WHERE n_name NOT IN (SELECT repo FROM f_registry)")
def f10_missing_repos(spark, sf):
    n = base(spark, sf, "nation")
    return messaging.missing_repos(n.select(F.col("n_name").alias("repo")).union(n.select(F.concat("n_name", F.lit("x")))), fact(spark, sf, "registry"))


@query("SELECT DISTINCT service_id FROM f_resources WHERE role = 'SUBSCRIBE' AND linked_class_fqn IS NOT NULL")
def f08_runtime_subscribers(spark, sf):
    none = spark.createDataFrame([], "service_id string, trigger_kind string, path_pattern string")
    return messaging.runtime_subscribers(fact(spark, sf, "resources"), none, fact(spark, sf, "registry"))


@query("SELECT service_id, scenario_id, CASE WHEN c = 'BUILDING' THEN 'RULE' ELSE 'INDEXED' END AS pattern FROM (SELECT 'svc' || CAST(c_custkey AS STRING) AS service_id, 'x' AS scenario_id, c_mktsegment AS c FROM customer)")
def f14_scenarios(spark, sf):
    c = base(spark, sf, "customer").select(F.concat(F.lit("svc"), "c_custkey").alias("service_id"), F.lit("x").alias("scenario_id"), "c_mktsegment")
    indexed = c.select("service_id", "scenario_id", F.lit("INDEXED").alias("pattern"))
    steps = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    rules = c.select("service_id", "scenario_id", F.lit("RULE").alias("pattern"), steps.alias("flow_steps"))
    return consistency.all_scenarios(indexed, rules).select("service_id", "scenario_id", "pattern")


@query("""WITH w AS (SELECT service_id, handler_class_fqn, list(DISTINCT lower(replace(table_or_entity, '_', ''))) FILTER (operation = 'WRITE') AS written FROM f_accesses GROUP BY 1, 2)
SELECT 'svc' || CAST(s_suppkey AS STRING) AS service_id, handler_class_fqn, 'CO_TABLE' AS matched_by FROM supplier JOIN w ON w.service_id = 'svc' || CAST(s_suppkey AS STRING) WHERE list_contains(written, 'part' || CAST(s_suppkey * 3 AS STRING)) OR list_contains(written, 'part' || CAST(s_suppkey * 3 AS STRING) || 'entity')""")
def f15_matches(spark, sf):
    part = F.struct(F.lit("M").alias("storeType"), F.concat(F.lit("Part_"), F.col("s_suppkey") * 3).alias("physicalName"), F.lit("PRIMARY").alias("role"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("lagClass"))
    s = base(spark, sf, "supplier").select(F.concat(F.lit("svc"), "s_suppkey").alias("service_id"), F.lit("x").alias("scenario_id"), F.lit("CO_TABLE_INVARIANT").alias("pattern"), F.lit("TABLE").alias("scope_kind"), F.lit("").alias("scope_ref"), F.array(part).alias("participants"))
    return consistency.match_scenarios(s, fact(spark, sf, "accesses")).select("service_id", "handler_class_fqn", "matched_by")


@query("SELECT service_id, 'ROW_EXISTS' AS kind, count(*) AS n FROM (SELECT service_id, handler_class_fqn FROM f_accesses WHERE operation = 'WRITE' GROUP BY 1, 2 HAVING count(DISTINCT table_or_entity) >= 2) GROUP BY 1 UNION ALL SELECT service_id, 'STATE_TRANSITION', count(DISTINCT gate_key) FROM f_gates WHERE gate_kind = 'BUSINESS_RULE' GROUP BY 1")
def f19_invariants(spark, sf):
    none = spark.createDataFrame([], "service_id string, kind string, description string")
    scenarios = spark.createDataFrame([], "service_id string, pattern string, scope_ref string")
    out = consistency.derive_invariants(none, scenarios, fact(spark, sf, "accesses"), fact(spark, sf, "gates"))
    return out.groupBy("service_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT a.l_linenumber AS writer_hop, b.l_linenumber AS gate_hop, count(*) AS n FROM (SELECT DISTINCT l_linenumber, l_returnflag FROM lineitem) a JOIN (SELECT DISTINCT l_linenumber, l_returnflag, l_linestatus FROM lineitem) b ON lower(a.l_returnflag) = lower(b.l_returnflag) AND b.l_linenumber > a.l_linenumber GROUP BY 1, 2")
def f20_downstream_gates(spark, sf):
    li = base(spark, sf, "lineitem")
    w = li.select(F.col("l_linenumber").alias("hop"), F.col("l_returnflag").alias("table_or_entity")).distinct()
    g = li.select(F.col("l_linenumber").alias("hop"), F.concat_ws(".", "l_returnflag", "l_linestatus").alias("gate_key"), F.lit("BUSINESS_RULE").alias("gate_kind")).distinct()
    return consistency.downstream_gates(w, g).groupBy("writer_hop", "gate_hop").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT service_id, handler_class_fqn, table_or_entity FROM f_accesses WHERE operation = 'WRITE' AND handler_class_fqn IN (SELECT 'com.acme.H' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_acctbal > 5000)")
def f21_batch_hints(spark, sf):
    s = base(spark, sf, "supplier").filter("s_acctbal > 5000")
    t = s.select(F.concat(F.lit("svc"), "s_suppkey").alias("service_id"), F.lit("CRON_K8S").alias("trigger_kind"), F.concat(F.lit("com.acme.H"), F.col("s_suppkey").cast("string"), F.lit("#run")).alias("linked_handler_fqn"))
    return consistency.batch_hints(t, fact(spark, sf, "accesses"), ("CRON_SPRING", "CRON_K8S"))


@query("SELECT t.trigger_id, count(DISTINCT a.table_or_entity) FILTER (a.operation = 'READ') AS n_reads, count(DISTINCT a.table_or_entity) FILTER (a.operation = 'WRITE') AS n_writes FROM f_triggers t LEFT JOIN f_accesses a ON a.service_id = t.service_id AND a.handler_class_fqn = 'com.acme.H' || substring(t.service_id, 4) GROUP BY 1")
def f24_entry_traces(spark, sf):
    t = fact(spark, sf, "triggers").withColumn("linked_handler_fqn", F.concat(F.lit("com.acme.H"), F.substring("service_id", 4, 20), F.lit("#on")))
    gates = fact(spark, sf, "gates")
    out = entry_flow.trace_entries(t, fact(spark, sf, "accesses"), gates, fact(spark, sf, "edges"), fact(spark, sf, "nodes"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"n_{c}")
    return out.select("trigger_id", n("reads"), n("writes"))


@query("SELECT trigger_id, CASE WHEN trigger_kind = 'PUBSUB_SUBSCRIBE' THEN path_pattern END AS topic FROM f_triggers")
def f25_chain_topics(spark, sf):
    none = spark.createDataFrame([], "service_id string, role string, linked_class_fqn string, short_id string")
    return entry_flow.chain_topics(fact(spark, sf, "triggers"), none)


@query("SELECT count(*) AS routes FROM supplier")
def f26_routing_fallback(spark, sf):
    routes = base(spark, sf, "supplier").select(F.concat(F.lit("F"), "s_suppkey").alias("factory_class_fqn"), F.col("s_name").alias("routing_key"))
    return entry_flow.processor_routing(routes, fact(spark, sf, "edges"), fact(spark, sf, "nodes"), "region::1").agg(F.count("*").alias("routes"))


@query("WITH l AS (SELECT service_id, arg_max(commit_sha, (indexed_at, commit_sha)) AS commit_sha FROM f_symbols GROUP BY 1) SELECT service_id, symbol_fqn FROM f_symbols JOIN l USING (service_id, commit_sha)")
def f28_f45_latest_facts(spark, sf):
    return contracts.at_latest_commit(fact(spark, sf, "symbols")).select("service_id", "symbol_fqn")


@query("SELECT physical_name FROM f_objects WHERE store_type = 'MARIADB' ORDER BY service_id, physical_name LIMIT 50 OFFSET 50")
def f32_catalog_page(spark, sf):
    return catalog.catalog_page(fact(spark, sf, "objects"), 50, 50, store_type="MARIADB").items.select("physical_name")


@query("SELECT service_id, entity_fqn, min(library_id) AS library_id FROM (SELECT 'svc' || CAST(s_suppkey AS STRING) AS service_id, 'e.Part' || CAST(s_suppkey AS STRING) AS entity_fqn, 'lib' || CAST(p_size AS STRING) AS library_id FROM supplier JOIN part ON p_partkey = s_suppkey) GROUP BY 1, 2")
def f33_resolve(spark, sf):
    names = base(spark, sf, "supplier").select(F.concat(F.lit("svc"), "s_suppkey").alias("service_id"), F.concat(F.lit("e.Part"), "s_suppkey").alias("entity_fqn"))
    objects = base(spark, sf, "part").select(F.concat(F.lit("lib"), "p_size").alias("service_id"), F.concat(F.lit("e.Part"), "p_partkey").alias("entity_fqn"), F.col("p_name").alias("physical_name"), F.lit("M").alias("store_type"))
    pins = spark.createDataFrame([], "service_id string, library_id string, position int")
    return catalog.resolve_entities(names, objects, pins).select("service_id", "entity_fqn", "library_id")


@query(f"SELECT service_id, max(ts) AS indexed_at, CASE WHEN max(ts) IS NULL THEN 'LIBRARY_NOT_INDEXED' WHEN max(ts) < {AS_OF} - INTERVAL 24 HOUR THEN 'LIBRARY_STALE' END AS gap_type FROM f_registry LEFT JOIN events ON 'svc' || CAST(user_id AS STRING) = service_id GROUP BY 1")
def f34_stale_libraries(spark, sf):
    seen = base(spark, sf, "events").select(F.concat(F.lit("svc"), "user_id").alias("service_id"), F.col("ts").alias("indexed_at"))
    return catalog.library_staleness(fact(spark, sf, "registry"), seen, F.expr(AS_OF))


@query("SELECT access_id, CASE WHEN r THEN 'renamed' ELSE t END AS physical, least(c + CASE WHEN NOT r AND d THEN 0.05 ELSE 0 END, 1.0) AS confidence FROM (SELECT p_partkey AS access_id, 'Part_' || CAST(p_partkey AS STRING) AS t, p_partkey < 100 AS r, 0.9 AS c, p_size > 25 AS d FROM part)")
def f36_merged_accesses(spark, sf):
    p = base(spark, sf, "part")
    t = F.concat(F.lit("Part_"), "p_partkey")
    a = p.select(F.col("p_partkey").alias("access_id"), t.alias("table_or_entity"), F.lit("x").alias("accessor_fqn"), F.lit("m").alias("dao_method"), F.lit("M").alias("store_type"), F.lit(0.9).alias("confidence"), F.lit("E").alias("evidence_source"))
    rules = p.filter("p_partkey < 100").select(F.concat(F.lit("r"), "p_partkey").alias("rule_id"), F.lit("none").alias("entity"), t.alias("table_name"), F.lit("n").alias("accessor_suffix"), F.lit("n").alias("method"), F.lit("renamed").alias("set_name"), F.lit(None).cast("string").alias("set_store"))
    sure = p.filter("p_size > 25").select(t.alias("physical_name"), F.lit("DDL_CONFIRMED").alias("validation_status"))
    return catalog.merge_accesses(a, rules, sure).select("access_id", "physical", F.round("confidence", 6).alias("confidence"))


@query("SELECT dependency_id, to_artifact FROM f_dependencies WHERE scope IN ('compile', 'runtime') AND NOT transitive AND to_group = 'com.g3'")
def f41_dependencies(spark, sf):
    return catalog.maven_dependencies(fact(spark, sf, "dependencies"), "runtime", True, "com.g3").select("dependency_id", "to_artifact")


@query("SELECT module_path, count(DISTINCT to_group || ':' || to_artifact || ':' || coalesce(to_version, 'UNRESOLVED')) AS artifacts, count(*) FILTER (NOT resolved) AS unresolved FROM f_dependencies GROUP BY 1")
def f43_artifacts(spark, sf):
    d = fact(spark, sf, "dependencies")
    tree = d.select(F.lit("r1").alias("root"), "module_path", F.lit(1).alias("depth")).distinct()
    return catalog.module_artifacts(tree, d).select("module_path", F.size("artifacts").cast("long").alias("artifacts"), "unresolved")


@query("SELECT service_name, max(enabled) AS enabled FROM (SELECT service_name, enabled FROM f_registry UNION ALL SELECT s_name, true FROM supplier) GROUP BY 1")
def f46_register(spark, sf):
    r = fact(spark, sf, "registry")
    new = base(spark, sf, "supplier").select(F.concat(F.lit("sup"), "s_suppkey").alias("service_id"), F.lit("acme").alias("org_id"), F.lit("supply").alias("repo"), F.col("s_name").alias("service_name"), F.lit("service").alias("module_type"), F.lit(True).alias("enabled"), F.lit("{}").alias("metadata"))
    return catalog.register(r, new).select("service_name", "enabled")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN 'own' ELSE 'file' END AS origin FROM nation")
def f47_workspace(spark, sf):
    n = base(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lit("acme").alias("org_id"))
    return catalog.workspace_entries(n.filter("id < 10").withColumn("origin", F.lit("own")), n.withColumn("origin", F.lit("file")), "acme", "id").select("id", "origin")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT to_node AS s, from_node AS d FROM f_edges WHERE edge_type = 'INVOKES'), r AS (SELECT DISTINCT s AS seed, d, 1 AS k FROM e UNION SELECT r.seed, e.d, k + 1 FROM r JOIN e ON e.s = r.d WHERE k < 3)
SELECT d AS class_fqn, count(DISTINCT seed) AS calls FROM r WHERE seed <> d GROUP BY 1""")
def i05_attributed_calls(spark, sf):
    e = fact(spark, sf, "edges").filter("edge_type = 'INVOKES'").select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    calls = e.select(F.col("dst").alias("class_fqn"), F.lit("GET").alias("http_method"), F.concat(F.lit("/"), "dst").alias("path_text"), F.lit(0.9).alias("confidence")).distinct()
    return extract.attribute_callers(calls, e, 3).groupBy("class_fqn").agg(F.count("*").alias("calls"))


@query("SELECT p_partkey AS use_id, CASE WHEN p_size > 40 THEN 'IMPORT' WHEN p_size > 20 THEN 'CATALOG' ELSE 'SAME_PACKAGE' END AS outcome FROM part")
def i18_type_names(spark, sf):
    p = base(spark, sf, "part")
    name = F.concat(F.lit("P"), "p_partkey")
    uses = p.select(F.col("p_partkey").alias("use_id"), F.lit("f").alias("file_path"), F.lit("a.b").alias("package"), name.alias("type_name"))
    imports = p.filter("p_size > 40").select(F.lit("f").alias("file_path"), name.alias("type_name"), F.concat(F.lit("i."), name).alias("fqn"))
    cat = p.filter("p_size > 20").select(name.alias("type_name"), F.concat(F.lit("c."), name).alias("fqn"))
    none = spark.createDataFrame([], "type_name string, fqn string")
    return catalog.resolve_types(uses, imports, none, cat, none).select("use_id", "outcome")


@query("SELECT dependency_id, CASE WHEN p % 2 = 0 THEN 'svcG' WHEN p % 3 = 0 THEN 'svcR' END AS linked_service_id FROM (SELECT DISTINCT service_id || '/' || to_artifact AS dependency_id, CAST(substring(to_artifact, 2) AS BIGINT) AS p FROM f_dependencies)")
def i27_links(spark, sf):
    p = base(spark, sf, "part")
    ga = F.concat_ws(":", F.concat(F.lit("com.g"), (F.col("p_partkey") % 10).cast("string")), F.concat(F.lit("p"), "p_partkey"))
    one = p.filter("p_partkey % 2 = 0").select(F.lit("GAV").alias("source"), ga.alias("artifact_key"), F.lit("svcG").alias("linked_service_id"))
    two = p.filter("p_partkey % 3 = 0").select(F.lit("REGISTRY"), ga, F.lit("svcR"))
    d = fact(spark, sf, "dependencies").select("service_id", "to_group", "to_artifact").distinct().withColumn("dependency_id", F.concat_ws("/", "service_id", "to_artifact"))
    return catalog.link_artifacts(d, one.union(two)).select("dependency_id", "linked_service_id")


@query("SELECT ts, event_id FROM (SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)")
def b14_recent_events(spark, sf):
    return files.recent_events(base(spark, sf, "events").select("ts", "event_id"))


@query("SELECT o_custkey AS service_id, o_orderkey AS file_path, CAST(floor(coalesce(sum(CAST(length(o_orderpriority) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 30) AS INT) AS chunk FROM orders")
def b11_chunks(spark, sf):
    m = base(spark, sf, "orders").select(F.col("o_custkey").alias("service_id"), F.col("o_orderkey").alias("file_path"), F.col("o_orderpriority").alias("model_json"))
    return files.document_chunks(m, 30, 1000)


@query("SELECT job_id, attempt + 1 AS attempt FROM (SELECT job_id, CAST(job_id % 4 + 1 AS INT) AS attempt FROM f_runs) WHERE attempt < 3")
def h05_retries(spark, sf):
    r = fact(spark, sf, "runs").select("job_id", (F.col("job_id") % 4 + 1).cast("int").alias("attempt"))
    return jobs.after_failure(r, F.expr(AS_OF))[0].select("job_id", "attempt")


@query("""SELECT event_id, 'svc' || CAST(min(k) AS STRING) AS service_id, count(DISTINCT f) AS files FROM (SELECT o_orderkey AS event_id, 'src/n' || CAST(l_linenumber AS STRING) || '/' || CAST(l_partkey AS STRING) || '.java' AS f, l_linenumber AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY event_id, k""")
def h01_decompose(spark, sf):
    path = F.concat(F.lit("src/n"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit(".java"))
    e = base(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_set(path).alias("changed_files")).withColumn("repo", F.lit("r"))
    s = spark.range(0, 10).select(F.lit("r").alias("repo"), F.concat(F.lit("svc"), "id").alias("service_id"), F.col("id").cast("int").alias("position"), F.array(F.concat(F.lit("src/n"), "id")).alias("source_roots"))
    known = base(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"))
    return jobs.decompose(e.join(known, "event_id", "left_semi"), s).select("event_id", "service_id", F.size("files").cast("long").alias("files"))


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'push' ELSE 'pull_request' END AS e, CASE event_type WHEN 'purchase' THEN 'opened' WHEN 'error' THEN 'closed' ELSE 'labeled' END AS a FROM events) WHERE e = 'push' OR a = 'opened'")
def h02_accepted(spark, sf):
    kind = F.col("event_type")
    e = base(spark, sf, "events").select("event_id", F.when(kind == "view", "push").otherwise("pull_request").alias("event"), F.when(kind == "purchase", "opened").when(kind == "error", "closed").otherwise("labeled").alias("action"), F.lit("refs/heads/main").alias("ref"))
    return jobs.accepted(e).select("event_id")


# source texts made from the tables


def _parsed(spark, sf, **read):
    return extract.light_parse(fact(spark, sf, "sources"), **read)


_OWN = "'com.acme.n' || CAST(c_nationkey AS STRING) || '.Customer' || CAST(c_custkey AS STRING) || 'Controller'"


@query(f"SELECT {_OWN} AS class_fqn, 'class' AS type_kind FROM customer")
def i01_i02_classes(spark, sf):
    return _parsed(spark, sf, members=False).select("class_fqn", "type_kind")


@query(f"SELECT {_OWN} AS class_fqn, 'GET' AS http_method, '/n' || CAST(c_nationkey AS STRING) || '/c/{{*}}' AS path FROM customer UNION ALL SELECT {_OWN}, 'POST', '/n' || CAST(c_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING) FROM customer")
def i01_i19_endpoints(spark, sf):
    return extract.endpoints(_parsed(spark, sf)).select("class_fqn", "http_method", "path")


@query(f"SELECT {_OWN} AS class_fqn, 'GET' AS http_method, '/stock/' || c_mktsegment AS path_text FROM customer")
def i01_outbound(spark, sf):
    return extract.outbound_calls(_parsed(spark, sf)).select("class_fqn", "http_method", "path_text")


@query(f"SELECT symbol_kind, count(*) AS n FROM (SELECT 'CLASS' AS symbol_kind FROM customer UNION ALL SELECT unnest(['METHOD', 'METHOD', 'ENDPOINT', 'ENDPOINT']) FROM customer) GROUP BY 1")
def i03_symbols(spark, sf):
    return extract.symbol_facts(_parsed(spark, sf, calls=False, stage=False)).groupBy("symbol_kind").agg(F.count("*").alias("n"))


@query(f"SELECT {_OWN} AS handler_class_fqn, unnest(['findById', 'save']) AS dao_method, unnest(['READ', 'WRITE']) AS operation FROM customer")
def i09_accesses(spark, sf):
    return extract.data_accesses(_parsed(spark, sf, args=False, stage=False)).select("handler_class_fqn", "dao_method", "operation")


@query(f"SELECT {_OWN} AS class_fqn, 'Api' || CAST(c_nationkey AS STRING) AS interface FROM customer")
def i01_interfaces(spark, sf):
    return extract.implemented(_parsed(spark, sf, members=False)).select("class_fqn", "interface")


@query(f"SELECT {_OWN} AS class_fqn, 'Nation' || CAST(c_nationkey AS STRING) || 'Repository' AS type, 'repo' AS name FROM customer")
def i25_injected(spark, sf):
    return extract.injected(_parsed(spark, sf)).select("class_fqn", "type", "name")


@query("SELECT trigger_kind, count(*) AS n FROM (SELECT DISTINCT 'REST_INBOUND' AS trigger_kind, 'svc' || CAST(c_nationkey AS STRING) AS s, unnest(['GET|/n' || CAST(c_nationkey AS STRING) || '/c/{*}', 'POST|/n' || CAST(c_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING)]) AS k FROM customer) GROUP BY 1")
def i24_triggers(spark, sf):
    return extract.triggers(_parsed(spark, sf)).groupBy("trigger_kind").agg(F.count("*").alias("n"))


def _diagram(spark, sf):
    from ..operators import flow_diagram

    return flow_diagram.diagram_of(fact(spark, sf, "nodes"), fact(spark, sf, "edges"), fact(spark, sf, "triggers"), "supplier::3", 2)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT from_node AS s, to_node AS d FROM f_edges WHERE edge_type IN ('DEPENDS_ON', 'INVOKES', 'ROUTES_TO', 'IMPLEMENTS', 'OUTBOUND_TO')),
r AS (SELECT 'supplier::3' AS d, 0 AS k UNION SELECT e.d, k + 1 FROM r JOIN e ON e.s = r.d WHERE k < 2)
SELECT d AS id, min(k) AS depth, CASE WHEN d LIKE 'nation::%' THEN 'service' ELSE 'class' END AS role FROM r JOIN f_nodes n ON n.id = d GROUP BY 1""")
def f44_diagram_nodes(spark, sf):
    return _diagram(spark, sf).nodes.select("id", "depth", "role")


@query()
def f44_diagram_gaps(spark, sf):
    return _diagram(spark, sf).gaps


@query("SELECT l_suppkey AS factory_class_fqn, count(*) AS n_routes, min(l_returnflag || l_linestatus || CAST(l_partkey AS STRING)) AS first_key FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_partkey FROM lineitem) GROUP BY 1")
def g18_routing(spark, sf):
    from ..operators import traverse

    key = F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    r = base(spark, sf, "lineitem").select(F.col("l_suppkey").alias("factory_class_fqn"), key.alias("routing_key"), F.col("l_partkey").alias("target_class_fqn"), F.lit(False).alias("fallback"), F.lit("s").alias("selector")).distinct()
    return traverse.routing(r).select("factory_class_fqn", F.size("routes").cast("long").alias("n_routes"), F.col("routes")[0]["routing_key"].alias("first_key"))


@query("SELECT 'FACE' || CAST(c_nationkey AS STRING) AS face, max(c_custkey) AS impl FROM customer GROUP BY 1")
def g21_interface_bridge(spark, sf):
    c = base(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.lit("s").alias("service_id"), F.col("c_custkey").cast("string").alias("class_fqn"), F.array(F.concat(F.lit("FACE"), "c_nationkey")).alias("interfaces"))
    none = spark.createDataFrame([], graph_projection.EDGE)
    return graph_projection.bridge_interfaces(c, none).select(F.split_part("from_node", F.lit("::"), F.lit(3)).alias("face"), F.split_part("to_node", F.lit("::"), F.lit(3)).cast("long").alias("impl"))


@query("SELECT 'svc' || CAST(s_suppkey AS STRING) AS service_id, 'PDN_S.N' || CAST(s_nationkey AS STRING) AS short_id, CASE WHEN s_acctbal < 0 THEN 'SUBSCRIPTION_MISSING' WHEN s_acctbal > 5000 THEN 'TOPIC_MISMATCH' ELSE 'OK' END AS status FROM supplier")
def f39_live_subscriptions(spark, sf):
    s = base(spark, sf, "supplier")
    name = F.concat(F.lit("PDN_S.N"), F.col("s_nationkey").cast("string"), F.lit("#"), F.col("s_suppkey").cast("string"))
    r = s.select(F.concat(F.lit("svc"), "s_suppkey").alias("service_id"), name.alias("short_id"), F.lit("SUBSCRIPTION").alias("resource_kind"))
    live = s.filter("s_acctbal >= 0").select(name.alias("short_id"), F.when(F.col("s_acctbal") > 5000, "other").otherwise(T.subscription_topic(name)).alias("topic"), F.lit(None).cast("string").alias("error"))
    return messaging.verify_subscriptions(r, live).select("service_id", F.split_part("short_id", F.lit("#"), F.lit(1)).alias("short_id"), "status")


@query("SELECT DISTINCT 'svc' || CAST(l_suppkey AS STRING) AS service_id, 'UNIT' AS kind, CAST(l_suppkey AS STRING) AS n FROM lineitem WHERE l_suppkey < 0 UNION ALL SELECT 'svc', CASE WHEN s_acctbal > 0 THEN 'UNIT' ELSE 'MISSING' END, CAST(s_suppkey AS STRING) FROM supplier")
def e10_suggestions(spark, sf):
    s = base(spark, sf, "supplier")
    name = F.concat(F.lit("a.S"), F.col("s_suppkey").cast("string"))
    changed = s.select(F.lit("svc").alias("service_id"), name.alias("symbol_fqn"), F.lit("CLASS").alias("symbol_kind"))
    tests = s.filter("s_acctbal > 0").select(F.lit("svc").alias("service_id"), F.concat(name, F.lit("Test")).alias("symbol_fqn"))
    out = analysis.test_suggestions(changed, spark.createDataFrame([], "consumer_service string, consumer string"), spark.createDataFrame([], "endpoint_id string"), tests)
    return out.select(F.lit("svc").alias("service_id"), F.when(F.col("exists"), F.col("kind")).otherwise("MISSING").alias("kind"), F.regexp_extract("subject", r"(\d+)$", 1).alias("n"))


@query("SELECT step, scenario_id FROM (SELECT l_suppkey AS step, l_returnflag AS scenario_id, list_sort(list(DISTINCT l_linestatus)) AS p FROM lineitem GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_suppkey AS step, l_returnflag AS scenario_id, list_sort(list(DISTINCT l_linestatus)) AS p FROM lineitem GROUP BY 1, 2) y WHERE y.step = x.step AND y.scenario_id <> x.scenario_id AND len(list_intersect(x.p, y.p)) = len(x.p) AND len(y.p) > len(x.p))")
def f18_overlay(spark, sf):
    h = base(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("step"), F.col("l_returnflag").alias("scenario_id")).agg(F.collect_set("l_linestatus").alias("participants"))
    out = consistency.overlay_hints(h.withColumns({"pattern": F.lit("P"), "curated": F.lit(False)}))
    return out.select(F.col("step").cast("long").alias("step"), "scenario_id")


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def f05_ordered_steps(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return base(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"))
