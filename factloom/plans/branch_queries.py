"""Queries that drive branches of operators which others leave empty, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, catalog, consistency, contracts, entry_flow, graph_projection, messaging, relational
from ..sources import extract
from .adapters import base, fact
from .queries import query


def _s(column):
    return (F.col(column) if isinstance(column, str) else column).cast("string")


@query("SELECT p_partkey FROM part WHERE p_size % 3 <> 0")
def c20_folders(spark, sf):
    folder = F.when(F.col("p_size") % 3 == 0, "src/mainx/").when(F.col("p_size") % 3 == 1, "src/main/").otherwise("lib\\x\\")
    p = base(spark, sf, "part").withColumn("source_ref", F.concat(folder, F.lit("A.java")))
    return p.filter(T.in_source_roots("source_ref", ["src/main", " ", "lib/x/"])).select("p_partkey")


@query("""SELECT o_orderkey, CASE WHEN v IN ('markDone', 'saveAll', 'insertX', 'updateX', 'deleteX', 'rePersistX') THEN 'WRITE' ELSE 'READ' END AS op
FROM (SELECT o_orderkey, ['markDone', 'saveAll', 'addX', 'putX', 'insertX', 'getPersisted', 'updateX', 'createX', 'deleteX', 'rePersistX', 'mergeX', 'existsX'][o_orderkey % 12 + 1] AS v FROM orders)""")
def c23_verbs(spark, sf):
    verbs = ("markDone", "saveAll", "addX", "putX", "insertX", "getPersisted", "updateX", "createX", "deleteX", "rePersistX", "mergeX", "existsX")
    name = F.array(*map(F.lit, verbs))[(F.col("o_orderkey") % 12).cast("int")]
    return base(spark, sf, "orders").select("o_orderkey", T.operation_of(name).alias("op"))


@query("""SELECT trigger_id, trigger_kind FROM f_triggers WHERE starts_with(linked_handler_fqn, 'com.acme.n1.Supplier1') OR trigger_kind = 'PUBSUB_SUBSCRIBE' OR (trigger_kind = 'WEBHOOK_INBOUND' AND service_id IN ('svc2', 'svc3'))""")
def f22_package_triggers(spark, sf):
    face = F.when((F.col("trigger_kind") == "WEBHOOK_INBOUND") & F.col("service_id").isin("svc2", "svc3"), '{"handlerInterfaceFqn": "com.acme.n1.Supplier1Api"}').otherwise("{}")
    t = fact(spark, sf, "triggers").withColumns({"env_lane": F.lit("pdn"), "source_ref": F.lit("src"), "attributes": face})
    return entry_flow.entry_triggers(t, package="com.acme.n1.Supplier1").select("trigger_id", "trigger_kind")


@query("""SELECT 's::class::a.Main' || CAST(n_nationkey AS STRING) AS from_node, 's::class::' || CASE WHEN n_regionkey < 3 THEN 'b.c.' ELSE 'a.' END || 'T' || CAST(n_regionkey AS STRING) AS to_node FROM nation
UNION SELECT 's::class::a.Main' || CAST(n_nationkey AS STRING), 's::class::a.Own' FROM nation""")
def g27_imported_scan(spark, sf):
    name = F.concat(F.lit("T"), _s("n_regionkey"))
    imports = F.when(F.col("n_regionkey") < 3, F.concat(F.lit("import b.c."), name, F.lit(";\n"))).otherwise("")
    source = F.concat(F.lit("package a;\nimport x.Other;\n"), imports, F.lit("@ComponentScan(basePackageClasses = {"), name, F.lit(".class, Own.class})\nclass Main {}"))
    mains = base(spark, sf, "nation").select(F.lit("s").alias("service_id"), F.concat(F.lit("a.Main"), _s("n_nationkey")).alias("class_fqn"), source.alias("source"))
    return graph_projection.project_component_scan(mains).select("from_node", "to_node")


@query("""SELECT 'n' || CAST(n_nationkey AS STRING) AS path, unnest(CASE n_regionkey WHEN 0 THEN ['kafka'] WHEN 1 THEN ['redis', 'mongodb'] WHEN 2 THEN ['postgres'] WHEN 3 THEN ['spring-cloud-config', 'oracle'] ELSE [] END) AS peripheral_type FROM nation""")
def i04_named_peripherals(spark, sf):
    texts = (
        "class A { /* SQLServer before */ @KafkaListener(topics = x) void on() {} }", "class B { private StringRedisTemplate r; MongoTemplate m; }", "@Entity class E { org.postgresql.Driver d; }",
        "@EnableConfigServer class C { oracle.jdbc.Driver d; }", "import org.springframework.kafka.X; @RefreshScope class D { String s = \"oracle\"; // replaces Oracle\n// @KafkaListener\n }",
    )
    text = F.array(*map(F.lit, texts))[F.col("n_regionkey").cast("int")]
    files = base(spark, sf, "nation").select(F.lit("s").alias("service_id"), F.concat(F.lit("n"), _s("n_nationkey")).alias("path"), text.alias("text"))
    return extract.peripherals(files).select("path", "peripheral_type")


@query("SELECT 'c' || CAST(o_custkey AS STRING) AS id, arg_min(o_orderstatus, o_orderkey) AS service, arg_max(o_orderpriority, o_orderkey) AS symbol_fqn FROM orders GROUP BY o_custkey")
def g02_first_and_last(spark, sf):
    rows = base(spark, sf, "orders").select(
        F.concat(F.lit("c"), _s("o_custkey")).alias("id"), F.lit("o").alias("org_id"), F.lit("r").alias("repo"), F.col("o_orderstatus").alias("service"), F.lit("service").alias("module_type"),
        F.lit("CLASS").alias("node_type"), F.col("o_orderpriority").alias("symbol_fqn"), F.col("o_orderkey").alias("seq"),
    )
    return graph_projection.upsert_nodes(rows).select("id", "service", "symbol_fqn")


@query("SELECT DISTINCT service_id || '::class::' || split_part(guarded_symbol, '#', 1) AS from_node, 'gate:' || service_id || ':' || gate_key AS to_node, 'GUARDED_BY' AS edge_type FROM f_gates")
def g24_gate_edges(spark, sf):
    r = fact(spark, sf, "resources").withColumns({"env_lane": F.lit("pdn"), "evidence_source": F.lit("YAML")})
    g = fact(spark, sf, "gates").withColumns({"confidence": F.lit(0.9), "evidence_source": F.lit("CODE")})
    return graph_projection.project_messaging(r, g).filter("edge_type = 'GUARDED_BY'").select("from_node", "to_node", "edge_type")


@query(r"""SELECT 's::maven::' || regexp_replace(module_path, '/[^/]*$', '') AS from_node, 's::maven::' || module_path AS to_node, 'CONTAINS_MODULE' AS edge_type FROM f_modules WHERE contains(module_path, '/')
UNION SELECT 'gav::' || to_group || ':' || to_artifact || ':' || coalesce(to_version, 'UNRESOLVED'), 'lib' || to_artifact, 'OWNED_BY' FROM f_dependencies WHERE transitive AND scope = 'compile'""")
def g28_owned_modules(spark, sf):
    m = fact(spark, sf, "modules").select(F.lit("s").alias("service_id"), "module_path", relational.parent_path("module_path").alias("parent_path"))
    owner = F.when(F.col("scope") == "compile", F.concat(F.lit("lib"), "to_artifact"))
    d = fact(spark, sf, "dependencies").withColumns({"confidence": F.lit(0.9), "cross_repo": F.col("transitive"), "linked_service_id": owner})
    return graph_projection.project_maven(m, d).filter("edge_type <> 'DEPENDS_ON_ARTIFACT'").select("from_node", "to_node", "edge_type")


@query("""SELECT DISTINCT r.service_id FROM f_resources r JOIN nation ON n_name = r.service_id WHERE r.role = 'SUBSCRIBE' AND r.linked_class_fqn IS NULL AND n_regionkey > 1 AND n_nationkey % 2 = 0""")
def f08_triggered_subscribers(spark, sf):
    n = base(spark, sf, "nation")
    path = F.concat(F.lit("PDN_S.N"), ((F.col("n_nationkey") * 7 + 3 + F.col("n_nationkey") % 2) % 30).cast("string"))
    kind = F.when(F.col("n_regionkey") == 1, "CRON_K8S").when(F.col("n_regionkey") == 2, "KAFKA_SUBSCRIBE").otherwise("PUBSUB_SUBSCRIBE")
    triggers = n.select(F.col("n_name").alias("service_id"), kind.alias("trigger_kind"), path.alias("path_pattern"))
    registry = n.select(F.col("n_name").alias("service_id"), F.when(F.col("n_regionkey") == 0, "library").otherwise("service").alias("module_type"))
    return messaging.runtime_subscribers(fact(spark, sf, "resources").filter("linked_class_fqn IS NULL"), triggers, registry)


@query("""WITH x AS (SELECT 'svc' || CAST(c_custkey AS STRING) AS service_id, 'P' AS kind, 'P: ' || c_mktsegment AS description, 0 AS rank FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT 'svc' || CAST(c_custkey AS STRING), 'P', 'P: ' || c_mktsegment, 1 FROM customer)
SELECT service_id, kind, description, min(rank) AS rank FROM x GROUP BY ALL""")
def f19_ruled_invariants(spark, sf):
    c = base(spark, sf, "customer").withColumn("service_id", F.concat(F.lit("svc"), _s("c_custkey")))
    rules = c.filter("c_acctbal > 5000").select("service_id", F.lit("P").alias("kind"), F.concat(F.lit("P: "), "c_mktsegment").alias("description"))
    scenarios = c.select("service_id", F.lit("P").alias("pattern"), F.col("c_mktsegment").alias("scope_ref"))
    out = consistency.derive_invariants(rules, scenarios, fact(spark, sf, "accesses"), fact(spark, sf, "gates"))
    return out.filter("kind = 'P'").select("service_id", "kind", "description", "rank")


@query("""SELECT trigger_id, CASE WHEN trigger_kind = 'PUBSUB_SUBSCRIBE' THEN path_pattern WHEN s_suppkey % 2 = 0 THEN 'PDN_T.A' || CAST(s_suppkey AS STRING) END AS topic FROM f_triggers JOIN supplier ON service_id = 'svc' || CAST(s_suppkey AS STRING)""")
def f25_published_topics(spark, sf):
    s = base(spark, sf, "supplier").filter("s_suppkey % 2 = 0")
    key = _s("s_suppkey")
    one = lambda letter: s.select(F.concat(F.lit("svc"), key).alias("service_id"), F.lit("PUBLISH").alias("role"), F.concat(F.lit("com.acme.n1.Supplier"), key).alias("linked_class_fqn"), F.concat(F.lit(f"PDN_T.{letter}"), key).alias("short_id"))
    return entry_flow.chain_topics(fact(spark, sf, "triggers"), one("B").union(one("A")))


@query("""WITH c AS (SELECT s_suppkey AS k, 'S' || CAST(s_suppkey AS STRING) AS simple FROM supplier),
t AS (SELECT CASE WHEN s_acctbal > 5000 THEN 'S' || CAST(s_suppkey AS STRING) || 'IT' ELSE 'TestS' || CAST(s_suppkey AS STRING) || 'x' END AS test FROM supplier WHERE s_acctbal > 0),
m AS (SELECT DISTINCT 'a.' || simple AS subject, 'a.' || test AS test FROM c JOIN t ON test IN (simple || 'Test', simple || 'Tests', simple || 'IT') OR starts_with(test, 'Test' || simple))
SELECT 'UNIT' AS kind, subject, test, true AS exists FROM m UNION SELECT 'UNIT', 'a.' || simple, simple || 'Test', false FROM c WHERE 'a.' || simple NOT IN (SELECT subject FROM m)
UNION SELECT 'INTEGRATION', n_name, 'b.OrderIntegrationSuite', true FROM nation UNION SELECT 'EXTERNAL', r_name, r_name || 'ContractTest', false FROM region""")
def e10_all_suggestions(spark, sf):
    s = base(spark, sf, "supplier")
    name = F.concat(F.lit("a.S"), _s("s_suppkey"))
    changed = s.select(F.lit("svc").alias("service_id"), name.alias("symbol_fqn"), F.lit("CLASS").alias("symbol_kind"))
    own = F.when(F.col("s_acctbal") > 5000, F.concat(name, F.lit("IT"))).otherwise(F.concat(F.lit("a.TestS"), _s("s_suppkey"), F.lit("x")))
    far = spark.createDataFrame([("far", "b.OrderIntegrationSuite"), ("far", "b.Other")], "service_id string, symbol_fqn string")
    tests = s.filter("s_acctbal > 0").select(F.lit("svc").alias("service_id"), own.alias("symbol_fqn")).union(far)
    consumers = base(spark, sf, "nation").select(F.lit("far").alias("consumer_service"), F.col("n_name").alias("consumer"))
    return analysis.test_suggestions(changed, consumers, base(spark, sf, "region").select(F.col("r_name").alias("endpoint_id")), tests)


_CLASH = """WITH o AS (SELECT n_nationkey AS k, n_name AS w, CAST(0 AS DOUBLE) AS v FROM nation WHERE n_nationkey < 15),
n AS (SELECT s_nationkey AS k, s_name AS w, CAST(s_acctbal AS DOUBLE) AS v FROM supplier WHERE s_nationkey > 5 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) """


def _clash(spark, sf):
    o = base(spark, sf, "nation").filter("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("w"), F.lit(0.0).alias("v"))
    n = base(spark, sf, "supplier").filter("s_nationkey > 5").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("w"), F.col("s_acctbal").cast("double").alias("v"))
    return o, n


@query(_CLASH + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def a30_clashing_rows(spark, sf):
    return relational.insert_or_ignore(*_clash(spark, sf), ["k"], order=[F.desc("v"), F.asc("w")])


@query(_CLASH + "SELECT coalesce(o.k, n.k) AS k, coalesce(o.w, n.w) AS w, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k = n.k")
def a31_clashing_rows(spark, sf):
    return relational.upsert(*_clash(spark, sf), ["k"], ["v"], order=[F.desc("v"), F.asc("w")])


@query("""WITH r(p, s) AS (VALUES ('H1', 'one'), ('H12', 'two'), ('H', 'all')), h AS (SELECT DISTINCT service_id, handler_class_fqn FROM f_accesses),
m AS (SELECT DISTINCT service_id, handler_class_fqn FROM f_accesses WHERE operation = 'WRITE' AND store_type = 'MARIADB')
SELECT h.service_id, h.handler_class_fqn, (SELECT string_agg(s, ',' ORDER BY s) FROM r WHERE contains(h.handler_class_fqn, p)) AS flow, CASE WHEN m.service_id IS NOT NULL THEN 'direct' ELSE 'every' END AS scenarios FROM h LEFT JOIN m USING (service_id, handler_class_fqn)""")
def f17_enriched_steps(spark, sf):
    a = fact(spark, sf, "accesses")
    steps = a.select("service_id", "handler_class_fqn").distinct()
    rules = spark.createDataFrame([("H1", "one"), ("H12", "two"), ("H", "all")], "class_contains string, flow_step string")
    matches = a.filter("operation = 'WRITE' AND store_type = 'MARIADB'").select("service_id", "handler_class_fqn", F.lit("direct").alias("scenario_id")).distinct()
    scenarios = a.select("service_id", F.lit("every").alias("scenario_id")).distinct()
    out = consistency.enrich_hints(steps, rules, matches, scenarios)
    return out.select("service_id", "handler_class_fqn", F.array_join("flow_steps", ",").alias("flow"), F.array_join("scenarios", ",").alias("scenarios"))


@query("""SELECT 'op' || CAST(n_nationkey AS STRING) AS operation_id, CASE n_regionkey WHEN 0 THEN 'NO_MAPPED_SERVICE' WHEN 1 THEN 'SERVICE_NOT_REGISTERED' WHEN 2 THEN 'IMPLEMENTATION_NOT_INDEXED' WHEN 3 THEN 'MATCHED' ELSE 'NO_HANDLER' END AS status,
CASE WHEN n_regionkey = 3 THEN 't' || CAST(n_nationkey AS STRING) || 'a' END AS trigger_id FROM nation""")
def f31_all_statuses(spark, sf):
    n, k, r = base(spark, sf, "nation"), _s("n_nationkey"), F.col("n_regionkey")
    c = n.select(F.concat(F.lit("op"), k).alias("operation_id"), F.lit("POST").alias("http_method"), F.concat(F.lit("/n/{id}/"), k, F.lit("/")).alias("path_template"), F.when(r == 0, " ").otherwise(F.concat(F.lit("S"), k)).alias("mapped_service_name"))
    registry = n.filter(r > 1).select(F.concat(F.lit("S"), k).alias("service_name"), F.concat(F.lit("svc"), k).alias("service_id"))
    runs = n.filter(r != 4).select(F.concat(F.lit("svc"), k).alias("service_id"), F.when(r == 3, "COMPLETE").otherwise("FAILED").alias("status"))
    runs = runs.union(n.filter(r == 4).select(F.concat(F.lit("svc"), k), F.lit("COMPLETE")))
    kinds = F.explode(F.array(F.struct(F.lit("b").alias("x"), F.lit("REST_INBOUND").alias("kind")), F.struct(F.lit("a").alias("x"), F.lit("WEBHOOK_INBOUND").alias("kind")), F.struct(F.lit("0").alias("x"), F.lit("CRON_K8S").alias("kind"))))
    t = n.filter(r == 3).select(k.alias("k"), kinds.alias("x")).select(
        F.concat(F.lit("t"), "k", "x.x").alias("trigger_id"), F.concat(F.lit("svc"), "k").alias("service_id"), F.col("x.kind").alias("trigger_kind"), F.lit("POST").alias("http_method"), F.concat(F.lit("n/{key}//"), "k").alias("path_pattern")
    )
    return contracts.link_entries(c, registry, runs, t)


@query("""SELECT 'svc' || CAST(n_nationkey AS STRING) AS service_id, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_regionkey = 4 THEN 'lib3' ELSE 'lib2' END ELSE CASE WHEN n_regionkey = 4 THEN 'lib3' ELSE 'lib1' END END AS library_id,
CASE WHEN n_regionkey = 4 THEN 'other.P4' ELSE 'e.P' || CAST(n_regionkey AS STRING) END AS found_fqn FROM nation""")
def f33_pinned(spark, sf):
    """Even services pin two libraries, the second first; one entity is only in a library that nobody pins, under another package."""
    n, k, r = base(spark, sf, "nation"), F.col("n_nationkey"), F.col("r_regionkey")
    names = n.select(F.concat(F.lit("svc"), k).alias("service_id"), F.concat(F.lit("e.P"), F.col("n_regionkey")).alias("entity_fqn"))
    libs = base(spark, sf, "region").select(r.alias("r"), F.explode(F.when(r == 4, F.array(F.lit("lib3"))).otherwise(F.array(F.lit("lib2"), F.lit("lib1")))).alias("service_id"))
    objects = libs.select("service_id", F.concat(F.when(F.col("r") == 4, "other.P").otherwise("e.P"), "r").alias("entity_fqn"), F.lit("t").alias("physical_name"), F.lit("M").alias("store_type"))
    pins = n.filter(k % 2 == 0).select(F.concat(F.lit("svc"), k).alias("service_id"), F.explode(F.array(F.struct(F.lit("lib2").alias("l"), F.lit(0).alias("p")), F.struct(F.lit("lib1").alias("l"), F.lit(1).alias("p")))).alias("x"))
    pins = pins.select("service_id", F.col("x.l").alias("library_id"), F.col("x.p").alias("position"))
    return catalog.resolve_entities(names, objects, pins).select("service_id", "library_id", "found_fqn")


@query("""SELECT p_partkey AS use_id, CASE k WHEN 0 THEN 'q.T' WHEN 1 THEN 'i.T1' WHEN 2 THEN 'c.T2' WHEN 3 THEN 'l.T3' WHEN 4 THEN 's.T4' WHEN 5 THEN 'own.T5' END AS fqn FROM (SELECT p_partkey, p_partkey % 7 AS k FROM part)""")
def i18_all_outcomes(spark, sf):
    """Types written in full, imported, on the class path, in the catalog, among symbols, of the same package, and unknown."""
    p = base(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("k"))
    k = F.col("k").cast("string")
    uses = p.select(F.col("p_partkey").alias("use_id"), F.lit("f").alias("file_path"), F.when(F.col("k") == 5, "own").alias("package"), F.when(F.col("k") == 0, "q.T").otherwise(F.concat(F.lit("T"), k)).alias("type_name"))
    one = lambda n, prefix: p.filter(F.col("k") <= n).select(F.concat(F.lit("T"), k).alias("type_name"), F.concat(F.lit(prefix), F.lit("T"), k).alias("fqn")).distinct()
    imports = one(1, "i.").withColumn("file_path", F.lit("f"))
    return catalog.resolve_types(uses, imports, one(2, "c."), one(3, "l."), one(4, "s.")).select("use_id", "fqn")


@query("""SELECT 's::class::a.Face' || CAST(r_regionkey AS STRING) AS from_node, 's::class::a.C' || CAST(r_regionkey + 20 AS STRING) AS to_node, 'IMPLEMENTS' AS edge_type FROM region
UNION ALL SELECT 's::class::a.Face' || CAST(r_regionkey AS STRING), 'm' || CAST(r_regionkey + 20 AS STRING), 'INVOKES' FROM region""")
def g21_copied_invokes(spark, sf):
    """Of five controllers of a face the last one stays; what it invokes the face invokes too."""
    n, k = base(spark, sf, "nation"), _s("n_nationkey")
    own = F.concat(F.lit("a.C"), k)
    c = n.select(F.col("n_nationkey").alias("seq"), F.lit("s").alias("service_id"), own.alias("class_fqn"), F.array(F.concat(F.lit("a.Face"), (F.col("n_nationkey") % 5).cast("string"))).alias("interfaces"))
    calls = n.select(F.concat(F.lit("s::class::"), own).alias("from_node"), F.concat(F.lit("m"), k).alias("to_node"), F.explode(F.array(F.lit("INVOKES"), F.lit("CALLS"))).alias("edge_type"), F.lit(0.9).alias("confidence"), F.lit("X").alias("evidence_source"))
    return graph_projection.bridge_interfaces(c, calls).select("from_node", "to_node", "edge_type")


@query("""SELECT 'a.N' || CAST(n_nationkey % 5 AS STRING) AS seed, CASE WHEN n_nationkey % 2 = 0 THEN 'id' || CAST(n_nationkey AS STRING) ELSE 'S' || CAST(n_nationkey AS STRING) END AS consumer_service, 'a.N' || CAST(n_nationkey AS STRING) AS consumer, 'GRAPH' AS via FROM nation WHERE n_nationkey >= 5
UNION ALL SELECT 'a.E' || CAST(n_nationkey % 5 AS STRING), 'caller' || CAST(n_nationkey AS STRING), 'b.X#call' || CAST(n_nationkey AS STRING), 'OUTBOUND_CALL' FROM nation WHERE n_nationkey % 2 = 0""")
def e07_graph_and_calls(spark, sf):
    """Chains of classes five numbers apart, half of their services registered, and calls of changed endpoints, some by their own service."""
    n, k = base(spark, sf, "nation"), _s("n_nationkey")
    low = _s(F.col("n_nationkey") % 5)
    nodes = n.select(F.concat(F.lit("id::"), k).alias("id"), F.concat(F.lit("S"), k).alias("service"), F.lit("CLASS").alias("node_type"), F.concat(F.lit("a.N"), k).alias("symbol_fqn"))
    edges = n.filter("n_nationkey >= 5").select(F.concat(F.lit("id::"), k).alias("from_node"), F.concat(F.lit("id::"), _s(F.col("n_nationkey") - 5)).alias("to_node"), F.lit("DEPENDS_ON").alias("edge_type"))
    registry = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("S"), k).alias("service_name"), F.concat(F.lit("id"), k).alias("service_id"))
    first = n.filter("n_nationkey < 5")
    changed = first.select(F.concat(F.lit("a.N"), k).alias("symbol_fqn"), F.lit("CLASS").alias("symbol_kind"), F.lit("o").alias("service_id"), F.lit("{}").alias("attributes"))
    changed = changed.union(first.select(F.concat(F.lit("a.E"), k), F.lit("ENDPOINT"), F.concat(F.lit("own"), k), F.concat(F.lit('{"httpMethod": "GET", "path": "/p'), k, F.lit('"}'))))
    service = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("caller"), k)).otherwise(F.concat(F.lit("own"), low))
    outbound = n.select(service.alias("service_id"), F.concat(F.lit("b.X#call"), k).alias("source_symbol"), F.lit("GET").alias("http_method"), F.concat(F.lit("/p"), low).alias("path"))
    return analysis.affected_consumers(changed, nodes, edges, registry, outbound).select("seed", "consumer_service", "consumer", "via")
