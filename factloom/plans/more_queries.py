"""Queries of the remaining operators over the driver's tables, and their SQL.

Source texts are written from the tables by SELECTs that Spark and DuckDB both
understand; what an extractor must find in them follows from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, catalog, contracts, graph_projection, messaging, traverse
from ..sources import extract, files
from .adapters import base, fact
from .queries import query


def _made(spark: SparkSession, sf: str, table: str, path: str, text: str) -> DataFrame:
    """A file for each row of ``table``."""
    return base(spark, sf, table).select(F.lit("svc").alias("service_id"), F.expr(path).alias("path"), F.expr(text).alias("text"))


# A


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 7) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def a05_in_list(spark, sf):
    wanted = base(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return base(spark, sf, "part").filter(F.col("p_size").isin(1, 5, 7)).join(wanted, "p_partkey", "left_semi").select("p_partkey")


@query("SELECT c_nationkey, round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1")
def a12_one_row(spark, sf):
    c = base(spark, sf, "customer")
    total = c.agg(F.count("*").alias("total"))
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("c_nationkey", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("share"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))
OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < -500))""")
def a15_two_hops(spark, sf):
    orders = base(spark, sf, "orders").select("o_orderkey", "o_custkey")
    nations = base(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    buyers = base(spark, sf, "customer").join(nations, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    debtors = base(spark, sf, "supplier").filter("s_acctbal < -500").select(F.col("s_suppkey").alias("l_suppkey"))
    lines = base(spark, sf, "lineitem").join(debtors, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(buyers, "o_custkey", "left_semi").select("o_orderkey").union(orders.join(lines, "o_orderkey", "left_semi").select("o_orderkey")).distinct()


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 ELSE 2 END AS place FROM part")
def a24_rank(spark, sf):
    from ..operators import relational

    return base(spark, sf, "part").select("p_partkey", relational.ranked("p_brand", ["Brand#11", "Brand#12"]).alias("place"))


_STARTS = "WITH RECURSIVE e AS (SELECT DISTINCT from_node AS s, to_node AS d FROM f_edges WHERE edge_type = 'CALLS'), r AS (SELECT x AS seed, x AS d, 0 AS k FROM (SELECT unnest(['nation::1', 'nation::2']) AS x) UNION SELECT seed, e.d, {k} FROM r JOIN e ON e.s = r.d{bound}) "


def _calls(spark, sf):
    steps = fact(spark, sf, "edges").filter("edge_type = 'CALLS'").select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    seeds = spark.range(1).select(F.explode(F.array(F.lit("nation::1"), F.lit("nation::2"))).alias("seed")).withColumn("node", F.col("seed"))
    return steps.distinct(), seeds


@query(_STARTS.format(k="0", bound="") + "SELECT DISTINCT seed, d AS node FROM r")
def a26_a28_fixpoint(spark, sf):
    return traverse.fixpoint(*_calls(spark, sf), include_seeds=True).select("seed", "node")


@query(_STARTS.format(k="k + 1", bound=" WHERE k < 2") + "SELECT seed, d AS node, min(k)::INT AS depth FROM r GROUP BY 1, 2")
def a27_bounded(spark, sf):
    return traverse.fixpoint(*_calls(spark, sf), max_depth=2, include_seeds=True)


# B


@query("SELECT page_id, 'o/r' || CAST(page_id % 7 AS STRING) AS repo FROM pages WHERE page_id % 2 = 0")
def b09_webhooks(spark, sf):
    head = F.struct(F.struct(F.col("page_id").cast("string").alias("sha")).alias("head"))
    action = F.when(F.col("page_id") % 2 == 0, "opened").otherwise("closed")
    repository = F.struct(F.concat(F.lit("o/r"), (F.col("page_id") % 7).cast("string")).alias("full_name"))
    body = F.to_json(F.struct(action.alias("action"), repository.alias("repository"), head.alias("pull_request")))
    kept = files.webhook_jobs(base(spark, sf, "pages").select(F.lit("pull_request").alias("event"), body.alias("body")))
    return kept.select(F.col("commit_sha").cast("long").alias("page_id"), "repo")


@query("SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS config, s_suppkey % 4 = 2 AS pom FROM supplier")
def b05_b06_paths(spark, sf):
    k = F.col("s_suppkey") % 4
    path = F.when(k == 0, "a/x.proto").when(k == 1, "m/src/main/resources/application-qa.yml").when(k == 2, "m/pom.xml").otherwise("m/values.yml")
    return base(spark, sf, "supplier").select("s_suppkey", files.is_config(path).alias("config"), files.is_pom(path).alias("pom"))


# C


@query(r"""SELECT c.s_suppkey, count(*) FILTER (t.test IN (c.simple || 'Test', c.simple || 'Tests', c.simple || 'IT') OR starts_with(t.test, 'Test' || c.simple)) AS tests
FROM (SELECT s_suppkey, 'S' || CAST(s_suppkey AS STRING) AS simple FROM supplier) c JOIN (SELECT s_suppkey, unnest(['S' || CAST(s_suppkey AS STRING) || 'IT', 'TestS' || CAST(s_suppkey AS STRING) || 'x', 'S' || CAST(s_suppkey AS STRING) || 'Spec']) AS test FROM supplier) t USING (s_suppkey) GROUP BY 1""")
def c03_test_names(spark, sf):
    simple = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    names = F.array(F.concat(simple, F.lit("IT")), F.concat(F.lit("Test"), simple, F.lit("x")), F.concat(simple, F.lit("Spec")))
    each = base(spark, sf, "supplier").select("s_suppkey", simple.alias("simple"), F.explode(names).alias("test"))
    return each.groupBy("s_suppkey").agg(F.count_if(T.is_test_of("test", "simple")).alias("tests"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'qa' WHEN 1 THEN 'pdn' WHEN 2 THEN 'dev' ELSE 'unknown' END AS lane, CASE WHEN s_suppkey % 4 < 2 THEN 'm' || CAST(s_suppkey AS STRING) END AS module FROM supplier")
def c15_c16_lanes(spark, sf):
    k, m = F.col("s_suppkey") % 4, F.concat(F.lit("repo/m"), F.col("s_suppkey").cast("string"))
    tail = F.when(k == 0, "/src/main/resources/application-qa.yml").when(k == 1, "/src/main/resources/application-pdn.yaml").when(k == 2, "/k8s/dev/x.yaml").otherwise("/x.yaml")
    path = F.concat(m, tail)
    return base(spark, sf, "supplier").select("s_suppkey", T.env_lane(path).alias("lane"), T.module_name(path).alias("module"))


_YAML = "'app:' || chr(10) || '  name: \"n' || CAST(n_nationkey AS STRING) || '\"' || chr(10) || '  db:' || chr(10) || '    size: ' || CAST(n_regionkey AS STRING) || ' # rows' || chr(10) || 'top: x' || chr(10)"


@query("SELECT n_nationkey AS k, unnest(['app.name', 'app.db.size', 'top']) AS key, unnest(['n' || CAST(n_nationkey AS STRING), CAST(n_regionkey AS STRING), 'x']) AS value FROM nation")
def c17_yaml(spark, sf):
    found = extract.yaml_entries(_made(spark, sf, "nation", "CAST(n_nationkey AS STRING)", _YAML))
    return found.select(F.col("path").cast("int").alias("k"), "key", "value")


@query("SELECT scope, count(*) AS n FROM f_dependencies WHERE scope IN ('compile', 'runtime') GROUP BY 1")
def c21_scopes(spark, sf):
    return fact(spark, sf, "dependencies").filter(T.in_maven_scope("scope", "Runtime")).groupBy("scope").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'REPOSITORY' WHEN 1 THEN 'DAO' ELSE 'OTHER' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN 'CASSANDRA' WHEN 1 THEN 'MONGODB' ELSE 'MARIADB' END AS store FROM supplier")
def c24_kinds(spark, sf):
    k = F.col("s_suppkey") % 3
    fqn = F.when(k == 0, "a.cassandra.XRepository").when(k == 1, "a.mongo.XDaoImpl").otherwise("a.X")
    return base(spark, sf, "supplier").select("s_suppkey", T.accessor_kind(fqn).alias("kind"), T.store_type(fqn).alias("store"))


@query("SELECT id, 'n' || substring(sha256(id), 1, 10) AS diagram_id FROM f_nodes")
def c33_diagram_ids(spark, sf):
    return fact(spark, sf, "nodes").select("id", T.mermaid_id("id").alias("diagram_id"))


# G


@query("SELECT c_custkey, 'svc' || CAST(c_nationkey AS STRING) || '::class::' || c_name AS class_id, 'svc' || CAST(c_nationkey AS STRING) || '::method::' || c_name || '#m' AS method_id, 'gav::g:' || c_name || ':' || CASE WHEN c_acctbal > 0 THEN '1' ELSE 'UNRESOLVED' END AS artifact_id FROM customer")
def g01_ids(spark, sf):
    service = F.concat(F.lit("svc"), F.col("c_nationkey").cast("string"))
    return base(spark, sf, "customer").select(
        "c_custkey", graph_projection.class_id(service, "c_name").alias("class_id"), graph_projection.method_id(service, "c_name", F.lit("m")).alias("method_id"),
        graph_projection.artifact_id(F.lit("g"), "c_name", F.when(F.col("c_acctbal") > 0, "1")).alias("artifact_id"),
    )


@query("SELECT edge_type, 2 * count(*) AS n FROM f_edges GROUP BY 1")
def g03_insert_edges(spark, sf):
    e = fact(spark, sf, "edges")
    return graph_projection.insert_edges(e, e).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT 's::class::a.C' || CAST(c_custkey AS STRING) AS src, c_nationkey AS k, c_mktsegment AS seg FROM customer)
SELECT src AS from_node, CASE WHEN k < 10 THEN 'lib::' || CAST(k AS STRING) ELSE 's::class::t.T' || CAST(k AS STRING) END AS to_node, CASE WHEN k < 10 THEN 'USES_TYPE' ELSE 'DEPENDS_ON' END AS edge_type FROM m
UNION ALL SELECT src, 's::class::t.T' || CAST(k AS STRING), 'INVOKES' FROM m WHERE seg = 'BUILDING'
UNION ALL SELECT src, 'svc::endpoint::e' || CAST(k AS STRING), 'OUTBOUND_TO' FROM m WHERE k < 5""")
def g19_models(spark, sf):
    k = F.col("c_nationkey").cast("string")
    field = F.struct(F.lit("dep").alias("name"), F.concat(F.lit("t.T"), k).alias("type"))
    models = base(spark, sf, "customer").select(
        F.lit("o").alias("org_id"), F.lit("r").alias("repo"), F.lit("s").alias("service_id"), F.lit("service").alias("module_type"),
        F.concat(F.lit("a.C"), F.col("c_custkey").cast("string")).alias("class_fqn"), F.when(F.col("c_mktsegment") == "BUILDING", "x = dep.call();").otherwise("dep;").alias("source"),
        F.array(field).alias("injected"), F.array(F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/"), k).alias("path"))).alias("outbound"),
    )
    n = base(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    ends = n.filter("k < 5").select(F.lit("svc").alias("service_id"), F.concat(F.lit("e"), "k").alias("symbol"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "k").alias("path"), F.lit(1).alias("indexed_at"))
    libraries = n.filter("k < 10").select(F.concat(F.lit("lib::"), "k").alias("id"), F.concat(F.lit("t.T"), "k").alias("symbol_fqn"))
    return graph_projection.project_models(models, ends, libraries)[1].select("from_node", "to_node", "edge_type")


@query("""SELECT 's::class::a.Main' || CAST(n_nationkey AS STRING) AS from_node, 's::class::b.T' || CAST(n_regionkey AS STRING) AS to_node, 'WIRES' AS edge_type FROM nation""")
def g27_component_scan(spark, sf):
    source = F.concat(F.lit("@ComponentScan(basePackageClasses = {b.T"), F.col("n_regionkey").cast("string"), F.lit(".class})\nclass Main {}"))
    mains = base(spark, sf, "nation").select(F.lit("s").alias("service_id"), F.concat(F.lit("a.Main"), F.col("n_nationkey").cast("string")).alias("class_fqn"), source.alias("source"))
    return graph_projection.project_component_scan(mains).select("from_node", "to_node", "edge_type")


@query("""SELECT 's::class::a.P' || CAST(p_partkey AS STRING) AS from_node, 'o::external::qa::x' || CAST(p_size AS STRING) AS to_node FROM part WHERE p_size <= 25
UNION SELECT 'lib', 'o::external::qa::x' || CAST(p_size AS STRING) FROM part WHERE p_size > 25 UNION SELECT 's::class::a.Q', 'o::external::unknown::y' FROM part""")
def g25_external(spark, sf):
    p = base(spark, sf, "part")
    endpoints = p.select(
        F.lit("o").alias("org_id"), F.lit("s").alias("service_id"), F.concat(F.lit("x"), F.col("p_size").cast("string")).alias("endpoint_id"), F.lit("qa").alias("env_lane"), F.lit("Client").alias("client_class"),
        F.when(F.col("p_size") <= 25, F.concat(F.lit("a.P"), F.col("p_partkey").cast("string"))).alias("caller_class_fqn"), F.lit(0.9).alias("confidence"), F.lit("E").alias("evidence_source"),
    )
    calls = p.select(F.lit("o").alias("org_id"), F.lit("s").alias("service_id"), F.lit("a.Q#m").alias("source_symbol"), F.lit("y").alias("endpoint_id"), F.lit(0.9).alias("confidence"), F.lit("E").alias("evidence_source"))
    nodes = spark.createDataFrame([("lib", "CLASS", "c.Client")], "id string, node_type string, symbol_fqn string")
    return graph_projection.project_external(endpoints, calls, nodes).select("from_node", "to_node").distinct()


# E


@query("SELECT job_id, service_id, status FROM f_runs WHERE job_id = 7")
def e03_job(spark, sf):
    return analysis.job_status(fact(spark, sf, "runs"), 7).select("job_id", "service_id", "status")


@query("SELECT symbol_fqn, symbol_kind, file_path FROM f_symbols WHERE service_id = 'svc10' AND commit_sha = 'O'")
def e06_changed(spark, sf):
    s = fact(spark, sf, "symbols").withColumn("attributes", F.lit("{}"))
    return analysis.changed_symbols(s, "svc10", "O").select("symbol_fqn", "symbol_kind", "file_path")


@query("SELECT DISTINCT service_id, caller_class_fqn, endpoint_id FROM (SELECT 'svc' || CAST(l_suppkey AS STRING) AS service_id, 'H' || CAST(l_suppkey AS STRING) AS caller_class_fqn, l_returnflag AS endpoint_id, l_suppkey FROM lineitem) WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def e09_external(spark, sf):
    name = lambda c: (F.concat(F.lit("svc"), F.col(c).cast("string")), F.concat(F.lit("H"), F.col(c).cast("string")))
    service, own = name("l_suppkey")
    ends = base(spark, sf, "lineitem").select(service.alias("service_id"), own.alias("caller_class_fqn"), F.col("l_returnflag").alias("endpoint_id"))
    service, own = name("s_suppkey")
    changed = base(spark, sf, "supplier").filter("s_acctbal > 5000").select(service.alias("service_id"), F.concat(own, F.lit("#m")).alias("symbol_fqn"))
    return analysis.downstream_external(changed, ends)


@query("SELECT 'pubsub_resource_facts' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'symbol_facts', count(*) FROM supplier")
def e16_clear(spark, sf):
    key = lambda c: F.concat(F.lit("svc"), F.col(c).cast("string")).alias("service_id")
    tables = {"pubsub_resource_facts": base(spark, sf, "customer").select(key("c_nationkey")), "symbol_facts": base(spark, sf, "supplier").select(key("s_nationkey"))}
    left = analysis.clear_index(tables, "MESSAGING", "svc3")
    return graph_projection.union_all([df.agg(F.lit(k).alias("name"), F.count("*").alias("n")).select("name", "n") for k, df in left.items()])


# F


@query("""WITH g AS (SELECT *, CASE gate_kind WHEN 'CODE_FLAG' THEN 'qa' ELSE 'unknown' END AS env FROM f_gates) SELECT service_id, gate_key FROM g WHERE env IN ('qa', 'unknown')""")
def f03_lane_facts(spark, sf):
    from ..operators import relational

    g = fact(spark, sf, "gates").withColumn("env", F.when(F.col("gate_kind") == "CODE_FLAG", "qa").otherwise("unknown"))
    return relational.in_lane(g, "qa").select("service_id", "gate_key")


@query("""SELECT 'PDN_T.N' || CAST(n_nationkey AS STRING) AS topic, 'retry-' || CAST(n_nationkey AS STRING) AS job_name, CASE WHEN n_regionkey < 2 THEN 'cron' || CAST(n_nationkey AS STRING) END AS trigger_id FROM nation WHERE n_nationkey >= 5 AND n_nationkey % 2 = 0""")
def f11_terminal_retries(spark, sf):
    n = base(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("string")).withColumn("topic", F.concat(F.lit("PDN_T.N"), "k"))
    hops = n.select("topic", F.col("n_nationkey").alias("hop"))
    people = n.filter("n_nationkey < 5").select("topic", F.lit("SUBSCRIBE").alias("role"))
    retries = n.filter("n_nationkey % 2 = 0").select(F.lit("s").alias("service_id"), F.col("topic").alias("linked_topic"), F.lit("pdn").alias("env_lane"), F.concat(F.lit("retry-"), "k").alias("job_name"))
    crons = n.filter("n_regionkey < 2").select(F.concat(F.lit("cron"), "k").alias("trigger_id"), F.lit("CRON_K8S").alias("trigger_kind"), F.concat(F.lit("/cronjob/retry-"), "k").alias("path_pattern"))
    return messaging.terminal_retries(hops, people, retries, crons).select("topic", "job_name", "trigger_id")


@query("SELECT trigger_id FROM f_triggers WHERE trigger_kind IN ('REST_INBOUND', 'WEBHOOK_INBOUND') AND CAST(substring(service_id, 4) AS BIGINT) % 5 = 0")
def f13_first_triggers(spark, sf):
    t = fact(spark, sf, "triggers")
    hop = F.when(F.substring("service_id", 4, 20).cast("long") % 5 == 0, 0).otherwise(1)
    people = t.select("service_id", F.lit("PUBLISH").alias("role"), hop.alias("hop"))
    return messaging.first_hop_triggers(t, people, t).select("trigger_id")


@query("SELECT operation_id FROM (SELECT 'op' || CAST(o_orderkey AS STRING) AS operation_id, o_orderstatus AS c, o_orderdate FROM orders) WHERE c = (SELECT arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) FROM orders)")
def f27_latest_contract(spark, sf):
    o = base(spark, sf, "orders").select(
        F.lit("acme").alias("org_id"), F.lit("s").alias("service_id"), F.concat(F.lit("op"), F.col("o_orderkey").cast("string")).alias("operation_id"), F.col("o_orderstatus").alias("commit_sha"),
        F.col("o_orderdate").alias("indexed_at"), F.lit("d").alias("domain"), F.lit("s").alias("mapped_service_name"),
    )
    return contracts.contract_operations(o).select("operation_id")


# I: extractors over made texts


def _java(spark, sf, table: str, name: str, body: str) -> DataFrame:
    """Parsed classes ``a.<name>`` with this body."""
    path = f"'src/main/java/' || {name} || '.java'"
    return extract.light_parse(_made(spark, sf, table, path, f"'package a;' || chr(10) || 'public class ' || {name} || ' {{' || chr(10) || {body} || chr(10) || '}}'"))


_K = "CAST(n_nationkey AS STRING)"


@query(f"SELECT {_K} AS path, unnest(['TOPIC', 'SUBSCRIPTION']) AS resource_kind, unnest(['N' || {_K}, 'S' || {_K}]) AS short_id, unnest([1.0::DOUBLE, 0.85::DOUBLE]) AS confidence FROM nation")
def i06_yaml_topics(spark, sf):
    text = f"'gcp:' || chr(10) || '  out-topic: projects/p/topics/N' || {_K} || chr(10) || '  in-subscription: S' || {_K} || chr(10)"
    found = extract.yaml_topics(extract.yaml_entries(_made(spark, sf, "nation", _K, text)))
    return found.select("path", "resource_kind", "short_id", "confidence")


@query(f"SELECT 'M' || {_K} AS name, 2::BIGINT AS fields FROM nation")
def i08_messages(spark, sf):
    text = f"'message M' || {_K} || ' {{ string a = 1; int32 b = 2; }}'"
    return extract.proto_schemas(_made(spark, sf, "nation", f"{_K} || '.proto'", text)).select("name", F.size("fields").cast("long").alias("fields"))


@query(f"SELECT 'a.G' || {_K} AS class_fqn, unnest(['on' || {_K}, 'flag']) AS gate_key, unnest(['CONDITIONAL_BEAN', 'CODE_FLAG']) AS gate_kind FROM nation")
def i11_gates(spark, sf):
    body = f"'@ConditionalOnProperty(name = \"on' || {_K} || '\")' || chr(10) || ' void m() {{ if (!flag) return; }}'"
    return extract.flow_gates(_java(spark, sf, "nation", f"'G' || {_K}", body)).select("class_fqn", "gate_key", "gate_kind")


@query(f"SELECT 'a.P' || {_K} AS class_fqn, 'T' || {_K} AS topic, 'KAFKA' AS transport FROM nation")
def i13_publishes(spark, sf):
    body = f"' void m() {{ kafkaTemplate.send(\"T' || {_K} || '\", x); }}'"
    return extract.publishes(_java(spark, sf, "nation", f"'P' || {_K}", body)).select("class_fqn", "topic", "transport")


@query(f"SELECT 'a.OrderLine' || {_K} AS entity_fqn, CASE WHEN n_regionkey = 1 THEN 't_' || {_K} ELSE 'order_line' || {_K} END AS physical_name FROM nation")
def i16_entities(spark, sf):
    text = f"'package a;' || chr(10) || '@Entity' || chr(10) || CASE WHEN n_regionkey = 1 THEN '@Table(name = \"t_' || {_K} || '\")' ELSE '' END || chr(10) || 'public class OrderLine' || {_K} || ' {{}}'"
    return extract.entities(extract.light_parse(_made(spark, sf, "nation", _K, text))).select("entity_fqn", "physical_name")


@query(f"SELECT 's' || CAST(n_regionkey AS STRING) AS catalog, 'T' || {_K} AS physical_name, CASE WHEN n_nationkey % 2 = 0 THEN 'CASSANDRA' ELSE 'MARIADB' END AS store_type FROM nation")
def i17_ddl(spark, sf):
    text = f"'USE s' || CAST(n_regionkey AS STRING) || ';' || chr(10) || 'create table if not exists T' || {_K} || ' (a int);'"
    found = extract.ddl_tables(_made(spark, sf, "nation", f"{_K} || CASE WHEN n_nationkey % 2 = 0 THEN '.cql' ELSE '.sql' END", text))
    return found.select("catalog", "physical_name", "store_type")


@query(f"SELECT 'n' || {_K} || '|POST|/o/{{*}}' AS operation_id, 'POST' AS http_method, 'do' || {_K} AS name FROM nation")
def i21_openapi(spark, sf):
    text = f"'{{\"paths\": {{\"/o/{{id}}\": {{\"post\": {{\"operationId\": \"do' || {_K} || '\"}}}}}}}}'"
    return extract.openapi_operations(_made(spark, sf, "nation", f"'n' || {_K} || '-spec.json'", text)).select("operation_id", "http_method", "name")


@query(f"SELECT 'f' || {_K} || '.json' AS path, unnest(['ids', 'ids[]', 'address', 'address.c' || {_K}]) AS field FROM nation")
def i22_fields(spark, sf):
    text = f"'{{\"properties\": {{\"ids\": {{\"items\": {{}}}}, \"address\": {{\"properties\": {{\"c' || {_K} || '\": {{}}}}}}}}}}'"
    return extract.schema_fields(_made(spark, sf, "nation", f"'f' || {_K} || '.json'", text))


@query(f"SELECT 'a.A' || {_K} || 'IT' AS test_symbol, 'GET' AS http_method, '/x/{{*}}/' || {_K} AS path_normalized FROM nation")
def i23_test_calls(spark, sf):
    body = f"' void t() {{ given().get(\"/x/{{id}}/' || {_K} || '/\"); }}'"
    return extract.rest_assured_calls(_java(spark, sf, "nation", f"'A' || {_K} || 'IT'", body)).select("test_symbol", "http_method", "path_normalized")


#: chr(36) is the dollar sign, which Spark would take for one of its own variables.
_POM = f"'<project><parent><groupId>g.p</groupId><version>9</version></parent><artifactId>a' || {_K} || '</artifactId><dependencies><dependency><groupId>g.d</groupId><artifactId>d' || CAST(n_regionkey AS STRING) || '</artifactId><version>' || chr(36) || '{{v}}</version></dependency></dependencies></project>'"


@query(f"SELECT 'm' || {_K} AS module_path, 'g.p' AS group_id, 'a' || {_K} AS artifact_id, '9' AS version, 'jar' AS packaging FROM nation")
def i26_modules(spark, sf):
    return extract.pom_modules(_made(spark, sf, "nation", f"'m' || {_K} || '/pom.xml'", _POM)).drop("service_id")


@query(f"SELECT 'm' || {_K} AS module_path, 'd' || CAST(n_regionkey AS STRING) AS to_artifact, 'compile' AS scope, 'PROPERTY' AS unresolved_reason FROM nation")
def i26_dependencies(spark, sf):
    found = extract.pom_dependencies(_made(spark, sf, "nation", f"'m' || {_K} || '/pom.xml'", _POM))
    return found.select("module_path", "to_artifact", "scope", "unresolved_reason")


@query("SELECT p_partkey AS dependency_id, CASE WHEN p_size > 25 THEN 'new' ELSE 'old' END AS linked_service_id FROM part")
def i28_backfill(spark, sf):
    p = base(spark, sf, "part")
    d = p.select(F.col("p_partkey").alias("dependency_id"), F.lit("old").alias("linked_service_id"), F.lit("GAV").alias("link_source"))
    new = p.filter("p_size > 25").select(F.col("p_partkey").alias("dependency_id"), F.lit("new").alias("linked_service_id"), F.lit("ALIAS").alias("link_source"))
    return catalog.backfill_links(d, new).select("dependency_id", "linked_service_id")
