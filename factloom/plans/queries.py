"""Queries over the driver's tables, one or more for each operator family, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, catalog, consistency, contracts, entry_flow, graph_projection, messaging, relational, traverse
from ..sources import extract
from ..streaming import jobs
from .adapters import base, fact, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


# A: relational constructs


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def a01_a02_filters(spark, sf):
    df = relational.where_given(base(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None)
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT short_id, role, count(*) AS n FROM (SELECT short_id, role, CASE WHEN linked_class_fqn IS NULL THEN 'unknown' WHEN role = 'PUBLISH' THEN 'pdn' ELSE 'qa' END AS env FROM f_resources) WHERE env IN ('pdn', 'unknown') GROUP BY ALL")
def a03_lane_fallback(spark, sf):
    env = F.when(F.col("linked_class_fqn").isNull(), "unknown").when(F.col("role") == "PUBLISH", "pdn").otherwise("qa")
    df = relational.in_lane(fact(spark, sf, "resources").withColumn("env", env), "pdn")
    return df.groupBy("short_id", "role").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND (p_type LIKE 'S%' OR p_type LIKE '%_L') AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 49)")
def a04_a06_like(spark, sf):
    part = base(spark, sf, "part")
    brands = part.filter("p_size > 49").select("p_brand").distinct()
    return part.filter(F.col("p_name").contains("a") & T.like_any("p_type", ["S%", "%_L"])).join(brands, "p_brand", "left_semi").select("p_partkey", "p_name")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def a07_json(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return base(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT n_name, c_mktsegment, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def a08_a09_joins(spark, sf):
    c = base(spark, sf, "customer").join(base(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    per = base(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("o"))
    joined = c.join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_name", "c_mktsegment").agg(F.coalesce(F.sum("o"), F.lit(0)).alias("orders"), F.count("*").alias("customers"))


@query("SELECT DISTINCT from_node, to_node, edge_type FROM f_edges WHERE from_node LIKE 'nation::%' OR to_node IN (SELECT id FROM f_nodes WHERE node_type = 'SERVICE')")
def a10_either_endpoint(spark, sf):
    ids = fact(spark, sf, "nodes").filter("node_type = 'SERVICE'").select("id")
    return relational.touching(fact(spark, sf, "edges").select("from_node", "to_node", "edge_type"), ids).filter("from_node LIKE 'nation::%' OR to_node LIKE 'nation::%' OR to_node LIKE 'region::%'")


@query("SELECT p.module_path AS parent, count(*) AS children FROM f_modules p JOIN f_modules c ON regexp_replace(c.module_path, '/[^/]*$', '') = p.module_path AND c.module_path LIKE '%/%' GROUP BY 1")
def a11_parent_path(spark, sf):
    m = fact(spark, sf, "modules")
    return m.select(relational.parent_path("module_path").alias("parent")).filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children"))


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returns, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < -990) AS debtors FROM supplier")
def a13_exists(spark, sf):
    s = base(spark, sf, "supplier")
    r = base(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    d = base(spark, sf, "customer").filter("c_acctbal < -990").select(F.col("c_nationkey").alias("s_nationkey"))
    out = relational.exists_in(relational.exists_in(s, r, ["s_suppkey"], "returns"), d, ["s_nationkey"], "debtors")
    return out.select("s_suppkey", "returns", "debtors")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def a14_anti_join(spark, sf):
    return base(spark, sf, "customer").join(base(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, max(o_orderdate) AS last_date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def a16_a17_latest(spark, sf):
    df = relational.latest(base(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate")
    return df.select("o_custkey", F.col("o_orderdate").alias("last_date"), F.col("o_orderkey").alias("last_order"))


@query("SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey FROM orders ORDER BY o_custkey, o_orderstatus, o_totalprice DESC, o_orderkey")
def a18_a19_distinct_on(spark, sf):
    df = relational.distinct_on(base(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return df.select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT l_suppkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2")
def a20_having(spark, sf):
    return relational.repeated(base(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


@query("SELECT count(*) AS n, max(ts) AS last FROM events")
def a21_global(spark, sf):
    return base(spark, sf, "events").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a22_group(spark, sf):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return base(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_acctbal NULLS FIRST, c_custkey LIMIT 50 OFFSET 100")
def a23_a25_page(spark, sf):
    order = [relational.ranked("c_mktsegment", ["MACHINERY", "BUILDING"]), F.asc_nulls_first("c_acctbal"), F.asc("c_custkey")]
    return relational.page(base(spark, sf, "customer"), order, 50, 100).items.select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT split_part(s_name, '#', 2) AS tail, position('0' IN s_name) AS at, substring(s_name, 1, 8) AS head, length(trim(s_name)) AS n, s_suppkey FROM supplier")
def a29_strings(spark, sf):
    return base(spark, sf, "supplier").select(F.split_part("s_name", F.lit("#"), F.lit(2)).alias("tail"), F.instr("s_name", "0").cast("long").alias("at"), F.substring("s_name", 1, 8).alias("head"), F.length(F.trim("s_name")).cast("long").alias("n"), "s_suppkey")


_OLD_NEW = """WITH o AS (SELECT c_nationkey AS k, max(c_acctbal) AS v, max(c_name) AS w FROM customer WHERE c_nationkey < 15 GROUP BY 1), n AS (SELECT s_nationkey AS k, max(s_acctbal) AS v, max(s_name) AS w FROM supplier WHERE s_nationkey > 5 GROUP BY 1) """


def _old_new(spark, sf):
    o = base(spark, sf, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"), F.max("c_name").alias("w"))
    n = base(spark, sf, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"), F.max("s_name").alias("w"))
    return o, n


@query(_OLD_NEW + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def a30_insert_or_ignore(spark, sf):
    return relational.insert_or_ignore(*_old_new(spark, sf), ["k"])


@query(_OLD_NEW + "SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, coalesce(o.w, n.w) AS w FROM o FULL JOIN n ON o.k = n.k")
def a31_upsert(spark, sf):
    return relational.upsert(*_old_new(spark, sf), ["k"], ["v"])


@query(_OLD_NEW + "SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n")
def a32_replace_by_key(spark, sf):
    return relational.replace_by_key(*_old_new(spark, sf), ["k"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'big' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def a33_update(spark, sf):
    test = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)
    return relational.update_where(base(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), test, {"o_orderpriority": F.lit("big")}).select("o_orderkey", "o_orderpriority")


@query("SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 'part', count(*) FROM part")
def a34_scoped_delete(spark, sf):
    tables = {"customer": base(spark, sf, "customer").withColumnRenamed("c_nationkey", "nk"), "supplier": base(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nk"), "part": base(spark, sf, "part")}
    left = relational.delete_scoped(tables, nk=3)
    return graph_projection.union_all([df.agg(F.lit(k).alias("name"), F.count("*").alias("n")).select("name", "n") for k, df in left.items()])


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def a35_best_wins(spark, sf):
    return relational.best_wins(base(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", [F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber")


# C: functions


@query(r"SELECT id, regexp_replace(symbol_fqn, '^.*\.', '') AS simple, split_part(symbol_fqn, '#', 1) AS own FROM f_nodes WHERE symbol_fqn IS NOT NULL")
def c01_c02_names(spark, sf):
    return fact(spark, sf, "nodes").filter("symbol_fqn IS NOT NULL").select("id", T.simple_name("symbol_fqn").alias("simple"), T.class_part("symbol_fqn").alias("own"))


@query(r"SELECT operation_id, upper(http_method) || '|' || regexp_replace(regexp_replace(regexp_replace(path_template, '\{[^}]+\}', '{*}', 'g'), '/+', '/', 'g'), '/$', '') AS k FROM f_contracts")
def c04_c06_paths(spark, sf):
    return fact(spark, sf, "contracts").select("operation_id", T.match_key("http_method", T.normalize_inbound_path("path_template")).alias("k"))


@query("SELECT DISTINCT lower(replace(table_or_entity, '_', '')) AS t FROM f_accesses")
def c07_tables(spark, sf):
    return fact(spark, sf, "accesses").select(T.normalize_table("table_or_entity").alias("t")).distinct()


@query("SELECT short_id, count(*) AS n FROM f_resources WHERE regexp_matches(short_id, '^PDN_.\\.N1.*$') GROUP BY 1")
def c09_glob(spark, sf):
    return fact(spark, sf, "resources").filter(T.glob_match("short_id", "PDN_?.N1*")).groupBy("short_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT short_id, CASE WHEN position('_T.' IN short_id) > 0 THEN substring(short_id, position('_T.' IN short_id) + 3) ELSE short_id END AS stem, replace(short_id, '_S.', '_T.') AS topic FROM f_resources")
def c11_topics(spark, sf):
    return fact(spark, sf, "resources").select("short_id", T.topic_stem("short_id").alias("stem"), T.subscription_topic("short_id").alias("topic")).distinct()


@query("SELECT service_id, CASE WHEN len(t) = 1 THEN t[1] WHEN list_contains(t, 'KAFKA') THEN 'KAFKA' ELSE 'PUBSUB' END AS transport FROM (SELECT service_id, list(DISTINCT coalesce(json_extract_string(attributes, '$.transport'), 'PUBSUB')) AS t FROM f_resources GROUP BY 1)")
def c12_c13_transport(spark, sf):
    return fact(spark, sf, "resources").groupBy("service_id").agg(T.hop_transport(F.collect_set(T.transport("attributes"))).alias("transport"))


@query("SELECT trigger_id, split_part(linked_handler_fqn, '#', 1) AS class_fqn, split_part(linked_handler_fqn, '#', 2) AS method FROM f_triggers")
def c14_handlers(spark, sf):
    return fact(spark, sf, "triggers").select("trigger_id", T.parse_handler("linked_handler_fqn").alias("h")).select("trigger_id", "h.*")


@query("SELECT DISTINCT dao_method, CASE WHEN starts_with(lower(dao_method), 'save') THEN 'WRITE' ELSE 'READ' END AS op FROM f_accesses")
def c23_operations(spark, sf):
    return fact(spark, sf, "accesses").select("dao_method", T.operation_of("dao_method").alias("op")).distinct()


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def c25_slug(spark, sf):
    return base(spark, sf, "part").select("p_partkey", T.slug("p_name").alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 1024 THEN substring(text, 1, 1004) || '::h:' || substring(sha256(text), 1, 16) ELSE text END AS id FROM documents")
def c27_bounded_ids(spark, sf):
    return base(spark, sf, "documents").select("doc_id", T.bounded_id("text").alias("id"))


@query("SELECT job_id, CAST(least(30000 * pow(2, job_id % 10), 600000) AS BIGINT) AS wait FROM f_runs")
def c29_backoff(spark, sf):
    return fact(spark, sf, "runs").select("job_id", T.retry_delay_ms(F.col("job_id") % 10 + 1, 30000).alias("wait"))


@query("SELECT page_id, '%' || regexp_extract(url, '(/?[^/]*)$', 1) AS pattern FROM pages")
def c31_suffix(spark, sf):
    return base(spark, sf, "pages").select("page_id", T.path_suffix_pattern("url").alias("pattern"))


# G: graph


def _graph(spark, sf):
    return fact(spark, sf, "nodes"), fact(spark, sf, "edges")


def _reach(start: str, types: str, reverse: bool = False, where: str = "true") -> str:
    a, b = ("to_node", "from_node") if reverse else ("from_node", "to_node")
    return (
        f"WITH RECURSIVE e AS (SELECT DISTINCT {a} AS s, {b} AS d FROM f_edges WHERE edge_type IN ({types})), "
        f"r AS (SELECT d FROM e WHERE s = '{start}' UNION SELECT e.d FROM r JOIN e ON e.s = r.d) "
        f"SELECT '{start}' AS seed, r.d AS node FROM r JOIN f_nodes n ON n.id = r.d WHERE {where}"
    )


@query(_reach("nation::1", "'CALLS'", where="n.node_type = 'SERVICE'"))
def g05_service_forward(spark, sf):
    return traverse.service_calls_forward(*_graph(spark, sf), traverse.seeds_of(spark, ["nation::1"]))


@query(_reach("supplier::3", "'DEPENDS_ON', 'INVOKES', 'ROUTES_TO', 'IMPLEMENTS'", where="n.node_type IN ('CLASS', 'METHOD')"))
def g06_class_forward(spark, sf):
    return traverse.class_forward(*_graph(spark, sf), traverse.seeds_of(spark, ["supplier::3"]))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT from_node AS s, to_node AS d FROM f_edges WHERE edge_type IN ('INVOKES', 'ROUTES_TO')),
r AS (SELECT d, 1 AS k FROM e WHERE s = 'supplier::3' UNION SELECT e.d, k + 1 FROM r JOIN e ON e.s = r.d WHERE k < 4)
SELECT DISTINCT 'supplier::3' AS seed, r.d AS node FROM r JOIN f_nodes n ON n.id = r.d""")
def g07_method_forward(spark, sf):
    return traverse.method_forward(*_graph(spark, sf), traverse.seeds_of(spark, ["supplier::3"]), 4)


@query(_reach("customer::5", "'OUTBOUND_TO'"))
def g08_outbound(spark, sf):
    return traverse.endpoint_outbound(*_graph(spark, sf), traverse.seeds_of(spark, ["customer::5"]))


_REVERSE = "'CALLS', 'DEPENDS_ON', 'USES_TYPE', 'INVOKES', 'ROUTES_TO'"


@query(_reach("region::2", _REVERSE, reverse=True))
def g09_reverse(spark, sf):
    return traverse.reverse_reachability(*_graph(spark, sf), traverse.seeds_of(spark, ["region::2"]))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT to_node AS s, from_node AS d FROM f_edges WHERE edge_type IN ({_REVERSE})),
r AS (SELECT e.s AS seed, e.d FROM e WHERE e.s LIKE 'region::%' OR e.s LIKE 'nation::%' UNION SELECT r.seed, e.d FROM r JOIN e ON e.s = r.d)
SELECT seed, count(*) AS reached FROM r JOIN f_nodes n ON n.id = r.d GROUP BY 1""")
def g09_reverse_all_services(spark, sf):
    nodes, edges = _graph(spark, sf)
    seeds = nodes.filter("node_type = 'SERVICE'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return traverse.reverse_reachability(nodes, edges, seeds).groupBy("seed").agg(F.count("*").alias("reached"))


@query("""WITH e AS (SELECT from_node AS a, to_node AS b FROM f_edges WHERE edge_type IN ('CALLS', 'DEPENDS_ON', 'INVOKES', 'ROUTES_TO', 'OUTBOUND_TO', 'PUBLISHES_TO', 'SUBSCRIBES_TO'))
SELECT 'nation::7' AS seed, x AS node FROM (SELECT b AS x FROM e WHERE a = 'nation::7' UNION SELECT a FROM e WHERE b = 'nation::7') JOIN f_nodes ON id = x WHERE x <> 'nation::7'""")
def g10_neighborhood(spark, sf):
    return traverse.neighborhood(*_graph(spark, sf), traverse.seeds_of(spark, ["nation::7"]))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT from_node AS s, to_node AS d FROM f_edges WHERE edge_type IN ('OUTBOUND_TO', 'CALLS')),
h AS (SELECT service FROM f_nodes WHERE id = 'customer::8'),
r AS (SELECT e.d FROM e JOIN f_nodes n ON n.id = e.d, h WHERE e.s = 'customer::8' AND n.service <> h.service UNION SELECT e.d FROM r JOIN e ON e.s = r.d)
SELECT DISTINCT 'customer::8' AS seed, r.d AS node FROM r JOIN f_nodes n ON n.id = r.d, h WHERE n.service <> h.service""")
def g11_boundary(spark, sf):
    return traverse.cross_service_boundary(*_graph(spark, sf), traverse.seeds_of(spark, ["customer::8"]))


@query("SELECT id FROM f_nodes WHERE module_type = 'library' AND symbol_fqn = 'lib.Brand#11'")
def g12_shared_types(spark, sf):
    return traverse.shared_types(fact(spark, sf, "nodes"), "lib.Brand#11")


@query("SELECT DISTINCT from_node AS id FROM f_edges WHERE edge_type = 'USES_TYPE' AND to_node IN (SELECT id FROM f_nodes WHERE module_type = 'library' AND symbol_fqn = 'lib.Brand#11')")
def g13_fan_out(spark, sf):
    return traverse.type_fan_out(*_graph(spark, sf), "lib.Brand#11")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT from_node AS s, to_node AS d FROM f_edges WHERE edge_type IN ('CALLS', 'DEPENDS_ON', 'OUTBOUND_TO')),
r AS (SELECT id AS d, 0 AS k FROM f_nodes WHERE node_type = 'CLASS' UNION SELECT e.d, k + 1 FROM r JOIN e ON e.s = r.d WHERE k < 3) SELECT d AS node, min(k) AS depth FROM r GROUP BY 1""")
def g14_bfs(spark, sf):
    nodes, edges = _graph(spark, sf)
    seeds = nodes.filter("node_type = 'CLASS'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return traverse.bfs(edges, seeds, 3, ["CALLS", "DEPENDS_ON", "OUTBOUND_TO"])


@query("SELECT from_node, to_node, edge_type FROM f_edges WHERE from_node IN (SELECT id FROM f_nodes WHERE node_type = 'SERVICE') AND to_node IN (SELECT id FROM f_nodes WHERE node_type = 'SERVICE')")
def g15_edges_between(spark, sf):
    nodes, edges = _graph(spark, sf)
    return traverse.edges_between(edges, nodes.filter("node_type = 'SERVICE'")).select("from_node", "to_node", "edge_type")


@query("SELECT n.symbol_fqn AS symbol, coalesce(min(t.symbol_fqn), n.symbol_fqn) AS class_fqn FROM f_nodes n LEFT JOIN f_edges e ON e.from_node = n.id AND e.edge_type = 'IMPLEMENTS' LEFT JOIN f_nodes t ON t.id = e.to_node WHERE n.node_type IN ('CLASS', 'METHOD') GROUP BY n.symbol_fqn")
def g16_implementations(spark, sf):
    nodes, edges = _graph(spark, sf)
    return traverse.implementation_of(nodes, edges, nodes.filter("node_type IN ('CLASS', 'METHOD')").select(F.col("symbol_fqn").alias("symbol")))


@query("SELECT id, max(service) AS service, max(symbol_fqn) AS symbol_fqn FROM f_nodes GROUP BY 1")
def g02_upsert_nodes(spark, sf):
    return graph_projection.upsert_nodes(fact(spark, sf, "nodes").withColumn("seq", F.lit(1))).select("id", "service", "symbol_fqn")


@query("SELECT from_node, to_node, edge_type FROM f_edges WHERE NOT (from_node LIKE 'nation::%' AND edge_type = 'CALLS') UNION ALL SELECT DISTINCT from_node, from_node, 'CALLS' FROM f_edges WHERE from_node LIKE 'nation::%' AND edge_type = 'CALLS'")
def g04_replace_edges(spark, sf):
    edges = fact(spark, sf, "edges").select("from_node", "to_node", "edge_type")
    new = edges.filter("from_node LIKE 'nation::%' AND edge_type = 'CALLS'").select("from_node", F.col("from_node").alias("to_node"), "edge_type").distinct()
    return graph_projection.replace_edges(edges, new)


@query("""WITH s AS (SELECT service, min(id) AS id FROM f_nodes WHERE node_type = 'SERVICE' GROUP BY 1)
SELECT DISTINCT a.id AS from_node, b.id AS to_node FROM f_edges e JOIN f_nodes x ON x.id = e.from_node JOIN f_nodes y ON y.id = e.to_node JOIN s a ON a.service = x.service JOIN s b ON b.service = y.service WHERE e.edge_type = 'OUTBOUND_TO' AND x.service <> y.service""")
def g22_service_calls(spark, sf):
    return graph_projection.service_calls(*_graph(spark, sf)).select("from_node", "to_node")


@query("""SELECT DISTINCT service_id || '::class::' || linked_class_fqn AS from_node, org_id || ':' || lower(resource_kind) || ':pdn:' || short_id AS to_node, CASE role WHEN 'PUBLISH' THEN 'PUBLISHES_TO' ELSE 'SUBSCRIBES_TO' END AS edge_type FROM f_resources WHERE linked_class_fqn IS NOT NULL""")
def g24_messaging_edges(spark, sf):
    r = fact(spark, sf, "resources").withColumns({"env_lane": F.lit("pdn"), "evidence_source": F.lit("YAML")})
    none = spark.createDataFrame([], "service_id string, guarded_symbol string, gate_key string, confidence double, evidence_source string")
    return graph_projection.project_messaging(r, none).select("from_node", "to_node", "edge_type")


@query("""SELECT DISTINCT 'acme::entry::' || service_id || '::pdn::' || trigger_id AS from_node, service_id || '::class::' || split_part(linked_handler_fqn, '#', 1) AS to_node, 'TRIGGERED_BY' AS edge_type FROM f_triggers
UNION SELECT 'acme::entry::' || service_id || '::pdn::' || trigger_id, service_id || '::endpoint::' || linked_handler_fqn, 'EXPOSES' FROM f_triggers""")
def g26_trigger_edges(spark, sf):
    t = fact(spark, sf, "triggers").withColumns({"org_id": F.lit("acme"), "env_lane": F.lit("pdn"), "confidence": F.lit(0.9), "evidence_source": F.lit("x")})
    return graph_projection.project_triggers(t).select("from_node", "to_node", "edge_type")


# E: analysis


@query(f"""WITH l AS (SELECT service_id, arg_max(status, (enqueued_at, job_id)) AS status, arg_max(coalesce(completed_at, TIMESTAMP '1970-01-01'), (enqueued_at, job_id)) AS done FROM f_runs GROUP BY 1)
SELECT service_id, status, CASE WHEN status IN ('RUNNING', 'QUEUED') THEN 'INDEXING' WHEN status <> 'COMPLETE' THEN 'NOT_INDEXED' WHEN done > {AS_OF} - INTERVAL 60 MINUTE THEN 'CURRENT' ELSE 'STALE' END AS freshness,
  CASE WHEN status IN ('RUNNING', 'QUEUED') THEN 202 WHEN status <> 'COMPLETE' THEN 404 ELSE 200 END AS http_status FROM l""")
def e01_freshness(spark, sf):
    runs = fact(spark, sf, "runs")
    return analysis.freshness(runs.select("service_id").distinct(), runs, F.expr(AS_OF))


@query("SELECT service_id, arg_max(commit_sha, (completed_at, commit_sha)) AS commit_sha FROM f_runs WHERE status = 'COMPLETE' GROUP BY 1")
def e04_latest_commits(spark, sf):
    return analysis.latest_commits(fact(spark, sf, "runs"))


def _symbols(spark, sf):
    s = fact(spark, sf, "symbols")
    runs = s.select("service_id", "commit_sha", F.lit("COMPLETE").alias("status"), F.col("indexed_at").alias("completed_at"))
    return s, runs


_GAPS = r"""WITH c AS (SELECT service_id, arg_max(commit_sha, (indexed_at, commit_sha)) AS commit_sha FROM f_symbols GROUP BY 1),
s AS (SELECT DISTINCT service_id, symbol_fqn, file_path, regexp_replace(symbol_fqn, '^.*\.', '') AS simple FROM f_symbols JOIN c USING (service_id, commit_sha)),
p AS (SELECT DISTINCT service_id, symbol_fqn, simple FROM s WHERE contains(file_path, 'src/main/java/')),
t AS (SELECT DISTINCT service_id, simple AS test FROM s WHERE regexp_matches(simple, '(Test|Tests|IT)$') OR contains(file_path, 'src/test/java/')),
g AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.service_id = p.service_id AND (test IN (simple || 'Test', simple || 'Tests', simple || 'IT') OR starts_with(test, 'Test' || simple)))) """


@query(_GAPS + "SELECT service_id, symbol_fqn, CASE WHEN contains(simple, 'Controller') THEN 'CONTROLLER' ELSE 'CLASS' END AS gap_kind FROM g")
def e05_gap_report(spark, sf):
    return analysis.gap_report(*_symbols(spark, sf))[0]


@query(_GAPS + "SELECT p.service_id, count(*) AS classes, count(g.symbol_fqn) AS untested FROM p LEFT JOIN g USING (service_id, symbol_fqn) GROUP BY 1")
def e05_gap_counts(spark, sf):
    return analysis.gap_report(*_symbols(spark, sf))[1]


@query("""WITH RECURSIVE e AS (SELECT DISTINCT to_node AS s, from_node AS d FROM f_edges WHERE edge_type IN ('CALLS', 'DEPENDS_ON', 'USES_TYPE', 'INVOKES', 'ROUTES_TO')),
a AS (SELECT id, symbol_fqn FROM f_nodes WHERE module_type = 'library'),
r AS (SELECT a.symbol_fqn AS seed, e.d FROM a JOIN e ON e.s = a.id UNION SELECT r.seed, e.d FROM r JOIN e ON e.s = r.d)
SELECT seed, n.service AS consumer_service, count(*) AS consumers FROM r JOIN f_nodes n ON n.id = r.d GROUP BY 1, 2""")
def e07_consumers(spark, sf):
    nodes, edges = _graph(spark, sf)
    changed = nodes.filter("module_type = 'library'").select("symbol_fqn", F.lit("TYPE").alias("symbol_kind"), F.lit("parts").alias("service_id"), F.lit("{}").alias("attributes"))
    registry = spark.createDataFrame([], "service_name string, service_id string")
    outbound = spark.createDataFrame([], "service_id string, source_symbol string, http_method string, path string")
    return analysis.affected_consumers(changed, nodes, edges, registry, outbound).groupBy("seed", "consumer_service").agg(F.count("*").alias("consumers"))


# F: contracts, catalogs, messaging, consistency, modules

_KEYS = r"""k AS (SELECT upper(http_method) || '|' || regexp_replace(regexp_replace(regexp_replace(CASE WHEN starts_with(path_template, '/') THEN path_template ELSE '/' || path_template END, '\{[^}]+\}', '{*}', 'g'), '/+', '/', 'g'), '/$', '') AS match_key, min(operation_id) AS a FROM f_contracts GROUP BY 1),
i AS (SELECT upper(http_method) || '|' || regexp_replace(regexp_replace(regexp_replace('/' || path_pattern, '\{[^}]+\}', '{*}', 'g'), '/+', '/', 'g'), '/$', '') AS match_key, min(trigger_id) AS b FROM f_triggers WHERE trigger_kind IN ('REST_INBOUND', 'WEBHOOK_INBOUND') GROUP BY 1)"""


@query("WITH " + _KEYS + " SELECT CASE WHEN b IS NULL THEN 'CONTRACT_ONLY' ELSE 'IMPLEMENTATION_ONLY' END AS gap_type, match_key, coalesce(a, b) AS subject FROM k FULL JOIN i USING (match_key) WHERE a IS NULL OR b IS NULL")
def f29_reconcile(spark, sf):
    return contracts.reconcile(fact(spark, sf, "contracts"), fact(spark, sf, "triggers"))


@query("WITH " + _KEYS + " SELECT CASE WHEN b IS NULL THEN 'CONTRACT_UNTESTED' ELSE 'TEST_UNDOCUMENTED' END AS gap_type, match_key, coalesce(a, b) AS subject FROM k FULL JOIN i USING (match_key) WHERE a IS NULL OR b IS NULL")
def f30_test_coverage(spark, sf):
    calls = fact(spark, sf, "triggers").filter("trigger_kind IN ('REST_INBOUND', 'WEBHOOK_INBOUND')").select("http_method", F.col("path_pattern").alias("path_normalized"), F.col("trigger_id").alias("test_symbol"))
    return contracts.test_coverage(fact(spark, sf, "contracts"), calls)


@query("""WITH r AS (SELECT DISTINCT mapped_service_name, 'svc' || regexp_replace(mapped_service_name, '^.*#0*', '') AS service_id FROM f_contracts WHERE mapped_service_name < 'Customer#000000900'), d AS (SELECT DISTINCT service_id FROM f_runs WHERE status = 'COMPLETE')
SELECT operation_id, CASE WHEN r.service_id IS NULL THEN 'SERVICE_NOT_REGISTERED' WHEN d.service_id IS NULL THEN 'IMPLEMENTATION_NOT_INDEXED' ELSE 'NO_HANDLER' END AS status FROM f_contracts c LEFT JOIN r USING (mapped_service_name) LEFT JOIN d ON d.service_id = r.service_id""")
def f31_entry_links(spark, sf):
    c = fact(spark, sf, "contracts")
    registry = c.filter("mapped_service_name < 'Customer#000000900'").select(F.col("mapped_service_name").alias("service_name"), F.concat(F.lit("svc"), F.regexp_replace("mapped_service_name", "^.*#0*", "")).alias("service_id")).distinct()
    return contracts.link_entries(c, registry, fact(spark, sf, "runs"), fact(spark, sf, "triggers").filter("trigger_kind = 'NONE'")).select("operation_id", "status")


@query("""WITH o AS (SELECT *, lower(replace(physical_name, '_', '')) AS t FROM f_objects), d AS (SELECT *, lower(replace(physical_name, '_', '')) AS t FROM f_ddl), a AS (SELECT *, lower(replace(table_or_entity, '_', '')) AS t FROM f_accesses)
SELECT DISTINCT 'INFERRED_NOT_IN_DDL' AS gap_type, service_id, physical_name AS subject FROM o WHERE store_type IN ('MARIADB', 'CASSANDRA') AND t NOT IN (SELECT t FROM d)
UNION SELECT 'DDL_UNREFERENCED', service_id, physical_name FROM d WHERE t NOT IN (SELECT t FROM o) UNION SELECT 'HANDLER_WITHOUT_CATALOG', service_id, handler_class_fqn FROM a WHERE t NOT IN (SELECT t FROM o)""")
def f35_catalog_gaps(spark, sf):
    return catalog.data_object_gaps(fact(spark, sf, "objects"), fact(spark, sf, "ddl"), fact(spark, sf, "accesses"))


@query("""WITH d AS (SELECT DISTINCT lower(replace(physical_name, '_', '')) AS t, catalog AS c FROM f_ddl)
SELECT physical_name, CASE WHEN bool_or(d.t IS NOT NULL AND (o.catalog = '' OR d.c = '' OR o.catalog = d.c)) THEN 'DDL_CONFIRMED' WHEN o.store_type IN ('MARIADB', 'CASSANDRA') THEN 'INFERRED_NOT_IN_DDL' END AS validation_status
FROM f_objects o LEFT JOIN d ON d.t = lower(replace(o.physical_name, '_', '')) GROUP BY physical_name, o.store_type""")
def f37_ddl_validation(spark, sf):
    return catalog.validate_objects(fact(spark, sf, "objects"), fact(spark, sf, "ddl")).select("physical_name", "validation_status")


@query("SELECT service_id, resource_kind, short_id, count(*) AS n FROM f_resources WHERE role = 'SUBSCRIBE' GROUP BY ALL")
def f01_inventory(spark, sf):
    return messaging.inventory(fact(spark, sf, "resources"), role="subscribe").groupBy("service_id", "resource_kind", "short_id").agg(F.count("*").alias("n"))


_TOPICS = "s AS (SELECT DISTINCT a.topic, b.next_topic FROM (SELECT service_id, replace(short_id, '_S.', '_T.') AS topic FROM f_resources WHERE role = 'SUBSCRIBE') a JOIN (SELECT service_id, short_id AS next_topic FROM f_resources WHERE role = 'PUBLISH') b USING (service_id) WHERE topic <> next_topic)"


@query(f"WITH RECURSIVE {_TOPICS}, r AS (SELECT 'PDN_T.N3' AS topic UNION SELECT s.next_topic FROM r JOIN s USING (topic)) SELECT count(*) AS topics FROM r")
def f07_topics_reached(spark, sf):
    return messaging.trace_topics(fact(spark, sf, "resources"), "PDN_T.N3", 1000).agg(F.count("*").alias("topics"))


#: The list of topics met is the queue as well: a step appends what its i-th topic leads to.
_TRACE = _TOPICS + """, n AS (SELECT topic, list(next_topic ORDER BY next_topic) AS nexts FROM s GROUP BY topic), q AS (SELECT ['PDN_T.N3'] AS q, 1 AS i
UNION ALL SELECT list_concat(q, list_filter(coalesce(n.nexts, []), lambda x: NOT list_contains(q, x))), i + 1 FROM q LEFT JOIN n ON n.topic = q[i] WHERE i <= 12 AND i <= len(q)),
hops AS (SELECT unnest(q[1:12]) AS topic, CAST(unnest(range(0, least(len(q), 12))) AS INT) AS hop FROM (SELECT q FROM q ORDER BY i DESC LIMIT 1))"""


@query(f"WITH RECURSIVE {_TRACE} SELECT topic, hop FROM hops")
def f07_trace(spark, sf):
    return messaging.trace_topics(fact(spark, sf, "resources"), "PDN_T.N3", 12)


@query()
def f09_hop_gaps(spark, sf):
    r = fact(spark, sf, "resources")
    hops = messaging.trace_topics(r, "PDN_T.N3", 12)
    return messaging.hop_gaps(hops, messaging.hop_participants(hops, r), ["PDN_T.N2*"])


@query()
def f12_summary(spark, sf):
    r = fact(spark, sf, "resources")
    hops = messaging.trace_topics(r, "PDN_T.N3", 12)
    people = messaging.hop_participants(hops, r)
    return messaging.flow_summary(hops, people, messaging.hop_gaps(hops, people))


@query("WITH s AS (SELECT DISTINCT short_id, replace(short_id, '_S.', '_T.') AS topic FROM f_resources WHERE resource_kind = 'SUBSCRIPTION'), t AS (SELECT DISTINCT short_id FROM f_resources WHERE resource_kind = 'TOPIC') SELECT s.short_id, topic, CASE WHEN t.short_id IS NULL THEN 'MISSING_TOPIC' ELSE 'LINKED_OK' END AS drift_status FROM s LEFT JOIN t ON t.short_id = s.topic")
def f40_drift(spark, sf):
    return messaging.drift(fact(spark, sf, "resources")).select("short_id", "topic", "drift_status")


@query("SELECT trigger_id, trigger_kind FROM f_triggers WHERE trigger_kind = 'REST_INBOUND' AND starts_with(linked_handler_fqn, 'com.acme.n1.Supplier1')")
def f22_triggers(spark, sf):
    t = fact(spark, sf, "triggers").withColumns({"env_lane": F.lit("pdn"), "source_ref": F.lit("src")})
    return entry_flow.entry_triggers(t, kind="REST_INBOUND", package="com.acme.n1.Supplier1").select("trigger_id", "trigger_kind")


@query("""WITH h AS (SELECT id AS handler, symbol_fqn AS class_fqn, regexp_replace(symbol_fqn, '^.*\\.', '') AS simple FROM f_nodes WHERE id LIKE 'supplier::%'), t AS (SELECT trigger_id, split_part(linked_handler_fqn, '#', 1) AS c FROM f_triggers),
x AS (SELECT handler, trigger_id, 'EXACT' AS match_kind FROM h JOIN t ON t.c = h.class_fqn)
SELECT * FROM x UNION SELECT handler, trigger_id, 'SIMPLE_NAME' FROM h JOIN t ON regexp_replace(t.c, '^.*\\.', '') = h.simple WHERE handler NOT IN (SELECT handler FROM x)""")
def f23_impact_by_handler(spark, sf):
    h = fact(spark, sf, "nodes").filter("id LIKE 'supplier::%'").select(F.col("id").alias("handler"), F.col("symbol_fqn").alias("class_fqn"), F.lit(None).cast("string").alias("method"))
    t = fact(spark, sf, "triggers").withColumns({"env_lane": F.lit("pdn"), "attributes": F.lit("{}")})
    return entry_flow.impact_by_handler(t, h).select("handler", "trigger_id", "match_kind")


@query("""SELECT service_id, dao_method, CASE WHEN operation = 'READ' THEN 'DUAL_READ_FALLBACK' WHEN count(DISTINCT store_type) > 1 THEN 'CROSS_STORE_WRITE' WHEN count(DISTINCT table_or_entity) > 1 THEN 'MULTI_TABLE_DOMAIN' ELSE 'DUAL_WRITE_SAME_HANDLER' END AS pattern, count(DISTINCT table_or_entity) AS n_tables
FROM f_accesses GROUP BY service_id, handler_class_fqn, dao_method, operation HAVING (operation = 'WRITE' AND count(*) >= 2) OR (operation = 'READ' AND count(DISTINCT store_type) >= 2)""")
def i20_scenarios(spark, sf):
    return consistency.infer_scenarios(fact(spark, sf, "accesses")).select("service_id", "dao_method", "pattern", F.size("tables").cast("long").alias("n_tables"))


@query("""SELECT DISTINCT 'UNDOCUMENTED_DUAL_WRITE' AS gap_type, service_id, handler_class_fqn || '#' || dao_method AS subject FROM (SELECT service_id, handler_class_fqn, dao_method FROM f_accesses WHERE operation = 'WRITE' GROUP BY ALL HAVING count(*) >= 2) WHERE CAST(substring(service_id, 4) AS BIGINT) >= 40""")
def f16_consistency_gaps(spark, sf):
    a = fact(spark, sf, "accesses")
    known = a.select("service_id", "handler_class_fqn").distinct().filter("CAST(substring(service_id, 4) AS BIGINT) < 40")
    scenarios = known.select("service_id", F.concat(F.lit("s"), "service_id").alias("scenario_id"), F.lit("HANDLER").alias("scope_kind"), F.col("handler_class_fqn").alias("scope_ref"), F.lit("INDEXED").alias("source"))
    return consistency.consistency_gaps(a, scenarios)


@query("WITH RECURSIVE p AS (SELECT module_path AS m, CASE WHEN contains(module_path, '/') THEN regexp_replace(module_path, '/[^/]*$', '') END AS up FROM f_modules), r AS (SELECT m AS root, m, 0 AS depth FROM p WHERE up IS NULL UNION SELECT r.root, p.m, depth + 1 FROM r JOIN p ON p.up = r.m) SELECT root, m AS module_path, depth FROM r")
def f43_module_tree(spark, sf):
    m = fact(spark, sf, "modules")
    return catalog.module_tree(m, m.filter("NOT contains(module_path, '/')"))


@query("SELECT module_path FROM f_modules ORDER BY CASE packaging WHEN 'jar' THEN 0 WHEN 'war' THEN 1 ELSE 2 END, length(module_path) DESC, module_path LIMIT 1")
def f42_default_module(spark, sf):
    return catalog.find_module(fact(spark, sf, "modules")).select("module_path")


# H: the job stream in batch form


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'BASELINE' ELSE 'DELTA' END AS snapshot_type FROM events")
def h06_snapshot_type(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "NIGHTLY").otherwise("PR")
    return base(spark, sf, "events").select("event_id", jobs.snapshot_type(kind).alias("snapshot_type"))


@query("""WITH x AS (SELECT user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' WHEN 'signup' THEN 'QUEUED' ELSE 'DLQ' END AS event FROM events),
y AS (SELECT job_id, max(list_position(['QUEUED', 'RUNNING', 'FAILED', 'COMPLETE', 'DLQ'], event)) AS k FROM x GROUP BY 1) SELECT job_id, ['QUEUED', 'RUNNING', 'FAILED', 'COMPLETE', 'DLQ'][k] AS status FROM y""")
def h04_run_states(spark, sf):
    r = fact(spark, sf, "runs").select(F.regexp_replace("service_id", "svc", "").cast("long").alias("job_id"), "service_id", F.col("status").alias("event"), "attempt", F.col("enqueued_at").alias("at"))
    return jobs.fold_runs(r).select("job_id", "status")


@query("SELECT service_id, count(*) AS depth FROM f_runs WHERE status = 'DLQ' GROUP BY 1")
def h07_dead_letters(spark, sf):
    return jobs.dead_letter_depth(fact(spark, sf, "runs"))


# I: extractors over page texts


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))::BIGINT AS links FROM pages")
def i_links(spark, sf):
    pages = base(spark, sf, "pages")
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query()
def i04_peripherals(spark, sf):
    pages = base(spark, sf, "pages").select(F.col("url").alias("path"), F.lit("web").alias("service_id"), F.col("html").alias("text"))
    return extract.peripherals(pages)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return g09_reverse(spark, sf)
