"""The driver's tables seen as facts.

Each fact table is one SELECT that Spark and DuckDB both understand, so a query
and its oracle start from the same rows.  The analogies are this repository's
own: regions and nations are services, customers and suppliers classes, brands
library types, events runs, orders symbols and contract operations, line items
calls and data accesses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import dealt

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")

FACTS = {
    "nodes": """
SELECT 'region::' || CAST(r_regionkey AS STRING) AS id, 'acme' AS org_id, 'world' AS repo, r_name AS service, 'service' AS module_type, 'SERVICE' AS node_type, CAST(NULL AS STRING) AS symbol_fqn FROM region
UNION ALL SELECT 'nation::' || CAST(n_nationkey AS STRING), 'acme', 'world', n_name, 'service', 'SERVICE', CAST(NULL AS STRING) FROM nation
UNION ALL SELECT 'customer::' || CAST(c_custkey AS STRING), 'acme', 'sales', n_name, 'service', 'CLASS', 'com.acme.n' || CAST(c_nationkey AS STRING) || '.Customer' || CAST(c_custkey AS STRING) FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'supplier::' || CAST(s_suppkey AS STRING), 'acme', 'supply', n_name, 'service', CASE WHEN s_acctbal > 5000 THEN 'METHOD' ELSE 'CLASS' END, 'com.acme.n' || CAST(s_nationkey AS STRING) || '.Supplier' || CAST(s_suppkey AS STRING) FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT DISTINCT 'brand::' || p_brand, 'acme', 'parts', 'parts', 'library', 'SHARED_TYPE', 'lib.' || p_brand FROM part""",
    "edges": """
SELECT 'customer::' || CAST(c_custkey AS STRING) AS from_node, 'nation::' || CAST(c_nationkey AS STRING) AS to_node, 'DEPENDS_ON' AS edge_type, 1.0 AS confidence FROM customer
UNION ALL SELECT 'nation::' || CAST(n_nationkey AS STRING), 'region::' || CAST(n_regionkey AS STRING), 'CALLS', 1.0 FROM nation
UNION ALL SELECT 'nation::' || CAST(n_nationkey AS STRING), 'nation::' || CAST((n_nationkey * 3 + 1) % 25 AS STRING), 'CALLS', 1.0 FROM nation WHERE (n_nationkey * 3 + 1) % 25 <> n_nationkey
UNION ALL SELECT 'supplier::' || CAST(s_suppkey AS STRING), 'supplier::' || CAST((s_suppkey + 1) % n AS STRING), 'INVOKES', 0.9 FROM supplier CROSS JOIN (SELECT count(*) AS n FROM supplier) c
UNION ALL SELECT 'supplier::' || CAST(s_suppkey AS STRING), 'supplier::' || CAST((s_suppkey * 7) % n AS STRING), 'ROUTES_TO', 0.95 FROM supplier CROSS JOIN (SELECT count(*) AS n FROM supplier) c
UNION ALL SELECT 'customer::' || CAST(c_custkey AS STRING), 'supplier::' || CAST(c_custkey % n AS STRING), 'OUTBOUND_TO', 0.9 FROM customer CROSS JOIN (SELECT count(*) AS n FROM supplier) c
UNION ALL SELECT 'supplier::' || CAST(s_suppkey AS STRING), 'nation::' || CAST(s_nationkey AS STRING), 'OUTBOUND_TO', 0.9 FROM supplier
UNION ALL SELECT 'supplier::' || CAST(s_suppkey AS STRING), 'customer::' || CAST(s_suppkey AS STRING), 'IMPLEMENTS', 0.95 FROM supplier
UNION ALL SELECT DISTINCT 'supplier::' || CAST(l_suppkey AS STRING), 'brand::' || p_brand, 'USES_TYPE', 1.0 FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "runs": """
SELECT event_id AS job_id, 'svc' || CAST(user_id AS STRING) AS service_id, 'acme' AS org_id, 'c' || CAST(event_id AS STRING) AS commit_sha,
  CASE event_type WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' WHEN 'signup' THEN 'QUEUED' ELSE 'DLQ' END AS status,
  ts AS enqueued_at, CASE WHEN event_type = 'purchase' THEN ts END AS completed_at, CAST(1 AS INT) AS attempt FROM events""",
    "symbols": """
SELECT 'svc' || CAST(o_custkey AS STRING) AS service_id, o_orderstatus AS commit_sha, 'com.acme.' || replace(o_orderpriority, ' ', '') || '.C' || CAST(o_orderkey AS STRING) ||
  CASE WHEN o_totalprice > 200000 THEN 'Controller' WHEN o_totalprice < 60000 THEN 'Test' ELSE '' END AS symbol_fqn, 'CLASS' AS symbol_kind,
  CASE WHEN o_totalprice < 60000 THEN 'src/test/java/' ELSE 'src/main/java/' END || CAST(o_orderkey AS STRING) || '.java' AS file_path, o_orderdate AS indexed_at FROM orders""",
    "contracts": """
SELECT DISTINCT 'op' || CAST(o_custkey AS STRING) || o_orderpriority AS operation_id, CASE WHEN o_orderpriority < '3' THEN 'get' ELSE 'post' END AS http_method,
  '/orders/{id}/' || CAST(o_custkey AS STRING) || '/' AS path_template, c_name AS mapped_service_name FROM orders JOIN customer ON c_custkey = o_custkey""",
    "triggers": """
SELECT DISTINCT 't' || CAST(l_suppkey AS STRING) || l_returnflag AS trigger_id, 'svc' || CAST(l_suppkey AS STRING) AS service_id, CASE l_returnflag WHEN 'A' THEN 'REST_INBOUND' WHEN 'N' THEN 'WEBHOOK_INBOUND' ELSE 'PUBSUB_SUBSCRIBE' END AS trigger_kind,
  CASE WHEN l_returnflag = 'A' THEN 'GET' ELSE 'POST' END AS http_method, 'orders/{orderId}//' || CAST(l_suppkey * 3 AS STRING) AS path_pattern,
  'com.acme.n1.Supplier' || CAST(l_suppkey AS STRING) || '#on' || l_returnflag AS linked_handler_fqn FROM lineitem""",
    "accesses": """
SELECT DISTINCT 'svc' || CAST(l_suppkey AS STRING) AS service_id, 'com.acme.H' || CAST(l_suppkey AS STRING) AS handler_class_fqn, 'save' || CAST(l_linenumber AS STRING) AS dao_method,
  CASE WHEN l_returnflag = 'R' THEN 'READ' ELSE 'WRITE' END AS operation, CASE l_linestatus WHEN 'O' THEN 'MARIADB' ELSE 'CASSANDRA' END AS store_type, 'Part_' || CAST(l_partkey AS STRING) AS table_or_entity FROM lineitem""",
    "objects": """
SELECT 'svc' || CAST(p_size AS STRING) AS service_id, 'Part_' || CAST(p_partkey AS STRING) AS physical_name, CASE WHEN p_retailprice > 1500 THEN 'MONGODB' ELSE 'MARIADB' END AS store_type,
  CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS catalog FROM part""",
    "ddl": """
SELECT DISTINCT 'ddl' AS service_id, 'PART' || CAST(l_partkey AS STRING) AS physical_name, '' AS catalog FROM lineitem WHERE l_discount < 0.01
UNION SELECT 'ddl', 'SUPPLIER' || CAST(s_suppkey AS STRING), 'main' FROM supplier""",
    "resources": """
SELECT 'acme' AS org_id, n_name AS service_id, 'world' AS repo, 'TOPIC' AS resource_kind, 'PDN_T.N' || CAST(s_nationkey AS STRING) AS short_id, 'PUBLISH' AS role,
  CASE WHEN s_acctbal > 0 THEN 'com.acme.P' || CAST(s_suppkey AS STRING) END AS linked_class_fqn, '{"transport": "' || CASE WHEN s_acctbal > 5000 THEN 'KAFKA' ELSE 'PUBSUB' END || '"}' AS attributes, 0.9 AS confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'acme', n_name, 'world', 'SUBSCRIPTION', 'PDN_S.N' || CAST((c_nationkey * 7 + 3) % 30 AS STRING), 'SUBSCRIBE',
  CASE WHEN c_acctbal > 0 THEN 'com.acme.S' || CAST(c_custkey AS STRING) END, '{}', 0.8 FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "modules": """
SELECT 'r' || CAST(r_regionkey AS STRING) AS module_path, 'pom' AS packaging, r_name AS artifact_id FROM region
UNION ALL SELECT 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING), 'war', n_name FROM nation
UNION ALL SELECT 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING), 'jar', c_name FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "registry": """
SELECT 'svc' || CAST(c_custkey AS STRING) AS service_id, 'acme' AS org_id, n_name AS repo, c_name AS service_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'library' ELSE 'service' END AS module_type, c_acctbal > 0 AS enabled,
  '{"description": "' || c_mktsegment || '", "owner": " ", "domain": "' || n_name || '"}' AS metadata FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "outbound": """
SELECT DISTINCT 'svc' || CAST(l_suppkey AS STRING) AS service_id, 'com.acme.n1.Supplier' || CAST(l_suppkey AS STRING) || '#call' AS source_symbol, CASE l_returnflag WHEN 'A' THEN 'GET' WHEN 'N' THEN 'POST' END AS http_method, '/parts/' || CAST(l_partkey AS STRING) AS path FROM lineitem""",
    "dependencies": """
SELECT l_orderkey * 10 + l_linenumber AS dependency_id, 'svc' || CAST(l_suppkey AS STRING) AS service_id, CASE WHEN l_returnflag = 'R' THEN 'old' ELSE 'new' END AS commit_sha, 'r1/n' || CAST(l_suppkey AS STRING) AS module_path,
  'com.g' || CAST(l_partkey % 10 AS STRING) AS to_group, 'p' || CAST(l_partkey AS STRING) AS to_artifact, CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS STRING) END AS to_version,
  CASE l_returnflag WHEN 'A' THEN 'compile' WHEN 'N' THEN 'runtime' ELSE 'test' END AS scope, l_linenumber > 3 AS transitive, l_linestatus = 'O' AS resolved FROM lineitem""",
    "gates": """
SELECT DISTINCT 'svc' || CAST(o_custkey AS STRING) AS service_id, 'com.acme.H' || CAST(o_custkey AS STRING) || '#run' AS guarded_symbol, 'gate.' || o_orderstatus AS gate_key, CASE o_orderstatus WHEN 'F' THEN 'BUSINESS_RULE' ELSE 'CODE_FLAG' END AS gate_kind, CASE o_orderstatus WHEN 'O' THEN 'true' ELSE 'x' END AS required_value FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P'""",
    "schemas": """
SELECT DISTINCT 'svc' || CAST(o_custkey AS STRING) AS service_id, 'com.acme.H' || CAST(o_custkey AS STRING) AS linked_class_fqn, 'Proto' || o_orderpriority AS payload_proto FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""",
    "sources": """
SELECT 'svc' || CAST(c_nationkey AS STRING) AS service_id, 'src/main/java/Customer' || CAST(c_custkey AS STRING) || 'Controller.java' AS path, 'package com.acme.n' || CAST(c_nationkey AS STRING) || ';' || chr(10) ||
  '@RestController' || chr(10) || '@RequestMapping("/n' || CAST(c_nationkey AS STRING) || '")' || chr(10) || 'public class Customer' || CAST(c_custkey AS STRING) || 'Controller implements Api' || CAST(c_nationkey AS STRING) || ' {' || chr(10) ||
  '  private final Nation' || CAST(c_nationkey AS STRING) || 'Repository repo;' || chr(10) || '  @GetMapping("/c/{id}")' || chr(10) || '  public Order getOne(String id, String x) { return repo.findById(id); }' || chr(10) ||
  '  @PostMapping("/c' || CAST(c_custkey AS STRING) || '/")' || chr(10) || '  public Order create(Order o) { client.get().uri("/stock/' || c_mktsegment || '"); return repo.save(o); }' || chr(10) || '}' || chr(10) AS text FROM customer""",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fact table; base tables become temporary views of their own names while it is planned, dealt to all tasks where a row becomes a source."""
    text = FACTS[name]
    for table in BASE:
        if table in text:
            rows = base(spark, sf_dir, table)
            (dealt(rows, "c_custkey") if (name, table) == ("sources", "customer") else rows).createOrReplaceTempView(table)
    return spark.sql(text)


def oracle(text: str) -> str:
    """``text`` with the fact tables it names as common table expressions."""
    import re

    used = [f"f_{n} AS ({FACTS[n]})" for n in FACTS if re.search(rf"\bf_{n}\b", text)]
    recursive = "RECURSIVE " if re.search(r"(?i)\bRECURSIVE\b", text) else ""
    rest = re.sub(r"(?is)^\s*WITH\s+(RECURSIVE\s+)?", "", text) if re.match(r"(?is)^\s*WITH\b", text) else None
    if not used:
        return text
    head = f"WITH {recursive}" + ", ".join(used)
    return f"{head}, {rest}" if rest else f"{head} {text}"
