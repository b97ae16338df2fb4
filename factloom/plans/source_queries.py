"""Queries of what is read from source texts: declarations, classes of topics, accesses; and their SQL.

A file is written for each row of a table, by a template into which the row's
values go.  What is found in it follows from the table alone, which is what the
SQL says.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access_links, class_links, consistency, graph_projection, messaging
from ..session import dealt, shared_folder
from ..sources import config, extract, fact_batches
from .adapters import base, fact
from .queries import query


def _filled(template: str, **values: Column) -> Column:
    """``template`` with each ``<name>`` replaced by a value."""
    parts = re.split(r"<(\w+)>", template)
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def _files(rows: DataFrame, path: str, template: str | Column, service: str | Column = "svc", **values: Column) -> DataFrame:
    text = template if isinstance(template, Column) else _filled(template, **values)
    return rows.select((F.lit(service) if isinstance(service, str) else service).alias("service_id"), _filled(path, **values).alias("path"), text.alias("text"))


def _parsed(rows: DataFrame, path: str, template: str | Column, service: str | Column = "svc", read: dict[str, bool] = {}, **values: Column) -> DataFrame:
    return extract.light_parse(_files(rows, path, template, service, **values), **read)


# I-01, I-03, I-19, I-25: declarations

_COMMENTED = """/* @RestController class Not { } */ package a;
@RestController @RequestMapping("/c<k>") public class C<k> implements Api<n> {
  // @PostMapping("/no")
  static final String S = "@PutMapping(\\"/no\\") public void put(int a, int b) { } // {";
  @GetMapping("/{id}/<n>") public Order one(String id, int n) { return null; } /* @DeleteMapping("/no") */
  static class In { @PatchMapping("/in") public void in(int a, int b) { } }
  enum Kind { A, B }
}
class Other { @GetMapping("/other") public void other(int a, int b) { } }
"""


def _commented(spark, sf, **read):
    return _parsed(dealt(base(spark, sf, "customer"), "c_custkey"), "src/main/java/C<k>.java", _COMMENTED, read=read, k=F.col("c_custkey"), n=F.col("c_nationkey"))


@query("SELECT 'a.C' || CAST(c_custkey AS STRING) AS class_fqn, 'GET' AS http_method, '/c' || CAST(c_custkey AS STRING) || '/{*}/' || CAST(c_nationkey AS STRING) AS path FROM customer")
def i01_endpoints_of_code(spark, sf):
    return extract.endpoints(_commented(spark, sf)).select("class_fqn", "http_method", "path")


@query("""SELECT symbol_kind, count(*) AS n FROM (SELECT unnest(['CLASS', 'METHOD', 'ENDPOINT']) AS symbol_kind FROM customer) GROUP BY 1""")
def i03_symbols_of_code(spark, sf):
    return extract.symbol_facts(_commented(spark, sf, calls=False, stage=False)).groupBy("symbol_kind").agg(F.count("*").alias("n"))


@query("""SELECT 'a.C' || CAST(c_custkey AS STRING) || s AS fqn, k AS kind FROM customer, (VALUES ('', 'class'), ('.In', 'class'), ('.Kind', 'enum')) t(s, k) UNION ALL SELECT 'a.Other', 'class' FROM customer""")
def i01_nested_types(spark, sf):
    return _commented(spark, sf, members=False).select(F.explode("types").alias("t")).select("t.fqn", "t.kind")


@query("SELECT path, 'PARSE_ERROR' AS reason_code FROM (SELECT 'src/' || CAST(n_nationkey AS STRING) || '.java' AS path, n_regionkey FROM nation) WHERE n_regionkey <> 0")
def i03_unsupported(spark, sf):
    texts = F.array(*map(F.lit, ("class A { }", "class A { void f() { }", "// class A { }", "", "class A { String s = \"}\"; } }")))
    n = base(spark, sf, "nation")
    return extract.unsupported(_files(n, "src/<k>.java", texts[F.col("n_regionkey").cast("int")], k=F.col("n_nationkey"))).select("path", "reason_code")


@query("""SELECT 'a.I' || CAST(n_nationkey AS STRING) AS class_fqn, unnest(CASE n_regionkey WHEN 0 THEN ['one', 'two'] WHEN 1 THEN ['one'] WHEN 2 THEN ['one', 'p'] WHEN 3 THEN ['two'] ELSE ['one'] END) AS name,
unnest(CASE n_regionkey WHEN 0 THEN ['LOMBOK_CONSTRUCTOR', 'LOMBOK_CONSTRUCTOR'] WHEN 1 THEN ['LOMBOK_CONSTRUCTOR'] WHEN 2 THEN ['FINAL_FIELD', 'CONSTRUCTOR'] WHEN 3 THEN ['Autowired'] ELSE ['FINAL_FIELD'] END) AS injection FROM nation""")
def i25_kinds_of_injection(spark, sf):
    head = F.array(*map(F.lit, ("@AllArgsConstructor", "@RequiredArgsConstructor", "", "", "// @AllArgsConstructor\n")))[F.col("n_regionkey").cast("int")]
    body = F.array(*map(F.lit, (
        "private final One one; private Two two; static Three three;", "private final One one; private Two two;", "private final One one; @Inject I<k>(@Qualifier(\"q\") Map<String, List<One>> p) { }",
        "/* @Autowired */ private One one; @Autowired Two two;", "private final One one; private final Two two = new Two() { int f; };",
    )))[F.col("n_regionkey").cast("int")]
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("package a; "), head, F.lit(" public class I"), key, F.lit(" { "), F.replace(body, F.lit("<k>"), key), F.lit(" }"))
    return extract.injections(_parsed(base(spark, sf, "nation"), "I<k>.java", text, k=key)).select("class_fqn", "name", "injection")


_CALLER = """package a; @RequiredArgsConstructor public class Caller<k> {
  private final Store<n> store; private Other other;
  public void run(int a, int b) { store.load<n>(a); helper(); log.info("store.no()"); store.chain().next(); other.no(); if (a < b) { this.store.kept(() -> store.inner()); } /* store.no() */ }
  public int getIt() { return store.no(); }
  void quiet() { store.no(); }
}"""


@query("""SELECT 'a.Caller' || CAST(c_custkey AS STRING) AS class_fqn, unnest(['Store' || CAST(c_nationkey AS STRING), 'a.Caller' || CAST(c_custkey AS STRING), 'Store' || CAST(c_nationkey AS STRING), 'a.Caller' || CAST(c_custkey AS STRING), 'Store' || CAST(c_nationkey AS STRING)]) AS callee_type,
unnest(['load' || CAST(c_nationkey AS STRING), 'helper', 'chain', 'kept', 'inner']) AS callee FROM customer""")
def i25_call_graph(spark, sf):
    p = _parsed(dealt(base(spark, sf, "customer"), "c_custkey"), "Caller<k>.java", _CALLER, read={"args": False, "stage": False}, k=F.col("c_custkey"), n=F.col("c_nationkey"))
    return extract.call_graph(p).select("class_fqn", "callee_type", "callee")


@query("""SELECT 'f.Factory' || CAST(n_regionkey AS STRING) AS factory_class_fqn, CASE WHEN n_nationkey % 2 = 0 THEN 'key' || CAST(n_nationkey AS STRING) ELSE 'Adapter' || CAST(n_nationkey AS STRING) END AS routing_key,
'a.Adapter' || CAST(n_nationkey AS STRING) AS implementor_fqn FROM nation WHERE n_nationkey % 5 <> 4""")
def i25_list_routes(spark, sf):
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    own = F.when(key % 2 == 0, _filled('static final String ADAPTER_NAME = "key<k>"; public String getAdapterName() { return Adapter<k>.ADAPTER_NAME; }', k=key)).otherwise("")
    text = F.concat(F.lit("package a; public "), F.when(key % 5 == 4, "abstract ").otherwise(""), _filled("class Adapter<k> implements x.Face<r> { ", k=key, r=region), own, F.lit(" }"))
    adapters = _files(base(spark, sf, "nation"), "Adapter<k>.java", text, k=key)
    make = "package f; public class Factory<r> { Factory<r>(List<Face<r>> all) { m = all.stream().collect(Collectors.toMap(Face<r>::getAdapterName, x -> x)); } public Face<r> pick(String k, int n) { return m.get(k); } }"
    factories = _files(base(spark, sf, "region"), "Factory<r>.java", make, r=F.col("r_regionkey"))
    return extract.list_routes(extract.light_parse(adapters.union(factories))).select("factory_class_fqn", "routing_key", "implementor_fqn")


@query("""SELECT 'a.K' || CAST(n_nationkey AS STRING) AS class_fqn, unnest(['FeignClient', 'RestClient', 'RestTemplate', 'RestTemplate', 'RestTemplate']) AS client, unnest(['GET', 'POST', 'GET', 'PUT', NULL]) AS http_method,
unnest(['/f/' || CAST(n_nationkey AS STRING), '/u', '/t/' || CAST(n_nationkey AS STRING), NULL, NULL]) AS path_text FROM nation""")
def i01_client_calls(spark, sf):
    text = """package a; @FeignClient("x") public class K<k> { RestTemplate rest; /* WebClient web; */
      @GetMapping("/f/<k>") public A feign(int a, int b) { client.post().uri("/u").retrieve(); rest.getForObject("/t/<k>", A.class); rest.exchange(u, HttpMethod.PUT, e); String s = "rest.getForObject(\\"/no\\")"; return null; } }"""
    p = _parsed(base(spark, sf, "nation"), "K<k>.java", text, k=F.col("n_nationkey"))
    return extract.client_calls(p).select("class_fqn", "client", "http_method", "path_text")


@query("SELECT 'a.U' || CAST(n_nationkey AS STRING) AS class_fqn, '/root' || CAST(n_regionkey AS STRING) || '/own' || CAST(n_nationkey AS STRING) || '/{*}' AS path FROM nation")
def i19_constants_in_paths(spark, sf):
    use = """package a; @RequestMapping(Paths<r>.ROOT + "/own") public class U<k> { private static final String SUB = "<k>/{id}"; @GetMapping(value = U<k>.SUB) public void f(int a, int b) { } }"""
    use = use.replace('"/own")', '"/own<k>")').replace('"<k>/{id}"', '"/{id}"')
    uses = _files(base(spark, sf, "nation"), "U<k>.java", use, k=F.col("n_nationkey"), r=F.col("n_regionkey"))
    paths = _files(base(spark, sf, "region"), "Paths<r>.java", 'package b; public class Paths<r> { public static final String ROOT = "/root<r>"; /* String ROOT = "/no"; */ }', r=F.col("r_regionkey"))
    p = extract.light_parse(uses.union(paths))
    return extract.endpoints(p, extract.constants(p)).select("class_fqn", "path")


# I-07: classes of topics and subscriptions; F-05, F-08 and G-24 on what they give


def _linked(spark, sf):
    """Topics and subscriptions of suppliers, linked to classes of theirs, of their nation's module, or of the service (a region)."""
    n = base(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    s = base(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    key, nation, region = F.col("s_suppkey"), F.col("n_nationkey"), F.concat(F.lit("svc"), "n_regionkey")
    resources = s.select(
        F.col("s_suppkey").alias("resource_id"), region.alias("service_id"), F.when(key % 5 == 4, "SUBSCRIPTION").otherwise("TOPIC").alias("resource_kind"), F.concat(F.lit("PDN_T.N"), key.cast("string")).alias("short_id"),
        F.when(key % 5 == 4, "SUBSCRIBE").otherwise("PUBLISH").alias("role"), F.concat(F.lit("pubsub.topicId.key"), key.cast("string"), F.lit("x")).alias("spring_key"), F.concat(F.lit("m"), nation.cast("string")).alias("module_name"),
        F.when(key % 5 == 3, '{"transport":"KAFKA"}').otherwise("{}").alias("attributes"), F.lit(None).cast("string").alias("linked_class_fqn"), F.lit(None).cast("string").alias("linked_method"),
        F.lit("YAML").alias("evidence_source"), F.lit(1.0).alias("confidence"), F.lit("acme").alias("org_id"), F.lit("pdn").alias("env_lane"),
    )
    own = _files(s.filter(key % 5 == 0), "m<n>/src/main/java/S<k>.java", 'package p; public class Own<k>Publisher { String k = "key<k>x"; }', region, k=key, n=nation)
    of_nation = _files(n.filter("n_nationkey % 2 = 0"), "m<n>/src/main/java/Z<n>.java", "package p; public class N<n>Publisher { /* none */ }", F.concat(F.lit("svc"), "n_regionkey"), n=nation)
    producers = _files(n.filter("n_nationkey % 3 = 0"), "m<n>/src/main/java/Q<n>.java", "package p; public class Q<n>Producer { KafkaTemplate<A, B> t; }", F.concat(F.lit("svc"), "n_regionkey"), n=nation)
    consumers = _files(base(spark, sf, "region"), "all/src/main/java/C<r>.java", "package p; public class C<r>Consumer { } // @KafkaListener", F.concat(F.lit("svc"), "r_regionkey"), r=F.col("r_regionkey"))
    parsed = extract.light_parse(own.union(of_nation).union(producers).union(consumers))
    rules = spark.createDataFrame([(1, "PUBLISH", None, "key7x", "r.Ruled", "send")], "position int, role string, module_name string, spring_key_leaf string, class_fqn string, method string")
    return class_links.link_resources(resources, class_links.message_classes(parsed), rules)


_LINKED = """WITH n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), s AS (SELECT s_suppkey AS k, n, r FROM supplier JOIN n ON n = s_nationkey),
c AS (SELECT r, n, 'm' || CAST(n AS STRING) || '/src/main/java/S' || CAST(k AS STRING) || '.java' AS path, 'p.Own' || CAST(k AS STRING) || 'Publisher' AS fqn, true AS pub FROM s WHERE k % 5 = 0
  UNION ALL SELECT r, n, 'm' || CAST(n AS STRING) || '/src/main/java/Z' || CAST(n AS STRING) || '.java', 'p.N' || CAST(n AS STRING) || 'Publisher', true FROM n WHERE n % 2 = 0
  UNION ALL SELECT r, n, 'm' || CAST(n AS STRING) || '/src/main/java/Q' || CAST(n AS STRING) || '.java', 'p.Q' || CAST(n AS STRING) || 'Producer', false FROM n WHERE n % 3 = 0),
pm AS (SELECT r, n, arg_min(fqn, path || fqn) AS fqn FROM c WHERE pub GROUP BY ALL), ps AS (SELECT r, arg_min(fqn, path || fqn) AS fqn FROM c WHERE pub GROUP BY ALL),
km AS (SELECT r, n, arg_min(fqn, path || fqn) AS fqn FROM c GROUP BY ALL), ks AS (SELECT r, arg_min(fqn, path || fqn) AS fqn FROM c GROUP BY ALL),
l AS (SELECT k AS resource_id, s.r, s.n, CASE WHEN k = 7 THEN 'r.Ruled' WHEN k % 5 = 4 THEN 'p.C' || CAST(s.r AS STRING) || 'Consumer' WHEN k % 5 = 0 THEN 'p.Own' || CAST(k AS STRING) || 'Publisher'
    WHEN k % 5 = 3 THEN coalesce(km.fqn, ks.fqn) ELSE coalesce(pm.fqn, ps.fqn) END AS linked_class_fqn,
  CASE WHEN k = 7 THEN 0.99 WHEN k % 5 = 4 THEN 0.85 WHEN k % 5 = 0 THEN 0.95 WHEN k % 5 = 3 THEN CASE WHEN km.fqn IS NOT NULL THEN 0.85 WHEN ks.fqn IS NOT NULL THEN 0.80 ELSE 1.0 END
    WHEN pm.fqn IS NOT NULL THEN 0.85 WHEN ps.fqn IS NOT NULL THEN 0.80 ELSE 1.0 END::DOUBLE AS confidence
  FROM s LEFT JOIN pm ON pm.r = s.r AND pm.n = s.n LEFT JOIN ps ON ps.r = s.r LEFT JOIN km ON km.r = s.r AND km.n = s.n LEFT JOIN ks ON ks.r = s.r)
"""


@query(_LINKED + "SELECT resource_id, linked_class_fqn, confidence FROM l")
def i07_linked_classes(spark, sf):
    return _linked(spark, sf).select("resource_id", "linked_class_fqn", F.round("confidence", 6).alias("confidence"))


@query(_LINKED + """SELECT 'svc' || CAST(r AS STRING) AS service_id, coalesce(linked_class_fqn, 'svc' || CAST(r AS STRING)) AS handler,
count(DISTINCT resource_id) FILTER (resource_id % 5 <> 4) AS publishes, count(DISTINCT resource_id) FILTER (resource_id % 5 = 4) AS subscribes FROM l GROUP BY ALL""")
def f05_linked_steps(spark, sf):
    none = lambda s: spark.createDataFrame([], s)
    steps = messaging.flow_steps(
        _linked(spark, sf), none("service_id string, linked_class_fqn string, payload_proto string"), none("service_id string, handler_class_fqn string, operation string, table_or_entity string"),
        none("service_id string, guarded_symbol string, gate_key string"),
    )
    return steps.select("service_id", "handler", F.size("publishes").cast("long").alias("publishes"), F.size("subscribes").cast("long").alias("subscribes"))


@query(_LINKED + "SELECT DISTINCT 'svc' || CAST(r AS STRING) || '::class::' || linked_class_fqn AS from_node, CASE WHEN resource_id % 5 = 4 THEN 'SUBSCRIBES_TO' ELSE 'PUBLISHES_TO' END AS edge_type, count(*) AS n FROM l WHERE linked_class_fqn IS NOT NULL GROUP BY ALL")
def g24_linked_edges(spark, sf):
    none = spark.createDataFrame([], "service_id string, guarded_symbol string, gate_key string, confidence double, evidence_source string")
    edges = graph_projection.project_messaging(_linked(spark, sf), none)
    return edges.groupBy("from_node", "edge_type").agg(F.count("*").alias("n"))


@query(_LINKED + "SELECT r AS service, linked_class_fqn, min('PDN_T.N' || CAST(resource_id AS STRING)) AS topic_short_id, CASE WHEN linked_class_fqn IS NULL THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence FROM l WHERE linked_class_fqn IS NOT NULL GROUP BY ALL")
def i07_schemas_to_topics(spark, sf):
    linked = _linked(spark, sf)
    schemas = linked.filter("linked_class_fqn IS NOT NULL").select("service_id", "linked_class_fqn").distinct().withColumns({"topic_short_id": F.lit(None).cast("string"), "confidence": F.lit(0.85)})
    out = class_links.schemas_to_topics(schemas, linked)
    return out.select(F.substring("service_id", 4, 9).cast("long").alias("service"), "linked_class_fqn", "topic_short_id", "confidence")


# I-09, I-10, I-16: accesses

_DAO = """package a; import d.domain.Dom<k>; public interface Part<k>Dao { void save(Dom<k> x); Dom<k> find(String id); }"""
_IMPL = """package a; import d.domain.Dom<k>; import e.Part<k>Entity; public class Part<k>DaoImpl implements Part<k>Dao { /* none */
  public void save(Dom<k> x) { } public Dom<k> find(String id) { return null; } Part<k>Entity mapDomainToEntity(Dom<k> x) { return null; } }"""
_HANDLER = """package h; import a.Part<k>Dao; public class H<k> { private final Part<k>Dao partDao; LostRepository lostRepo; // Part0Dao partDao;
  H<k>(Part<k>Dao partDao) { } public void on(int a, int b) { partDao.save(x); partDao.find("partDao.no()"); partDao.gone(); lostRepo.findAll(); } }"""


def _catalog(spark, sf):
    """Handlers of every part, DAOs of two in three, entities of the catalog of one in three."""
    p = dealt(base(spark, sf, "part").select("p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    service = F.concat(F.lit("svc"), (k % 2).cast("string"))
    files = _files(p.filter(k % 3 != 0), "Part<k>Dao.java", _DAO, service, k=k).union(_files(p.filter(k % 3 == 1), "Part<k>DaoImpl.java", _IMPL, service, k=k)).union(_files(p, "H<k>.java", _HANDLER, service, k=k))
    entities = p.filter(k % 3 == 1).select(
        service.alias("service_id"), _filled("e.Part<k>Entity", k=k).alias("entity_fqn"), F.lit(None).cast("string").alias("domain_fqn"), F.lit("CASSANDRA").alias("store_type"), _filled("t_<k>", k=k).alias("physical_name"),
        F.lit("main").alias("catalog"), F.lit("ENTITY_ANNOTATION").alias("evidence_source"), F.lit(0.9).alias("confidence"),
    )
    return extract.light_parse(files), entities


_K = "CAST(p_partkey AS STRING)"


@query(f"""SELECT 'a.Part' || {_K} || 'Dao' AS accessor_fqn, m AS method_name, CASE WHEN m = 'save' AND p_partkey % 3 = 1 THEN 'e.Part' || {_K} || 'Entity' END AS entity_fqn, CASE WHEN m = 'save' AND p_partkey % 3 = 1 THEN 't_' || {_K} END AS physical_name,
CASE WHEN m = 'find' THEN 0.75 WHEN p_partkey % 3 = 1 THEN 0.93 ELSE 0.80 END::DOUBLE AS confidence FROM part, (VALUES ('save'), ('find')) t(m) WHERE p_partkey % 3 <> 0""")
def i16_dao_methods(spark, sf):
    parsed, entities = _catalog(spark, sf)
    return access_links.dao_methods(parsed, entities).select("accessor_fqn", "method_name", "entity_fqn", "physical_name", "confidence")


@query(f"""SELECT 'h.H' || {_K} AS handler_class_fqn, m AS dao_method, CASE WHEN m = 'findAll' THEN 'lost' WHEN m = 'save' AND p_partkey % 3 = 1 THEN 't_' || {_K} ELSE 'part' || {_K} END AS table_or_entity,
CASE WHEN m = 'save' AND p_partkey % 3 = 1 THEN 'HANDLER_LINKER+CATALOG' WHEN p_partkey % 2 = 1 THEN 'HANDLER_WITHOUT_CATALOG' WHEN m IN ('save', 'find') AND p_partkey % 3 <> 0 THEN 'HANDLER_LINKER+CATALOG' ELSE 'HANDLER_LINKER' END AS evidence_source,
CASE WHEN m = 'save' AND p_partkey % 3 = 1 THEN 0.93 WHEN p_partkey % 2 = 1 THEN 0.75 ELSE 0.80 END::DOUBLE AS confidence FROM part, (VALUES ('save'), ('find'), ('gone'), ('findAll')) t(m)""")
def i09_ladder(spark, sf):
    parsed, entities = _catalog(spark, sf)
    pinned = base(spark, sf, "part").filter("p_partkey % 2 = 1").select(F.lit("svc1").alias("service_id"))
    got = access_links.handler_accesses(parsed, access_links.accessor_methods(parsed, entities), entities, pinned)
    return got.select("handler_class_fqn", "dao_method", "table_or_entity", "evidence_source", "confidence")


@query("""SELECT 'g.G' || CAST(n_nationkey AS STRING) AS handler_class_fqn, unnest(['findOne', 'save', 'insertAll']) AS dao_method, unnest(['mongo_template', 'docs' || CAST(n_nationkey AS STRING), 'out' || CAST(n_nationkey AS STRING)]) AS table_or_entity,
unnest(['MONGO_ACCESS', 'MONGO_ACCESS+CATALOG', 'BIGQUERY_DIRECT']) AS evidence_source, unnest([0.78, 0.90, 0.82]::DOUBLE[]) AS confidence FROM nation""")
def i10_mongo_and_bigquery(spark, sf):
    n, k = base(spark, sf, "nation"), F.col("n_nationkey")
    text = """package g; import org.x.MongoTemplate; import util.BigQueryUtil; public class G<k> { MongoTemplate mongoTemplate; mongo.Doc<k>Repository docRepository; BigQueryUtil bq; static final String T = "out<k>";
      public void go(int a, int b) { mongoTemplate.findOne(q); docRepository.save(d); docRepository.count(); bq.insertAll(d, x, T); /* bq.save(a, b, NO); */ } }"""
    parsed = _parsed(n, "G<k>.java", text, k=k)
    methods = n.select(_filled("mongo.Doc<k>Repository", k=k).alias("accessor_fqn"), F.lit("save").alias("method_name"), _filled("m.Doc<k>", k=k).alias("entity_fqn"), F.lit(None).cast("string").alias("domain_fqn"), F.lit(None).cast("string").alias("physical_name"))
    entities = n.select(_filled("m.Doc<k>", k=k).alias("entity_fqn"), _filled("docs<k>", k=k).alias("physical_name"))
    got = access_links.mongo_accesses(parsed, methods, entities).unionByName(access_links.bigquery_accesses(parsed))
    return got.select("handler_class_fqn", "dao_method", "table_or_entity", "evidence_source", "confidence")


@query("""SELECT 'o.Old' || CAST(n_nationkey AS STRING) AS handler_class_fqn, 'handle' AS handler_method, CASE WHEN n_regionkey = 1 THEN 'named' ELSE 'big_item' END AS table_or_entity, 'JAVA_AST' AS evidence_source FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT 'o.Old' || CAST(n_nationkey AS STRING), 'handle', 'order', 'HANDLER_LINKER' FROM nation WHERE n_regionkey = 2""")
def i10_last_resort(spark, sf):
    r = F.col("n_regionkey")
    body = F.when(r == 2, "OrderRepo orderRepo; public void handle(int a) { orderRepo.save(a); bigItemRepo.find(); }").otherwise("public int getX() { return 1; } public void handle(int a) { this.bigItemRepo.findAll(); } public void later() { }")
    text = F.concat(F.lit("package o; "), F.when(r == 1, '@Table(name = "named") ').otherwise(""), _filled("public class Old<k> { ", k=F.col("n_nationkey")), body, F.lit(" }"))
    parsed = _parsed(base(spark, sf, "nation"), "Old<k>.java", text, F.concat(F.lit("svc"), r), k=F.col("n_nationkey"))
    methods = spark.createDataFrame([], "service_id string, accessor_fqn string, method_name string, operation string, entity_fqn string, domain_fqn string, store_type string, physical_name string")
    entities = spark.createDataFrame([], "service_id string, entity_fqn string, domain_fqn string, store_type string, physical_name string, catalog string")
    got = access_links.all_accesses(parsed, methods, entities, spark.createDataFrame([], "service_id string"))
    return got.select("handler_class_fqn", "handler_method", "table_or_entity", "evidence_source")


@query("""SELECT 'c.CassandraR' || CAST(n_nationkey AS STRING) AS accessor_fqn, unnest(['byKey', 'setIt', 'deleteAll']) AS method_name, unnest(['READ', 'WRITE', 'WRITE']) AS operation, unnest(['t' || CAST(n_nationkey AS STRING), 'p' || CAST(n_nationkey AS STRING), 'p' || CAST(n_nationkey AS STRING)]) AS physical_name,
unnest([0.90, 0.90, 0.88]::DOUBLE[]) AS confidence FROM nation""")
def i16_query_methods(spark, sf):
    n, k = base(spark, sf, "nation"), F.col("n_nationkey")
    text = """package c; public interface CassandraR<k> extends CassandraRepository<Row<k>, String> { @Query("select * from \\"t<k>\\" where k = ?0") Row<k> byKey(String k); @Query("UPDATE x SET y = 1") void setIt(); void deleteAll(); Row<k> plain(); /* void save(Row r); */ }"""
    entities = n.select(F.lit("svc").alias("service_id"), _filled("c.Row<k>", k=k).alias("entity_fqn"), F.lit("d").alias("domain_fqn"), _filled("p<k>", k=k).alias("physical_name"))
    return access_links.query_methods(_parsed(n, "R<k>.java", text, k=k), entities).select("accessor_fqn", "method_name", "operation", "physical_name", "confidence")


@query("""SELECT 'm.Doc' || CAST(n_nationkey AS STRING) AS entity_fqn, 'ENTITY+REPO_GENERIC' || CASE WHEN n_nationkey % 2 = 0 THEN '+BQ_MIRROR' ELSE '' END AS evidence_source, CASE WHEN n_nationkey % 2 = 0 THEN 'bq' || CAST(n_nationkey AS STRING) END AS mirror FROM nation""")
def i16_repositories_and_mirrors(spark, sf):
    n, k = base(spark, sf, "nation"), F.col("n_nationkey")
    note = F.when(k % 2 == 0, _filled('@LogForBigQuerySync(tableName = "bq<k>", operation = Operation.INSERT)', k=k)).otherwise(_filled('// @LogForBigQuerySync(tableName = "bq<k>")\n', k=k))
    text = F.concat(_filled("package m; public interface Doc<k>Repository extends MongoRepository<Doc<k>, String> { ", k=k), note, _filled(" Doc<k> save(Doc<k> d); }", k=k))
    parsed = _parsed(n, "Doc<k>Repository.java", text, k=k)
    entities = n.select(F.lit("svc").alias("service_id"), _filled("m.Doc<k>", k=k).alias("entity_fqn"), _filled("docs<k>", k=k).alias("physical_name"), F.lit("ENTITY").alias("evidence_source"), F.lit(0.9).alias("confidence"))
    links = access_links.repository_links(parsed)
    rich = access_links.with_mirrors(access_links.with_repositories(entities, links), access_links.mirrors(parsed), links)
    return rich.select("entity_fqn", "evidence_source", F.col("mirrors")[0]["table_name"].alias("mirror"))


# I-21, I-22: references between schemas


@query("""WITH RECURSIVE r AS (SELECT CAST(n_nationkey AS BIGINT) AS root, CAST(n_nationkey AS BIGINT) AS cur, '' AS prefix, 0 AS d FROM nation UNION ALL SELECT root, (cur + 5) % 25, prefix || 'next.', d + 1 FROM r WHERE d < 5)
SELECT 's/n' || CAST(root AS STRING) || '.json' AS path, prefix || 'id' || CAST(cur AS STRING) AS field FROM r UNION ALL SELECT 's/n' || CAST(root AS STRING) || '.json', rtrim(prefix, '.') FROM r WHERE d > 0
UNION ALL SELECT 's/n' || CAST(root AS STRING) || '.json', prefix || 'tags' || x FROM r, (VALUES (''), ('[]'), ('[].r')) t(x) UNION ALL SELECT 'c/r.json', 'r'""")
def i22_referenced_fields(spark, sf):
    """Each nation's schema leads to that of the nation five further on, in a ring, and its tags to a common one."""
    n = base(spark, sf, "nation").select("n_nationkey", ((F.col("n_nationkey") + 5) % 25).alias("next"))
    text = """{"properties": {"id<k>": {"type": "string"}, "next": {"$ref": "./n<m>.json"}, "tags": {"type": "array", "items": {"$ref": "../c/r.json"}}}}"""
    common = spark.range(1).select(F.lit("svc").alias("service_id"), F.lit("c/r.json").alias("path"), F.lit('{"properties": {"r": {"type": "number"}}}').alias("text"))
    return extract.schema_fields(_files(n, "s/n<k>.json", text, k=F.col("n_nationkey"), m=F.col("next")).union(common))


@query("""SELECT 'n' || CAST(n_nationkey AS STRING) || '|POST|/o/{*}' AS operation_id, 'a/in' || CAST(n_regionkey AS STRING) || '.json' AS request_schema, CASE WHEN n_regionkey < 3 THEN 'a/out' || CAST(n_nationkey AS STRING) || '.json' ELSE 'err.json' END AS response_schema FROM nation""")
def i21_operation_schemas(spark, sf):
    r = F.col("n_regionkey")
    code = F.when(r < 3, "201").otherwise("3xx")
    text = """{"paths": {"/o/{id}": {"post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "./in<r>.json"}}}}, "responses": {"404": {"content": {"application/json": {"schema": {"$ref": "err.json"}}}}, "<c>": {"content": {"x/y": {"schema": {"items": {"$ref": "./out<k>.json"}}}}}}}}}}"""
    text = text.replace('"404"', '"<d>"')
    return extract.operation_schemas(_files(base(spark, sf, "nation"), "a/n<k>-spec.json", text, k=F.col("n_nationkey"), r=r, c=code, d=F.when(r < 3, "404").otherwise("200")))


# C-15, C-17: configuration


@query("""WITH RECURSIVE v AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey >= 20 THEN 'end' || CAST(n_nationkey AS STRING) END AS value FROM nation WHERE n_nationkey >= 20
UNION ALL SELECT k - 5, 'v' || CAST(k - 5 AS STRING) || '/' || value FROM v WHERE k >= 5)
SELECT 'k' || CAST(k AS STRING) AS key, value FROM v UNION ALL SELECT 'ring' || CAST(n_nationkey AS STRING), '${ring' || CAST((n_nationkey + 5) % 25 AS STRING) || '}' FROM nation
UNION ALL SELECT 'other' || CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 2 = 0 THEN 'set' || CAST(n_nationkey AS STRING) ELSE 'none' END FROM nation""")
def c17_placeholders(spark, sf):
    """In each region's settings a nation's value leads to that of the nation five further on; rings stay; defaults hold placeholders."""
    n = base(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") + 5).alias("next"), ((F.col("n_nationkey") + 5) % 25).alias("ring"))
    k, m, r = F.col("n_nationkey"), F.col("next"), F.col("ring")
    scope = (k % 5).alias("scope")
    chain = n.select(scope, _filled("k<k>", k=k).alias("key"), F.when(k >= 20, _filled("end<k>", k=k)).otherwise(_filled("v<k>/${k<m>}", k=k, m=m)).alias("value"))
    rings = n.select(scope, _filled("ring<k>", k=k), _filled("${ring<r>}", r=r))
    other = n.select(scope, _filled("other<k>", k=k), F.when(k % 2 == 0, _filled("${lost:${own<k>}}", k=k)).otherwise("${lost:none}"))
    own = n.filter(k % 2 == 0).select(scope, _filled("own<k>", k=k), _filled("set<k>", k=k))
    return config.filled(chain.union(rings).union(other).union(own), ["scope"]).filter("key NOT LIKE 'own%'").select("key", "value")


_MAP = """kind: ConfigMap
metadata:
  name: svc-<k>
data:
  application-<l>.yaml: |
    topics:
      - T<k> # first
      - "U<k>"
    url: http://h:80
  note: plain
"""


@query("""SELECT 'm' || CAST(n_nationkey AS STRING) || '.yaml#application-' || CASE WHEN n_regionkey < 2 THEN 'qa' ELSE 'pdn' END || '.yaml' AS source, unnest(['topics', 'topics[0]', 'topics[1]', 'url']) AS key,
unnest(['[T' || CAST(n_nationkey AS STRING) || ', U' || CAST(n_nationkey AS STRING) || ']', 'T' || CAST(n_nationkey AS STRING), 'U' || CAST(n_nationkey AS STRING), 'http://h:80']) AS value FROM nation""")
def c17_config_maps(spark, sf):
    lane = F.when(F.col("n_regionkey") < 2, "qa").otherwise("pdn")
    files = _files(base(spark, sf, "nation"), "m<k>.yaml", _MAP, k=F.col("n_nationkey"), l=lane)
    return config.config_entries(files).filter("source LIKE '%#%'").select("source", "key", "value")


@query("""SELECT source, env_lane FROM (SELECT 'm' || CAST(n_nationkey AS STRING) || '.yaml' AS p, CASE WHEN n_regionkey < 2 THEN 'qa' ELSE 'pdn' END AS l FROM nation) m, (VALUES (true), (false)) b(inside),
LATERAL (SELECT CASE WHEN inside THEN p || '#application-' || l || '.yaml' ELSE p END AS source, CASE WHEN inside THEN l ELSE 'unknown' END AS env_lane) x
UNION ALL SELECT CASE WHEN r_regionkey = 0 THEN 'prod/' ELSE 'x/' END || CAST(r_regionkey AS STRING) || '.yaml', CASE r_regionkey WHEN 0 THEN 'prod' WHEN 1 THEN 'qa' ELSE 'dev' END FROM region""")
def c15_profiles(spark, sf):
    lane = F.when(F.col("n_regionkey") < 2, "qa").otherwise("pdn")
    maps = _files(base(spark, sf, "nation"), "m<k>.yaml", _MAP, k=F.col("n_nationkey"), l=lane)
    r = F.col("r_regionkey")
    plain = _files(base(spark, sf, "region"), "<d>/<k>.yaml", "spring:\n  profiles:\n    active: <a>\n", k=r, d=F.when(r == 0, "prod").otherwise("x"), a=F.when(r == 1, "qa").otherwise("dev"))
    files = maps.union(plain)
    return config.lanes(files, config.config_entries(files)).select("source", "env_lane")


# B-10, I-15: batches of facts


@query("""SELECT CASE WHEN n_nationkey = 3 THEN 'even' ELSE 'odd' END AS scope_half, c_custkey AS id, 'new' AS state FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey = 3
UNION ALL SELECT 'odd', c_custkey, 'old' FROM customer WHERE c_nationkey % 2 = 1""")
def b10_committed_batches(spark, sf):
    """Two batches, one that takes the place of the first, and one written again, which changes nothing."""
    import uuid

    root = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    c = base(spark, sf, "customer")
    rows = lambda df, state: {"customers": df.select(F.col("c_custkey").alias("id"), F.lit(state).alias("state")), "nations": df.select("c_nationkey").distinct()}
    for name, half, tables in (
        ("b1", "even", rows(c.filter("c_nationkey % 2 = 0"), "old")), ("b2", "odd", rows(c.filter("c_nationkey % 2 = 1"), "old")), ("b3", "even", rows(c.filter("c_nationkey = 3"), "new")), ("b1", "even", rows(c, "again")),
    ):
        fact_batches.write_batch(spark, root, name, {"half": half}, tables)
    return fact_batches.read_table(spark, root, "customers").select("scope_half", "id", "state")


@query("""SELECT 'com.acme.n' || CAST(c_nationkey AS STRING) || '.Customer' || CAST(c_custkey AS STRING) || 'Controller' AS handler_class_fqn, unnest(['findById', 'save']) AS dao_method, 'nation' || CAST(c_nationkey AS STRING) AS table_or_entity, 'HANDLER_LINKER' AS evidence_source, 0.80::DOUBLE AS confidence FROM customer""")
def i15_indexed_accesses(spark, sf):
    """Accesses out of all facts of the services' sources."""
    text = F.replace(F.replace("text", F.lit(" repo;"), F.lit(" nationRepo;")), F.lit("repo."), F.lit("nationRepo."))
    files = fact(spark, sf, "sources").select("service_id", "path", text.alias("text"))
    got = fact_batches.index_facts(files)["data_access_facts"]
    return got.select("handler_class_fqn", "dao_method", "table_or_entity", "evidence_source", "confidence")


# F-15: scenarios of two and three participants


@query("""WITH w AS (SELECT service_id, handler_class_fqn, CAST(substring(service_id, 4) AS BIGINT) AS k, min(table_or_entity) AS a FROM f_accesses WHERE operation = 'WRITE' GROUP BY 1, 2)
SELECT service_id, 'two' AS scenario_id, handler_class_fqn, 'CO_TABLE' AS matched_by FROM w UNION ALL SELECT service_id, 'three', handler_class_fqn, 'CO_TABLE' FROM w WHERE k % 2 = 1
UNION ALL SELECT DISTINCT service_id, 'any', handler_class_fqn, 'TABLE' FROM f_accesses WHERE service_id IN (SELECT service_id FROM w)""")
def f15_several_participants(spark, sf):
    a = fact(spark, sf, "accesses")
    w = a.filter("operation = 'WRITE'").groupBy("service_id").agg(F.min("table_or_entity").alias("a"), F.max("table_or_entity").alias("b"))
    part = lambda c, role: F.struct(c.alias("physicalName"), F.lit(role).alias("role"))
    third = F.when(F.substring("service_id", 4, 9).cast("long") % 2 == 1, F.upper(F.col("a"))).otherwise(F.lit("nowhere"))
    kinds = {
        "two": ("CO_TABLE_INVARIANT", F.array(part(F.col("a"), "PRIMARY"), part(F.col("b"), "REQUIRED"), part(F.lit("unread"), "OPTIONAL"))),
        "three": ("MULTI_TABLE_DOMAIN", F.array(part(F.col("a"), "PRIMARY"), part(F.col("b"), "SECONDARY"), part(third, "REQUIRED_CHILD"))),
        "any": ("CROSS_STORE_WRITE", F.array(part(F.lit("nowhere"), "PRIMARY"), part(F.col("b"), "OPTIONAL"))),
    }
    rows = [w.select("service_id", F.lit(i).alias("scenario_id"), F.lit(p).alias("pattern"), F.lit("SERVICE").alias("scope_kind"), F.lit("").alias("scope_ref"), x.alias("participants")) for i, (p, x) in kinds.items()]
    return consistency.match_scenarios(rows[0].union(rows[1]).union(rows[2]), a).select("service_id", "scenario_id", "handler_class_fqn", "matched_by")


# I-26: dependency trees


@query("""SELECT 'svc' || CAST(c_custkey AS STRING) AS service_id, 'g:l' || CAST(rn AS STRING) AS artifact, rn % 4 AS depth, CASE WHEN rn % 4 = 0 THEN NULL WHEN rn % 4 = 1 THEN 'g:l' || CAST(rn - 1 AS STRING) ELSE 'g:l' || CAST(rn - 1 AS STRING) END AS parent
FROM customer, (SELECT unnest(range(0, 12)) AS rn)""")
def i26_dependency_trees(spark, sf):
    """Three trees of a chain of three in each text."""
    lead = ("", "+- ", "|  \\- ", "|     \\- ")
    lines = "\n".join(f"[INFO] {lead[n % 4]}g:l{n}:jar:<k>" + (":compile" if n % 4 else "") for n in range(12))
    files = _files(dealt(base(spark, sf, "customer"), "c_custkey"), "<k>/tree.txt", "[INFO] Scanning\n" + lines + "\n[INFO] BUILD SUCCESS", F.concat(F.lit("svc"), "c_custkey"), k=F.col("c_custkey"))
    t = extract.dependency_tree(files)
    return t.select("service_id", F.concat_ws(":", "group_id", "artifact_id").alias("artifact"), F.col("depth").cast("long").alias("depth"), F.regexp_replace("parent", ":[^:]*$", "").alias("parent"))


# F-07, F-09, F-12: walks from every topic at once, over names of the same topic

_RING = """WITH RECURSIVE st AS (SELECT CAST(n_nationkey AS BIGINT) AS k, (n_nationkey * 3 + 1) % 25 AS a, (n_nationkey + 7) % 25 AS b FROM nation),
e AS (SELECT k, list(DISTINCT x ORDER BY 'T' || lpad(CAST(x AS STRING), 2, '0')) AS nexts FROM (SELECT k, unnest([a, b]) AS x FROM st) WHERE x <> k GROUP BY k),
q AS (SELECT k AS start, [k] AS q, 1 AS i FROM st UNION ALL SELECT start, list_concat(q, list_filter(e.nexts, lambda x: NOT list_contains(q, x))), i + 1 FROM q JOIN e ON e.k = q[i] WHERE i <= 6 AND i <= len(q)),
w AS (SELECT start, arg_max(q, i) AS q FROM q GROUP BY start)
"""


def _ring(spark, sf):
    """Each nation's service hears the topic of its number and sends to two others, at odd ones by another name of the topic."""
    n = base(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    name = lambda k, p: F.concat(F.lit(f"PDN_{p}.T"), F.lpad(k.cast("string"), 2, "0"))
    subs = n.select(F.concat(F.lit("svc"), "k").alias("service_id"), F.lit("SUBSCRIBE").alias("role"), name(F.col("k"), "S").alias("short_id"))
    to = n.select(F.concat(F.lit("svc"), "k").alias("service_id"), F.explode(F.array((F.col("k") * 3 + 1) % 25, (F.col("k") + 7) % 25)).alias("x"))
    pubs = to.select("service_id", F.lit("PUBLISH").alias("role"), F.when(F.col("x") % 2 == 1, F.concat(F.lit("topic-"), "x")).otherwise(name(F.col("x"), "T")).alias("short_id"))
    aliases = n.select(F.concat(F.lit(" TOPIC-"), "k").alias("alias"), name(F.col("k"), "T").alias("topic"))
    rows = subs.union(pubs).withColumns({"confidence": F.lit(0.9), "attributes": F.lit("{}")})
    return rows, aliases, n.select(F.concat(F.lit("Topic-"), "k").alias("start"))


@query(_RING + "SELECT 'Topic-' || CAST(start AS STRING) AS start, 'PDN_T.T' || lpad(CAST(unnest(q[1:6]) AS STRING), 2, '0') AS topic, CAST(unnest(range(0, least(len(q), 6))) AS INT) AS hop FROM w")
def f07_all_traces(spark, sf):
    rows, aliases, starts = _ring(spark, sf)
    return messaging.trace_all(rows, starts, aliases, 6)


@query("""SELECT 'PDN_T.N' || CAST(n_nationkey AS STRING) AS topic, CAST(n_nationkey AS INT) AS hop,
CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 4 THEN 'TERMINAL_EXTERNAL' WHEN n_nationkey % 5 IN (1, 3) THEN 'NO_RUNTIME_PUBLISHER' ELSE 'NO_SUBSCRIBER' END AS gap_type FROM nation WHERE n_nationkey % 5 NOT IN (0, 3)""")
def f09_gaps_of_all_kinds(spark, sf):
    """Of five nations one has both sides, one neither, one a publisher alone, one a subscriber alone, one a topic that ends outside."""
    n = base(spark, sf, "nation")
    k = F.col("n_nationkey")
    topic = F.concat(F.lit("PDN_T.N"), k.cast("string"))
    hops = n.select(topic.alias("topic"), k.cast("int").alias("hop"))
    people = n.filter(k % 5 != 1).select(topic.alias("topic"), F.explode(F.when(k % 5 == 0, F.array(F.lit("PUBLISH"), F.lit("SUBSCRIBE"))).when(k % 5 == 3, F.array(F.lit("SUBSCRIBE"))).otherwise(F.array(F.lit("PUBLISH")))).alias("role"))
    return messaging.hop_gaps(hops, people, [f"PDN_T.N{x}" for x in (4, 9, 14, 19, 24)])


@query(_RING + """, h AS (SELECT unnest(q[1:6]) AS k, CAST(unnest(range(0, least(len(q), 6))) AS INT) AS hop FROM w WHERE start = 3),
p AS (SELECT t, string_agg('svc' || CAST(k AS STRING), ', ' ORDER BY 'svc' || CAST(k AS STRING)) AS names FROM (SELECT DISTINCT k, unnest([a, b]) AS t FROM st) GROUP BY t)
SELECT hop, 'PDN_T.T' || lpad(CAST(h.k AS STRING), 2, '0') || ' from ' || coalesce(names, 'nobody') || ' to svc' || CAST(h.k AS STRING) || CASE WHEN names IS NULL THEN '' ELSE '' END AS narrative FROM h LEFT JOIN p ON p.t = h.k""")
def f12_narratives(spark, sf):
    rows, aliases, starts = _ring(spark, sf)
    hops = messaging.trace_all(rows, starts.filter("start = 'Topic-3'"), aliases, 6).drop("start")
    people = messaging.hop_participants(hops, messaging.canonical_resources(rows, aliases))
    return messaging.flow_summary(hops, people, messaging.hop_gaps(hops, people)).select("hop", "narrative")
