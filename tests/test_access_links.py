"""Accesses of handlers: each rung of the ladder, DAO methods, queries, repositories and mirrors."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import access_links as links
from factloom.sources import extract

ENTITY = "service_id string, entity_fqn string, domain_fqn string, store_type string, physical_name string, catalog string, evidence_source string, confidence double"
ENTITIES = [
    ("s", "e.OfferEntity", "d.domain.Offer", "MARIADB", "offer_table", "main", "ENTITY_ANNOTATION", 0.9), ("s", "c.entities.Row", None, "CASSANDRA", "row_by_id", "ks", "ENTITY_ANNOTATION", 0.95),
    ("s", "m.Doc", None, "MONGODB", "docs", None, "ENTITY_ANNOTATION", 0.9), ("t", "e.OfferEntity", None, "MARIADB", "other_offer", None, "ENTITY_ANNOTATION", 0.9),
]
SOURCES = {
    "OfferDao": "package a; import d.domain.Offer; public interface OfferDao { void saveOffer(Offer o); Offer findById(String id); void touch(d.domain.Unknown u); void persistAll(java.util.List<Offer> all); }",
    "OfferDaoImpl": """package a; import d.domain.Offer; import e.OfferEntity; public class OfferDaoImpl implements OfferDao { OfferRepo offerRepo;
        public void saveOffer(Offer o) { offerRepo.save(mapDomainToEntity(o)); } public void refresh(String id) { OfferEntity x = mapDomainToEntity(load(id)); offerRepo.save(x); }
        OfferEntity mapDomainToEntity(Offer o) { return null; } }""",
    "CassandraRowRepo": """package c.repo.x; public interface CassandraRowRepo extends CassandraRepository<Row, String> {
        @Query("SELECT * FROM \\"row_by_key\\" WHERE k = ?0") Row findByKey(String k); @Query("update x set y") void setY(); void deleteAll(); Row plain(); }""",
    "DocRepository": "package m; public interface DocRepository extends MongoRepository<Doc, String> { @LogForBigQuerySync(tableName = \"bq_docs\", operation = Operation.INSERT, keyFields = {\"a\", \"b\"}) Doc save(Doc d); }",
    "Handler": """package h; import a.OfferDao; import m.DocRepository; import util.BigQueryUtil; public class Handler {
        private final OfferDao offerDao; private DocRepository docRepository; LostRepository lostRepository; BigQueryUtil bq; static final String OUT = "out_table"; // otherDao.save(x);
        Handler(OfferDao offerDao) { this.offerDao = offerDao; }
        public void onOffer(Offer o, int n) { offerDao.saveOffer(o); offerDao.findById("x"); log.info("offerDao.touch(u)"); }
        public void onDoc(Doc d) { docRepository.save(d); lostRepository.findAll(); bq.insertAll(d, x, OUT); bq.save(d, x, SIDE_TABLE); ghostRepo.find(); }
        private void again() { offerDao.touch(null); offerDao.gone(); } }""",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("s", f"src/main/java/{k}.java", v) for k, v in SOURCES.items()] + [("old", "Old.java", 'package o; @Table(name = "named") public class Old { int getX() { return 1; } public void handle() { this.itemReadOnlyRepo.findAll(); orderRepository.saveAll(x); } }')]
    return extract.light_parse(spark.createDataFrame(rows, "service_id string, path string, text string")).cache()


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, ENTITY)


def test_dao_methods(parsed, entities):
    got = {(r.accessor_fqn, r.method_name): (r.operation, r.entity_fqn, r.domain_fqn, r.physical_name, r.evidence_source, r.confidence) for r in links.dao_methods(parsed, entities).collect()}
    entity = ("e.OfferEntity", "d.domain.Offer", "offer_table", "DAO_METHOD+ENTITY", 0.93)
    assert got == {
        ("a.OfferDao", "saveOffer"): ("WRITE", *entity), ("a.OfferDao", "findById"): ("READ", None, None, None, "DAO_METHOD", 0.75),
        ("a.OfferDao", "touch"): ("READ", None, "d.domain.Unknown", None, "DAO_METHOD", 0.80), ("a.OfferDao", "persistAll"): ("WRITE", None, None, None, "DAO_METHOD", 0.75),
        ("a.OfferDao", "refresh"): ("READ", "e.OfferEntity", None, "offer_table", "DAO_METHOD+ENTITY", 0.93),
    }


def test_query_methods(parsed, entities):
    got = {(r.method_name, r.operation, r.entity_fqn, r.physical_name, r.evidence_source, r.confidence) for r in links.query_methods(parsed, entities).collect()}
    assert got == {
        ("findByKey", "READ", "c.entities.x.Row", "row_by_key", "CASSANDRA_QUERY", 0.90), ("setY", "WRITE", "c.entities.x.Row", None, "CASSANDRA_QUERY", 0.90),
        ("deleteAll", "WRITE", "c.entities.x.Row", None, "CASSANDRA_REPO", 0.88),
    }


def test_repositories_and_mirrors(parsed, entities):
    found = links.repository_links(parsed)
    assert {(r.accessor_fqn, r.entity_fqn, r.store_type) for r in found.collect()} == {("c.repo.x.CassandraRowRepo", "c.repo.x.Row", "CASSANDRA"), ("m.DocRepository", "m.Doc", "MONGODB")}
    rich = {(r.service_id, r.entity_fqn): (r.evidence_source, r.confidence, r.accessors) for r in links.with_repositories(entities, found).collect()}
    assert rich["s", "m.Doc"] == ("ENTITY_ANNOTATION+REPO_GENERIC", 0.92, ["m.DocRepository"]) and rich["s", "c.entities.Row"] == ("ENTITY_ANNOTATION", 0.95, [])
    copied = links.mirrors(parsed)
    assert [(r.accessor_fqn, r.method_name, r.table_name, r.operation, r.key_fields) for r in copied.collect()] == [("m.DocRepository", "save", "bq_docs", "INSERT", ["a", "b"])]
    attached = {(r.service_id, r.entity_fqn): (r.evidence_source, [m.table_name for m in r.mirrors or []]) for r in links.with_mirrors(entities, copied, found).collect()}
    assert attached["s", "m.Doc"] == ("ENTITY_ANNOTATION+BQ_MIRROR", ["bq_docs"]) and attached["s", "e.OfferEntity"] == ("ENTITY_ANNOTATION", [])
    by_table = copied.withColumns({"accessor_fqn": F.lit("no.Repo"), "table_name": F.lit("offer_table")})
    assert {r.entity_fqn for r in links.with_mirrors(entities, by_table, found).filter("mirrors IS NOT NULL").collect()} == {"e.OfferEntity"}


def rungs(rows):
    return {(r.handler_method, r.accessor_fqn, r.dao_method): (r.operation, r.table_or_entity, r.evidence_source, r.confidence) for r in rows}


def test_ladder_of_handlers(spark, parsed, entities):
    methods = links.accessor_methods(parsed, entities)
    none = spark.createDataFrame([], "service_id string")
    got = rungs(links.handler_accesses(parsed.filter("type_name = 'Handler'"), methods, entities.filter("service_id = 's'"), none).collect())
    free = {
        ("onOffer", "a.OfferDao", "saveOffer"): ("WRITE", "offer_table", "HANDLER_LINKER+CATALOG", 0.93), ("onOffer", "a.OfferDao", "findById"): ("READ", "offer", "HANDLER_LINKER+CATALOG", 0.80),
        ("again", "a.OfferDao", "touch"): ("READ", "offer", "HANDLER_LINKER+CATALOG", 0.80), ("again", "a.OfferDao", "gone"): ("READ", "offer", "HANDLER_LINKER", 0.80),
        ("onDoc", "m.DocRepository", "save"): ("WRITE", "doc", "HANDLER_LINKER", 0.80), ("onDoc", "h.LostRepository", "findAll"): ("READ", "lost", "HANDLER_LINKER", 0.80),
    }
    assert got == free
    pinned = rungs(links.handler_accesses(parsed.filter("type_name = 'Handler'"), methods, entities.filter("service_id = 's'"), spark.createDataFrame([("s",), ("s",)], "service_id string")).collect())
    assert pinned == {k: v if v[3] == 0.93 else (*v[:2], "HANDLER_WITHOUT_CATALOG", 0.75) for k, v in free.items()}


def test_mongo_and_bigquery(spark, parsed, entities):
    rows = [("s", "G.java", "package g; import org.x.MongoTemplate; class G { MongoTemplate mongoTemplate; mongo.UserRepository userRepository; public void go() { mongoTemplate.findOne(q); userRepository.save(u); userRepository.count(); } }")]
    p = extract.light_parse(spark.createDataFrame(rows, "service_id string, path string, text string"))
    methods = spark.createDataFrame([("mongo.UserRepository", "save", "WRITE", "m.Doc", None, "MONGODB", None)], "accessor_fqn string, method_name string, operation string, entity_fqn string, domain_fqn string, store_type string, physical_name string")
    got = rungs(links.mongo_accesses(p, methods, entities).collect())
    assert got == {("go", "org.x.MongoTemplate", "findOne"): ("READ", "mongo_template", "MONGO_ACCESS", 0.78), ("go", "mongo.UserRepository", "save"): ("WRITE", "docs", "MONGO_ACCESS+CATALOG", 0.90)}
    big = {(r.handler_method, r.dao_method, r.table_or_entity, r.confidence) for r in links.bigquery_accesses(parsed).collect()}
    assert big == {("onDoc", "insertAll", "out_table", 0.82), ("onDoc", "save", "side", 0.82)}


def test_last_resort_only_where_nothing_else_is_found(spark, parsed, entities):
    methods = links.accessor_methods(parsed, entities)
    rows = links.all_accesses(parsed, methods, entities, spark.createDataFrame([], "service_id string")).collect()
    assert {r.evidence_source for r in rows if r.service_id == "s"} == {"HANDLER_LINKER+CATALOG", "HANDLER_LINKER", "BIGQUERY_DIRECT"}
    old = {(r.handler_method, r.field, r.dao_method, r.operation, r.table_or_entity, r.evidence_source, r.confidence) for r in rows if r.service_id == "old"}
    assert old == {("handle", "itemReadOnlyRepo", "findAll", "READ", "named", "JAVA_AST", 0.85), ("handle", "orderRepository", "saveAll", "WRITE", "named", "JAVA_AST", 0.85)}


def test_calls_of_one_service_meet_its_pins_in_shares(spark):
    import re

    text = "package h; import a.PartDao; public class H { PartDao partDao; public void on(int a, int b) { partDao.save(a); } }"
    parsed = extract.light_parse(spark.createDataFrame([("svc", "H.java", text), ("other", "H.java", text)], "service_id string, path string, text string"))
    methods = spark.createDataFrame([], "service_id string, accessor_fqn string, method_name string, operation string, entity_fqn string, domain_fqn string, store_type string, physical_name string")
    entities = spark.createDataFrame([], "service_id string, entity_fqn string, domain_fqn string, store_type string, physical_name string, catalog string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = links.handler_accesses(parsed, methods, entities, spark.createDataFrame([("svc",), ("svc",)], "service_id string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = sorted((r.service_id, r.evidence_source) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == [("other", "HANDLER_LINKER"), ("svc", "HANDLER_WITHOUT_CATALOG")]
    assert re.search(r"hashpartitioning\(service_id#\d+, share#\d+", plan) and "SortMergeJoin [service_id#" in plan
