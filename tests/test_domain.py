"""Domain operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import analysis, catalog, consistency, contracts, entry_flow, messaging, relational
from factloom.sources import extract, files
from factloom.streaming import jobs

NOW = dt.datetime(2024, 1, 1, 12, 0)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def test_column_functions(spark):
    v = lambda c: value(spark, c)
    lit = F.lit
    assert v(T.simple_name(lit("a.b.C"))) == "C" and v(T.class_part(lit("a.C#m"))) == "a.C"
    assert v(T.is_test_of(lit("OrderIT"), lit("Order"))) and v(T.is_test_of(lit("TestOrderX"), lit("Order"))) and not v(T.is_test_of(lit("OrderX"), lit("Order")))
    assert v(T.normalize_path(lit("/offers/{offerId}//detail/"))) == "/offers/{*}/detail"
    assert v(T.normalize_inbound_path(lit("  "))) == "" and v(T.normalize_inbound_path(lit("a"))) == "/a"
    assert v(T.glob_match(lit("PDN_T.AB"), "PDN_?.A*")) and not v(T.glob_match(lit("PDN_T.AB"), "PDN_T.A"))
    assert v(T.parse_handler(lit("a.b.C.run"))).asDict() == {"class_fqn": "a.b.C", "method": "run"}
    assert v(T.env_lane(lit("src/main/resources/application-qa.yml"))) == "qa" and v(T.env_lane(lit("x/pdn/a.yaml"))) == "pdn" and v(T.env_lane(lit("x"))) == "unknown"
    assert v(T.camel_to_snake(lit("OfferPidMap"))) == "offer_pid_map" and v(T.retry_delay_ms(lit(2), 30000)) == 60000
    assert v(T.append_evidence(lit("A+B"), "A")) == "A+B" and v(T.append_evidence(lit(None).cast("string"), "A")) == "A"
    assert v(T.json_strings(lit('["a","b"]'))) == ["a", "b"] and v(T.json_strings(lit("x"))) == []
    assert v(T.gate_state(lit("true"), lit("TRUE"))) == "OPEN" and v(T.gate_state(lit("x"), lit(None).cast("string"))) == "UNKNOWN"
    assert v(T.accessor_entity(lit("a.OfferRepository"))) == "Offer" and v(T.accessor_entity(lit("a.Offer"))) is None


@pytest.mark.parametrize(("status", "minutes", "want"), [(None, 0, "NOT_INDEXED"), ("RUNNING", 0, "INDEXING"), ("COMPLETE", 10, "CURRENT"), ("COMPLETE", 90, "STALE"), ("COMPLETE", 60, "STALE"), ("FAILED", 10, "NOT_INDEXED")])
def test_freshness(spark, status, minutes, want):
    runs = spark.createDataFrame([("s", "j", status, NOW, NOW - dt.timedelta(minutes=minutes))] if status else [], "service_id string, job_id string, status string, enqueued_at timestamp, completed_at timestamp")
    assert analysis.freshness(spark.createDataFrame([("s",)], "service_id string"), runs, NOW).head().freshness == want


def test_untested_classes(spark):
    classes = spark.createDataFrame([("s", f"a.{c}") for c in ("A", "B", "C", "D", "E")], "service_id string, symbol_fqn string")
    tests = spark.createDataFrame([("s", "t.ATest"), ("s", "t.BTests"), ("s", "t.CIT"), ("s", "t.TestDx"), ("other", "t.ETest")], "service_id string, symbol_fqn string")
    assert [r.symbol_fqn for r in analysis.untested_classes(classes, tests).collect()] == ["a.E"]


def test_reconcile(spark):
    c = spark.createDataFrame([("o1", "POST", "/offers/redeem"), ("o2", "GET", "/offers/{offerId}")], "operation_id string, http_method string, path_template string")
    t = spark.createDataFrame([("t1", "REST_INBOUND", "POST", "/offers/redeem"), ("t2", "REST_INBOUND", "POST", "internal/health"), ("t3", "CRON_K8S", "POST", "/x")], "trigger_id string, trigger_kind string, http_method string, path_pattern string")
    assert {tuple(r) for r in contracts.reconcile(c, t).collect()} == {("CONTRACT_ONLY", "GET|/offers/{*}", "o2"), ("IMPLEMENTATION_ONLY", "POST|/internal/health", "t2")}


def test_scenarios_need_all_tables_written(spark):
    part = "storeType:string,physicalName:string,role:string,via:string,lagClass:string"
    s = spark.createDataFrame([("s", "x", "CO_TABLE_INVARIANT", "TABLE", None, [("M", "Offer", "PRIMARY", None, None), ("M", "OfferPidMap", "REQUIRED_CHILD", None, None)])], f"service_id string, scenario_id string, pattern string, scope_kind string, scope_ref string, participants array<struct<{part}>>")
    access = lambda *rows: spark.createDataFrame([("s", "H", op, t) for op, t in rows], "service_id string, handler_class_fqn string, operation string, table_or_entity string")
    assert consistency.match_scenarios(s, access(("READ", "Offer"), ("READ", "OfferPidMap"))).count() == 0
    assert consistency.match_scenarios(s, access(("WRITE", "offer"), ("WRITE", "OfferPidMapEntity"))).head().matched_by == "CO_TABLE"
    assert consistency.match_scenarios(s, access(("WRITE", "Offer"))).count() == 0


def test_hint_overlay(spark):
    h = spark.createDataFrame([("1", "i", "P", ["a", "b"], False), ("1", "c", "P", ["b", "a"], True), ("1", "sub", "P", ["a"], True), ("2", "i", "P", ["a", "b"], False)], "step string, scenario_id string, pattern string, participants array<string>, curated boolean")
    assert {(r.step, r.scenario_id) for r in consistency.overlay_hints(h).collect()} == {("1", "c"), ("2", "i")}


def test_topic_walk_and_gaps(spark):
    rows = [("o", "a", "r", "TOPIC", "P_T.X", "PUBLISH", "k", "{}", 0.9), ("o", "b", "r", "SUBSCRIPTION", "P_S.X", "SUBSCRIBE", "k", "{}", 0.9), ("o", "b", "r", "TOPIC", "P_T.Z", "PUBLISH", "k", "{}", 0.9), ("o", "b", "r", "TOPIC", "P_T.Y", "PUBLISH", "k", "{}", 0.9)]
    r = spark.createDataFrame(rows, "org_id string, service_id string, repo string, resource_kind string, short_id string, role string, linked_class_fqn string, attributes string, confidence double")
    hops = messaging.trace_topics(r, "P_T.X")
    assert [tuple(x) for x in hops.orderBy("hop").collect()] == [("P_T.X", 0), ("P_T.Y", 1), ("P_T.Z", 2)]
    people = messaging.hop_participants(hops, r)
    assert {tuple(x) for x in messaging.hop_gaps(hops, people, ["P_T.Z"]).collect()} == {("P_T.Y", 1, "NO_SUBSCRIBER"), ("P_T.Z", 2, "TERMINAL_EXTERNAL")}
    assert messaging.trace_topics(r, "P_T.X", 2).count() == 2
    assert {x.drift_status for x in messaging.drift(r).collect()} == {"LINKED_OK"}
    assert messaging.follow_mode("causal") == ("runtime", "causal is not available; runtime is used")


def test_handlers_fall_back_to_simple_names(spark):
    t = spark.createDataFrame([("t1", "s", "pdn", "a.C#m", "{}"), ("t2", "s", "pdn", "z.D#n", '{"interfaceFqn": "a.I"}')], "trigger_id string, service_id string, env_lane string, linked_handler_fqn string, attributes string")
    h = spark.createDataFrame([("h1", "a.C", "m"), ("h2", "b.D", None), ("h3", "a.I", None)], "handler string, class_fqn string, method string")
    assert {(r.handler, r.trigger_id, r.match_kind) for r in entry_flow.impact_by_handler(t, h).collect()} == {("h1", "t1", "METHOD"), ("h2", "t2", "SIMPLE_NAME"), ("h3", "t2", "EXACT")}


def test_links_and_modules(spark):
    d = spark.createDataFrame([(1, "s", "com.q", "lib", "1"), (2, "s", "com.q", "own", "1"), (3, "s", "com.z", "none", "1")], "dependency_id int, service_id string, to_group string, to_artifact string, to_version string")
    i = spark.createDataFrame([("REGISTRY", "com.q:lib", "libs"), ("GAV", "lib", "other"), ("GAV", "own", "s")], "source string, artifact_key string, linked_service_id string")
    got = {r.dependency_id: (r.linked_service_id, r.link_confidence) for r in catalog.link_artifacts(d, i).collect()}
    assert got == {1: ("libs", 0.90), 2: (None, None), 3: (None, None)}
    m = spark.createDataFrame([("a", "pom", "x"), ("a/b", "war", "y"), ("a/c", "jar", "z")], "module_path string, packaging string, artifact_id string")
    assert catalog.find_module(m).head().module_path == "a/c" and catalog.find_module(m, "y").head().module_path == "a/b"
    assert {(r.module_path, r.depth) for r in catalog.module_tree(m, m.filter("module_path = 'a'")).collect()} == {("a", 0), ("a/b", 1), ("a/c", 1)}


def test_pages(spark):
    p = relational.page(spark.range(120), [F.asc("id")], 50, 50)
    assert [r.id for r in p.items.collect()] == list(range(50, 100)) and p.has_more
    with pytest.raises(ValueError):
        relational.page(spark.range(1), [F.asc("id")], 500)


JAVA = '''package com.example;
import org.springframework.kafka.core.KafkaTemplate;
@RestController
@RequestMapping("/orders")
public class OrderController implements OrderApi {
  private final OrderRepository repo;
  @GetMapping("/{id}")
  public Order getOne(String id, String x) { return repo.findById(id); }
  @PostMapping
  public Order create(Order o) { if (!enabled) { return null; } client.get().uri("/stock/{id}"); return repo.save(o); }
  static final String PATH = "/orders";
  @Scheduled(cron = "0 0 * * *") public void tick() { kafkaTemplate.send("T.A", o); }
}
'''  # noqa: Q001


def test_extractors(spark):
    f = spark.createDataFrame([("s", "src/main/java/OrderController.java", JAVA), ("s", "x.java", "nothing")], "service_id string, path string, text string")
    p = extract.light_parse(f).cache()
    assert p.head().class_fqn == "com.example.OrderController"
    assert {(r.http_method, r.path) for r in extract.endpoints(p).collect()} == {("GET", "/orders/{*}"), ("POST", "/orders")}
    assert {r.interface for r in extract.implemented(p).collect()} == {"OrderApi"}
    assert {(r.type, r.name) for r in extract.injected(p).collect()} == {("OrderRepository", "repo")}
    assert {(r.dao_method, r.operation) for r in extract.data_accesses(p).collect()} == {("findById", "READ"), ("save", "WRITE")}
    assert {(r.http_method, r.path_text) for r in extract.outbound_calls(p).collect()} == {("GET", "/stock/{id}")}
    # annotations and types tell of peripherals; an import alone doesn't
    assert extract.peripherals(f).count() == 0
    used = f.withColumn("text", F.concat("text", F.lit("class L { @KafkaListener(topics = x) void on() {} StringRedisTemplate r; }")))
    assert {r.peripheral_type for r in extract.peripherals(used).collect()} == {"kafka", "redis"}
    assert {r.reason_code for r in extract.unsupported(f).collect()} == {"PARSE_ERROR"}
    assert {r.gate_key for r in extract.flow_gates(p).collect()} == {"enabled"}
    assert {(r.constant, r.value) for r in extract.constants(p).collect()} == {("OrderController#PATH", "/orders")}
    assert {r.topic for r in extract.publishes(p).collect()} == {"T.A"}
    assert {"REST_INBOUND", "CRON_SPRING"} <= {r.trigger_kind for r in extract.triggers(p).collect()}
    assert {"CLASS", "METHOD", "ENDPOINT"} == {r.symbol_kind for r in extract.symbol_facts(p).collect()}


def test_other_texts(spark):
    texts = {
        "application-qa.yml": "kafka:\n  topics:\n    order:\n      topic-name: ORDERS # main\n  other: 1\npubsub:\n  subscription: projects/p/subscriptions/S1\n",
        "a.proto": "message Offer { string id = 1; int32 n = 2; }\nenum Kind { A = 0; }",
        "t.sql": "USE shop; CREATE TABLE IF NOT EXISTS offer (id INT); create table x.`pid_map` (id INT);",
        "offers-spec.json": '{"paths": {"/offers/{id}": {"get": {"operationId": "one"}, "post": {}}}}',
        "schema.json": '{"properties": {"offerIds": {"type": "array", "items": {"properties": {"n": {}}}}, "address": {"properties": {"city": {}, "zip": {}}}}}',
        "pom.xml": "<project><parent><groupId>com.q</groupId><version>1</version></parent><artifactId>demo</artifactId><dependencies><dependency><groupId>com.q</groupId><artifactId>lib</artifactId><version>${v}</version></dependency></dependencies></project>",
    }
    f = spark.createDataFrame([("s", k, v) for k, v in texts.items()], "service_id string, path string, text string")
    of = lambda *names: f.filter(F.col("path").isin(*names))
    entries = extract.yaml_entries(of("application-qa.yml"))
    assert {(r.key, r.value) for r in entries.collect()} == {("kafka.topics.order.topic-name", "ORDERS"), ("kafka.other", "1"), ("pubsub.subscription", "projects/p/subscriptions/S1")}
    assert {(r.short_id, r.resource_kind, r.confidence) for r in extract.yaml_topics(entries).collect()} >= {("S1", "SUBSCRIPTION", 1.0), ("ORDERS", "TOPIC", 0.85)}
    assert {(r.kind, r.name, tuple(r.fields)) for r in extract.proto_schemas(f).collect()} == {("message", "Offer", ("id", "n")), ("enum", "Kind", ("A",))}
    assert {(r.catalog, r.physical_name) for r in extract.ddl_tables(f).collect()} == {("shop", "offer"), ("x", "pid_map")}
    assert {(r.operation_id, r.http_method) for r in extract.openapi_operations(of("offers-spec.json")).collect()} == {("offers|GET|/offers/{*}", "GET"), ("offers|POST|/offers/{*}", "POST")}
    assert {r.field for r in extract.schema_fields(of("schema.json")).collect()} == {"offerIds", "offerIds[]", "offerIds[].n", "address", "address.city", "address.zip"}
    assert extract.pom_modules(f).head().asDict() == {"service_id": "s", "module_path": "", "group_id": "com.q", "artifact_id": "demo", "version": "1", "packaging": "jar"}
    assert extract.pom_dependencies(f).head().unresolved_reason == "PROPERTY"


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_bytes("café".encode("cp1252"))
    (tmp_path / "pom.xml").write_text("<project/>")
    got = files.read_tree(spark, str(tmp_path))
    assert {(r.path, r.text) for r in got.collect()} == {("src/A.java", "café"), ("pom.xml", "<project/>")}
    assert files.build_tool(got).head().build_tool == "MAVEN" and files.under_roots(got, ["src"]).count() == 1
    assert files.signature_ok(b"x", None, "k") is False


def test_webhooks_to_jobs(spark):
    body = '{"ref": "refs/heads/main", "after": "abc", "repository": {"full_name": "r"}, "commits": [{"added": ["svc/a/X.java"], "modified": ["svc/b/Y.java", "README"]}]}'
    events = files.webhook_jobs(spark.createDataFrame([("push", body), ("push", '{"ref": "refs/tags/1"}'), ("pull_request", '{"action": "closed"}')], "event string, body string"))
    assert events.count() == 1
    services = spark.createDataFrame([("r", "a", 0, ["svc/a"]), ("r", "all", 1, ["svc"])], "repo string, service_id string, position int, source_roots array<string>")
    got = jobs.decompose(events.withColumn("event_id", F.lit(1)), services)
    assert {(r.service_id, tuple(r.files)) for r in got.collect()} == {("a", ("svc/a/X.java",)), ("all", ("svc/b/Y.java",))}


def test_streamed_jobs_are_handled_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"job_id": "1", "attempt": 1}\n{"job_id": "1", "attempt": 1}\n{"job_id": "2", "attempt": 1}\n')
    seen = []
    for _ in range(2):
        stream = jobs.file_jobs(spark, str(tmp_path / "in"))
        q = jobs.run_stream(stream, lambda df: seen.extend(r.job_id for r in df.collect()), str(tmp_path / "done"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        (tmp_path / "in" / "2.json").write_text('{"job_id": "2", "attempt": 1}\n{"job_id": "2", "attempt": 2}\n')
    assert sorted(seen) == ["1", "2", "2"]


def test_run_states(spark):
    e = spark.createDataFrame([("j", "s", "RUNNING", 1, NOW), ("j", "s", "QUEUED", 1, NOW), ("j", "s", "FAILED", 1, NOW), ("j", "s", "QUEUED", 2, NOW), ("k", "s", "COMPLETE", 1, NOW)], jobs.RUN_EVENT)
    assert {(r.job_id, r.status, r.attempt) for r in jobs.fold_runs(e).collect()} == {("j", "QUEUED", 2), ("k", "COMPLETE", 1)}
    failed = spark.createDataFrame([("a", 1), ("b", 3)], "job_id string, attempt int")
    again, dead = jobs.after_failure(failed, F.lit(NOW))
    assert again.head().next_retry_at == NOW + dt.timedelta(seconds=60) and dead.head().job_id == "b"


def test_interface_names_keep_their_digits(spark):
    parsed = extract.light_parse(spark.createDataFrame([("s", "A.java", "package a; public class A implements Api10, b.Other1<X0> { }")], "service_id string, path string, text string"))
    assert {r.interface for r in extract.implemented(parsed).collect()} == {"Api10", "b.Other1"}


def test_rules_are_one_expression_of_bounded_size(spark):
    steps = spark.createDataFrame([("s", "a.OrderHandler"), ("s", "a.Other")], "service_id string, handler_class_fqn string")
    none = spark.createDataFrame([], "service_id string, handler_class_fqn string, scenario_id string")
    rules = spark.createDataFrame([("Order", "pay"), ("Handler", "ship")], "class_contains string, flow_step string")
    got = {r.handler_class_fqn: r.flow_steps for r in consistency.enrich_hints(steps, rules, none, none.drop("handler_class_fqn")).collect()}
    assert got == {"a.OrderHandler": ["pay", "ship"], "a.Other": []}
    assert consistency.enrich_hints(steps, rules.limit(0), none, none.drop("handler_class_fqn")).count() == 2
    many = spark.range(consistency.MOST_RULES + 1).select(F.col("id").cast("string").alias("class_contains"), F.lit("x").alias("flow_step"))
    with pytest.raises(ValueError):
        consistency.enrich_hints(steps, many, none, none.drop("handler_class_fqn"))


def test_events_are_decomposed_by_all_tasks(spark):
    """Events are dealt to four tasks a core before each becomes many rows."""
    events = spark.range(500).select(F.col("id").alias("event_id"), F.lit("r").alias("repo"), F.array(F.lit("a/x.java"), F.lit("b/y.java"), F.lit("no.java")).alias("changed_files"))
    services = spark.createDataFrame([("r", "a", 0, ["a/"]), ("r", "all", 1, ["a", "b"])], "repo string, service_id string, position int, source_roots array<string>")
    got = jobs.decompose(events, services)
    assert sorted((r.event_id, r.service_id, tuple(r.files)) for r in got.collect()) == sorted(x for i in range(500) for x in ((i, "a", ("a/x.java",)), (i, "all", ("b/y.java",))))
    assert "RepartitionByExpression [event_id" in got._jdf.queryExecution().analyzed().toString()
