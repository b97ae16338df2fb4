"""Declarations read from Java sources: what stands in comments and strings is none, and nested types have members of their own."""

import pytest
from pyspark.sql import functions as F

from factloom.sources import code, extract

SHOP = '''/* @RestController class Not { } */
package com.shop; // package com.other;
import com.shop.api.OrderApi;
import static java.util.Map.entry;

/** Serves orders.
 *  And more.
 * @since 1 */
@RestController @RequestMapping(value = Paths.ROOT + "/orders", produces = {"a/b", "c"})
@lombok.RequiredArgsConstructor
public class OrderController extends Base<Map<String, List<Order>>> implements OrderApi, com.x.Audited<Order> {
    public static final String SUB = "/sub", NOTE = "@GetMapping(\\"/in-a-string\\") { // no comment";
    private final OrderService service;
    private final Map<String, List<Order>> byName = new HashMap<>();
    private AuditHelper notFinal;
    @Autowired @Qualifier("fast") private StockClient stock, spare;
    // @Autowired private Hidden hidden;
    private RestTemplate rest;
    char quote = '"'; String block = """
        @DeleteMapping("/in-a-block") { "quoted"
        """;

    static { log.info("}"); }

    @GetMapping("/{id}") // @PostMapping("/commented")
    public <T extends Order> T one(@PathVariable("id") String id, int n) throws IOException, java.sql.SQLException {
        if (a < b && c > d) { stock.reserve(id, x -> helper(x)); }
        /* service.hidden(); */
        log.warn("service.inString()");
        rest.getForEntity("/stock/" + id, String.class);
        return client.post().uri("/orders").retrieve();
    }

    @RequestMapping(path = SUB, method = {RequestMethod.PUT, RequestMethod.PATCH}) public void many(List<Order> all, boolean x) { this.service.saveAll(all); this.many(all, x); }
    @DeleteMapping({"/a", "/b"}) public void gone(String id, int n) { new Thread(() -> service.drop(id)).start(); }
    public String getName() { return service.name(); }
    void quiet() { service.quiet(); }

    static class Inner { @GetMapping("/inner") public void inner(int a, int b) { service.fromInner(); } }
    enum Kind { ONE, TWO(2) { int size() { return 2; } }, THREE; Kind(int... n) { } }
    record Pair(String left, @Nullable int right) { }
}
class Second { @Autowired SecondDep dep; @GetMapping("/second") public void second(int a, int b) { } }
'''
KOTLIN = "package com.k\n\n// class No\nclass Ktor(val a: B) : Base() {\n  fun x() = \"${'$'}{\"\n}\n"
FILES = [("s", "src/main/java/OrderController.java", SHOP), ("s", "Ktor.kt", KOTLIN), ("s", "Broken.java", "class Broken { void f() { }"), ("s", "empty.java", None), ("s", "notes.java", "// class A { }"),
         ("s", "Paths.java", 'package com.shop; class Paths { static final String ROOT = "/api"; }')]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "service_id string, path string, text string").withColumns({"code": F.lit("mine"), "problem": F.lit("x")})


@pytest.fixture(scope="module")
def parsed(files):
    return extract.light_parse(files).cache()


def of(parsed, name="OrderController"):
    return parsed.filter(F.col("type_name") == name)


def test_types_and_their_kinds(parsed, files):
    got = {(r.class_fqn, r.type_kind, r.package) for r in parsed.select("class_fqn", "type_kind", "package").collect()}
    assert got == {("com.shop.OrderController", "class", "com.shop"), ("com.k.Ktor", "class", "com.k"), ("com.shop.Paths", "class", "com.shop")}
    types = {t.fqn: t for t in of(parsed).head().types}
    assert set(types) == {f"com.shop.{x}" for x in ("OrderController", "Second", "OrderController.Inner", "OrderController.Kind", "OrderController.Pair")}
    main = types["com.shop.OrderController"]
    assert main.is_primary and main.doc == "Serves orders.\nAnd more." and main.modifiers == ["public"] and main.extended == ["Base<Map<String,List<Order>>>"]
    assert [a.name for a in main.annotations] == ["RestController", "RequestMapping", "RequiredArgsConstructor"]
    assert types["com.shop.OrderController.Kind"].constants == ["ONE", "TWO", "THREE"]
    assert {r.path for r in extract.unsupported(files).collect()} == {"Broken.java", "empty.java", "notes.java"}


def test_members(parsed):
    members = of(parsed).head().members
    by = {(m.owner.split(".")[-1], m.kind, m.name): m for m in members}
    one = by["OrderController", "METHOD", "one"]
    assert (one.type, [(p.type, p.name) for p in one.params], one.thrown) == ("T", [("String", "id"), ("int", "n")], ["IOException", "java.sql.SQLException"])
    assert [a.name for a in one.annotations] == ["GetMapping"] and [a.name for a in one.params[0].annotations] == ["PathVariable"]
    assert [(c.scope, c.chained, c.name) for c in one.calls] == [
        ("stock", None, "reserve"), (None, None, "helper"), ("log", None, "warn"), ("rest", None, "getForEntity"), ("client", None, "post"), (None, "post", "uri"), (None, "uri", "retrieve"),
    ]
    assert by["OrderController", "FIELD", "SUB"].initial == '"/sub"' and ("OrderController", "FIELD", "hidden") not in by
    assert by["Pair", "CONSTRUCTOR", "Pair"].params[1].name == "right" and by["Kind", "CONSTRUCTOR", "Kind"].params[0].type == "int..."
    assert {m.owner for m in members if m.is_primary} == {"com.shop.OrderController"}


def test_endpoints_of_code_alone(parsed):
    known = extract.constants(parsed)
    got = {(r.http_method, r.path) for r in extract.endpoints(of(parsed), known).collect()}
    assert got == {("GET", "/api/orders/{*}"), ("PUT", "/api/orders/sub"), ("PATCH", "/api/orders/sub"), ("DELETE", "/api/orders/a"), ("DELETE", "/api/orders/b")}
    assert {r.path for r in extract.endpoints(of(parsed)).collect()} >= {"/Paths.ROOT+/orders/{*}"}


def test_injections(parsed):
    got = {(r.type, r.name, r.bean_name, r.injection) for r in extract.injections(of(parsed)).collect()}
    assert got == {
        ("StockClient", "stock", "fast", "Autowired"), ("StockClient", "spare", "fast", "Autowired"),
        ("OrderService", "service", None, "LOMBOK_CONSTRUCTOR"), ("Map<String,List<Order>>", "byName", None, "LOMBOK_CONSTRUCTOR"),
    }


@pytest.mark.parametrize(("body", "want"), [
    ("@AllArgsConstructor class A { private final B b; private C c; static D d; }", {("B", "b", "LOMBOK_CONSTRUCTOR"), ("C", "c", "LOMBOK_CONSTRUCTOR")}),
    ("class A { A(@Qualifier(\"q\") B b, List<C> cs) { } private final B b; }", {("B", "b", "CONSTRUCTOR"), ("List", "cs", "CONSTRUCTOR")}),
    ("class A { private KafkaTemplate<String, X> t; @Resource(name = \"r\") R r; @Inject I i; }", {("KafkaTemplate", "t", "FIELD"), ("R", "r", "Resource"), ("I", "i", "Inject")}),
    ("class A { private final B b; private final C c = new C(); private D d; }", {("B", "b", "FINAL_FIELD")}),
])
def test_kinds_of_injection(spark, body, want):
    p = extract.light_parse(spark.createDataFrame([("s", "A.java", body)], "service_id string, path string, text string"))
    got = extract.injections(p).collect()
    assert {(r.type.split("<")[0], r.name, r.injection) for r in got} == want
    assert {(r.type, r.name) for r in extract.injected(p).collect()} == {x[:2] for x in want}
    assert {r.bean_name for r in got} - {None} == ({"q"} if "Qualifier" in body else {"r"} if "Resource" in body else set())


def test_call_graph(parsed):
    got = {(r.method, r.callee_type, r.callee, r.variable) for r in extract.call_graph(of(parsed)).collect()}
    own = "com.shop.OrderController"
    assert got == {
        ("one", "StockClient", "reserve", "stock"), ("one", own, "helper", None), ("many", own, "saveAll", "service"), ("gone", "OrderService", "drop", "service"),
    }


def test_client_calls(parsed):
    got = {(r.client, r.http_method, r.path_text, r.source_symbol) for r in extract.client_calls(of(parsed)).collect()}
    assert got == {("RestTemplate", "GET", "/stock/+id", "OrderController#one"), ("RestClient", "POST", "/orders", "OrderController#one"), ("RestTemplate", None, None, "OrderController")}


def test_feign_and_rest_services(spark):
    rows = [("s", "F.java", 'package f; @FeignClient(name = "x") interface F { @GetMapping("/p/{id}") P one(@PathVariable String id, int n); }'),
            ("s", "R.java", 'package r; @ConfigurationProperties("pay.client") class R extends RestService<P> { P call(int a, int b) { return callWithRetry(x); } }'),
            ("s", "X.java", 'package x; class X { void m() { rest.exchange("/u", HttpMethod.PUT, e); WebClient.create().exchange(u, HttpMethod.GET); } }')]
    p = extract.light_parse(spark.createDataFrame(rows, "service_id string, path string, text string"))
    got = {(r.client, r.http_method, r.path_text, r.source_symbol) for r in extract.client_calls(p).collect()}
    assert got == {("FeignClient", "GET", "/p/{id}", "f.F#one"), ("RestService", "POST", "pay.client", "R"), ("RestTemplate", "PUT", None, "X#m"), ("RestTemplate", "GET", None, "X#m")}


def test_list_injected_routes(spark):
    rows = [
        ("s", "Factory.java", "package f; class Factory { Map<String, Adapter> m; Factory(List<Adapter> all) { m = all.stream().collect(Collectors.toMap(Adapter::getAdapterName, a -> a)); } public Adapter pick(String k, int n) { return m.get(k); } }"),
        ("s", "A.java", 'package a; class A implements Adapter { static final String ADAPTER_NAME = "first"; public String getAdapterName() { return A.ADAPTER_NAME; } }'),
        ("s", "B.java", "package b; class B implements x.Adapter { }"), ("s", "C.java", "package c; abstract class C implements Adapter { }"), ("t", "D.java", "package d; class D implements Adapter { }"),
        ("s", "E.java", "package e; class E { /* implements Adapter */ }"),
    ]
    p = extract.light_parse(spark.createDataFrame(rows, "service_id string, path string, text string"))
    got = {(r.factory_class_fqn, r.selector, r.routing_key, r.implementor_fqn) for r in extract.list_routes(p).collect()}
    assert got == {("f.Factory", "pick", "first", "a.A"), ("f.Factory", "pick", "B", "b.B")}


def test_peripherals_of_declarations(spark):
    rows = [("s", "A.java", "// @KafkaListener\nclass A { String s = \"MongoTemplate oracle\"; }"), ("s", "B.java", "class B { B(OracleDataSource d, ReactiveRedisTemplate<A, B> r) { } }"), ("s", "C.java", "@Entity class C { AmazonS3 s3; AmazonS3Client no; }")]
    got = {(r.path, r.peripheral_type) for r in extract.peripherals(spark.createDataFrame(rows, "service_id string, path string, text string")).collect()}
    assert got == {("B.java", "oracle"), ("B.java", "redis"), ("C.java", "s3")}


def test_comments_go_and_strings_stay():
    text = 'a /* b */ "c // d" // e\n\'"\' /* f\ng */ """h /* i """ j'
    assert code.uncommented(text) == 'a   "c // d"  \n\'"\'  \n """h /* i """ j'


@pytest.mark.parametrize("text", ["class A { List<" * 3000, "class A { void f() { " + "if (a) { g(); " * 5000, "class A {" * 3000, "@X(" * 3000, '"' * 9999, "class A { " + "int a = b < c, " * 3000, "}" * 5000, "enum E { A(" * 1000])
def test_broken_sources_end_soon(text):
    import time

    began = time.time()
    assert code.Reader(text).problem
    assert time.time() - began < 10


def test_files_made_from_one_row_group_are_read_by_many_tasks_and_once(spark):
    from factloom.plans.adapters import fact
    from factloom.plans.source_queries import _catalog, _commented

    sf = "/root/testdata/sf0.001"
    assert fact(spark, sf, "sources").rdd.getNumPartitions() >= 16
    for parsed in (_commented(spark, sf), _catalog(spark, sf)[0], extract.light_parse(fact(spark, sf, "sources"))):
        assert "MapInArrow" not in parsed._jdf.queryExecution().toString()
        assert len(parsed.inputFiles()) >= 8


def test_few_files_are_held_at_once(spark):
    import pyarrow as pa

    from factloom.sources import code

    assert [n for _, n in code._slices(pa.array(["class A { }"] * 600))] == [256, 256, 88]
    assert list(code._slices(pa.array(["x", None, "y" * code.SLICE_CHARS, "z"]))) == [(0, 3), (3, 1)]
    assert list(code._slices(pa.array([], pa.string()))) == []
    text = "/** d */ class A { // x\n int a; /* y\n */ }"
    assert code.Reader(text).code == code.uncommented(text)
    files = spark.range(700, numPartitions=1).selectExpr("concat('A', id, '.java') AS path", "concat('class A', id, ' { }') AS text")
    assert code.read_sources(files).selectExpr("types[0].name").distinct().count() == 700


def test_reading_takes_few_calls():
    """Tokens come from one pass of the expression, so a token of an ordinary file costs fewer than ten calls of functions."""
    import sys

    seen = []
    sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
    try:
        read = code.Reader(SHOP)
    finally:
        sys.setprofile(None)
    assert read.code == code.uncommented(SHOP) and len(seen) < 10 * len(read.tokens), (len(seen), len(read.tokens))


def test_tokens_at_the_ends():
    for text, tokens in (("", []), (" \n ", []), ("a  ", ["a"]), ('x "open', ["x", '"open']), ("a /* open", ["a"]), ("\u00b2x \u0663.5 $y", ["\u00b2x", "\u0663.5", "$y"])):
        assert code.Reader(text).tokens == tokens


def test_types_are_read_without_members(spark, files, parsed):
    alone = extract.light_parse(files, members=False)
    assert "members" not in alone.columns
    facts = lambda p: sorted(p.select("path", "class_fqn", "type_kind", "types", "text").collect(), key=str)
    assert facts(alone) == facts(parsed)
    assert extract.implemented(alone).exceptAll(extract.implemented(parsed)).isEmpty()


def test_sources_with_comments_are_read_in_few_steps():
    """Comments go before tokens are taken where none documents anything; places beside a token are looked up without calls."""
    import sys

    from factloom.plans.source_queries import _CALLER, _COMMENTED

    for text in (_CALLER, _COMMENTED):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            read = code.Reader(text)
        finally:
            sys.setprofile(None)
        assert read.code == code.uncommented(text) and len(seen) < 3 * len(read.tokens), (len(seen), len(read.tokens))


def test_calls_to_clients_are_gone_through_once(parsed):
    plan = extract.client_calls(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1


def _once(df):
    """Whether sources are read once in a plan that joins nothing."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") == 1 and "Join" not in plan and "Union" not in plan


_TWO = [  # the fields of a class that two files declare, and its calls, meet
    ("s", "one/A.java", "package a; class A { @Autowired ARepository<X> repo, log; @Autowired BDao dao; void f() { dao.one(); this.dao.one(); lost.no(); repo.find(1, x -> y.z()); log.no(); } }"),
    ("s", "two/A.java", "package a; class A { A(CRepo more, ZRepository repo) { } void g() { repo.save(more.get()); dao.two(); a.dao.no(); } }"),
    ("t", "A.java", "package a; class A { void f() { dao.other(); } class In { @Autowired BDao dao; } }"),
    (None, "A.java", "package a; class A { @Autowired BDao dao; void f() { dao.nowhere(); } }"),
]


def test_accesses_are_found_in_one_pass(spark):
    files = spark.createDataFrame(_TWO, "service_id string, path string, text string")
    got = extract.data_accesses(extract.light_parse(files, args=False, stage=False))
    assert _once(got)
    want = [("BDao", "one"), ("BDao", "two"), ("ARepository", "find"), ("ARepository", "save"), ("ZRepository", "find"), ("ZRepository", "save"), ("CRepo", "get")]
    assert sorted((r.service_id, r.handler_class_fqn, r.accessor, r.dao_method) for r in got.collect()) == sorted(("s", "a.A", *x) for x in want)
    assert got.exceptAll(extract.data_accesses(extract.light_parse(files))).isEmpty()


def test_calls_of_a_class_meet_its_fields_in_one_pass(spark):
    many = "".join(f"dao.c{i}(); lost.no(); " for i in range(code.MOST_CALLS + 50))
    texts = [(s, p, t.replace("void f", "public void f").replace("void g", "public void g")) for s, p, t in _TWO] + [("m", "M.java", f"class M {{ @Autowired Dao dao; public void f() {{ {many} }} }}")]
    files = spark.createDataFrame(texts, "service_id string, path string, text string")
    got = extract.call_graph(extract.light_parse(files, args=False, stage=False))
    assert _once(got)
    rows = [tuple(r) for r in got.collect()]
    # of two types of a variable the smaller stays; a null service has no fields, as it equals none
    assert sorted(r[2:] for r in rows if r[:2] == ("s", "a.A")) == sorted([
        ("f", "BDao", "one", "dao"), ("f", "ARepository<X>", "find", "repo"), ("g", "ARepository<X>", "save", "repo"), ("g", "CRepo", "get", "more"), ("g", "BDao", "two", "dao"), ("f", "a.A", "one", "dao"),
    ])
    assert {r[4] for r in rows if r[0] == "m"} == {f"c{i}" for i in range(code.MOST_CALLS)} and {r[0] for r in rows} == {"s", "m"}


def test_symbols_are_found_in_one_pass(spark, files):
    texts = [
        ("s", "E.java", "package e; enum E { A }"), ("s", "R.java", 'package r; @RequestMapping({"/a", "/b"}) class R { @RequestMapping({"/c", "/d"}) void quiet() { } public int getIt() { return 1; } public void go() { } public void go(int a) { } }'),
        ("s", "N.java", "class N { @GetMapping @Other public void n() { } class In { @GetMapping public void no() { } } }"),
    ]
    got = extract.symbol_facts(extract.light_parse(spark.createDataFrame(texts, "service_id string, path string, text string"), calls=False, stage=False))
    assert _once(got)
    verbs = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
    want = {("E.java", "e.E", "ENUM", 1.0), ("R.java", "r.R", "CLASS", 1.0), ("N.java", "N", "CLASS", 1.0), ("R.java", "r.R#go", "METHOD", 0.9), ("N.java", "N#n", "METHOD", 0.9), ("N.java", "N#GET ", "ENDPOINT", 1.0)}
    want |= {("R.java", f"r.R#{v} /{b}/{p}", "ENDPOINT", 1.0) for v in verbs for b in "ab" for p in "cd"}
    rows = [(r.path, r.symbol_fqn, r.symbol_kind, r.confidence) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_parts_of_members_are_left_out_alone(files, parsed):
    strip = lambda p, drop: sorted((r.path, r.types, [{k: v for k, v in m.asDict(True).items() if k not in drop} for m in r.members]) for r in p.collect())
    without = extract.light_parse(files, calls=False, stage=False)
    assert strip(without, ["calls"]) == strip(parsed, ["calls"]) and not any(m.calls for r in without.collect() for m in r.members)
    calls = lambda p: sorted((r.path, m.name, [(c.scope, c.chained, c.name) for c in m.calls]) for r in p.collect() for m in r.members)
    assert calls(extract.light_parse(files, args=False, stage=False)) == calls(parsed)
