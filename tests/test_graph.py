"""Traversal on the small shop graph, and on random graphs with cycles."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph_projection, traverse

NODES = [
    ("svc-orders", "orders", "service", "SERVICE", None), ("svc-inventory", "inventory", "service", "SERVICE", None), ("svc-notifications", "notifications", "service", "SERVICE", None),
    ("cls-order-ctrl", "orders", "service", "CLASS", "com.example.OrderController"), ("cls-order-svc", "orders", "service", "CLASS", "com.example.OrderService"),
    ("ep-get-order", "orders", "service", "ENDPOINT", "com.example.OrderController#getOrder"), ("cls-inv-svc", "inventory", "service", "CLASS", "com.example.InventoryService"),
    ("type-order-dto", "shared-lib", "library", "SHARED_TYPE", "com.example.shared.OrderDto"),
]
EDGES = [
    ("svc-orders", "svc-inventory", "CALLS"), ("svc-orders", "svc-notifications", "CALLS"), ("cls-order-ctrl", "cls-order-svc", "DEPENDS_ON"),
    ("ep-get-order", "cls-inv-svc", "OUTBOUND_TO"), ("svc-orders", "type-order-dto", "USES_TYPE"), ("svc-inventory", "type-order-dto", "USES_TYPE"),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, "acme", "monorepo", s, m, t, f) for i, s, m, t, f in NODES], graph_projection.NODE)
    edges = spark.createDataFrame([(a, b, t, 1.0, None) for a, b, t in EDGES], graph_projection.EDGE)
    return nodes, edges


def found(df):
    return {r.node for r in df.collect()}


def test_forward_and_reverse(spark, graph):
    at = lambda i: traverse.seeds_of(spark, [i])
    assert found(traverse.service_calls_forward(*graph, at("svc-orders"))) == {"svc-inventory", "svc-notifications"}
    assert found(traverse.class_forward(*graph, at("cls-order-ctrl"))) == {"cls-order-svc"}
    assert found(traverse.endpoint_outbound(*graph, at("ep-get-order"))) == {"cls-inv-svc"}
    assert found(traverse.reverse_reachability(*graph, at("type-order-dto"))) == {"svc-orders", "svc-inventory"}
    assert found(traverse.neighborhood(*graph, at("svc-orders"))) == {"svc-inventory", "svc-notifications"}
    assert found(traverse.cross_service_boundary(*graph, at("ep-get-order"))) == {"cls-inv-svc"}
    assert {r.id for r in traverse.shared_types(graph[0], "com.example.shared.OrderDto").collect()} == {"type-order-dto"}
    assert traverse.type_fan_out(*graph, "com.example.shared.OrderDto").count() == 2


def test_a_cycle_brings_the_anchor_back(spark, graph):
    nodes, edges = graph
    more = graph_projection.insert_edges(edges, spark.createDataFrame([("svc-inventory", "svc-orders", "CALLS", 1.0, None)], graph_projection.EDGE))
    assert "svc-orders" in found(traverse.service_calls_forward(nodes, more, traverse.seeds_of(spark, ["svc-orders"])))


def test_replaced_edges(spark, graph):
    nodes, edges = graph
    new = spark.createDataFrame([("cls-order-ctrl", "cls-inv-svc", "DEPENDS_ON", 1.0, None)], graph_projection.EDGE)
    after = graph_projection.replace_edges(edges, new)
    assert found(traverse.class_forward(nodes, after, traverse.seeds_of(spark, ["cls-order-ctrl"]))) == {"cls-inv-svc"}


def test_hydration(spark, graph):
    reached = traverse.service_calls_forward(*graph, traverse.seeds_of(spark, ["svc-orders"]))
    nodes, edges = traverse.hydrate(*graph, "svc-orders", reached)
    assert [r.id for r in nodes.collect()] == ["svc-inventory", "svc-notifications", "svc-orders"] and edges.count() == 2


def test_start_nodes():
    assert traverse.start_node("class", None, "svc", "a.B") == "svc::class::a.B"
    with pytest.raises(ValueError):
        traverse.start_node("class", None, "svc")


@pytest.mark.parametrize("depth", [None, 2])
def test_fixpoint_on_random_graphs(spark, depth):
    r = random.Random(7)
    pairs = {(r.randrange(25), r.randrange(25)) for _ in range(45)}
    seeds = [1, 2, 3]
    got = {(x.seed, x.node): x.depth for x in traverse.fixpoint(spark.createDataFrame(list(pairs), "src int, dst int"), spark.createDataFrame([(s, s) for s in seeds], "seed int, node int"), depth).collect()}
    want = {}
    for s in seeds:
        level, seen, d = {s}, set(), 0
        while level and (depth is None or d < depth):
            d += 1
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(s, n): d for n in level}
    assert got == want


def test_node_ids(spark):
    df = spark.createDataFrame([("svc-001", "io.orders." + "X" * 2000)], "s string, f string").select(graph_projection.class_id("s", "f").alias("i"))
    i = df.head().i
    assert len(i) == 1024 and "::h:" in i
    one = spark.createDataFrame([("svc-001", "io.C")], "s string, f string").select(graph_projection.class_id("s", "f").alias("i")).head().i
    assert one == "svc-001::class::io.C"


def test_project_models(spark):
    models = spark.createDataFrame(
        [("o", "r", "s1", "service", "a.C", "x.go()", [("x", "a.D"), ("t", "lib.T")], [("GET", "/p")])],
        "org_id string, repo string, service_id string, module_type string, class_fqn string, source string, injected array<struct<name:string,type:string>>, outbound array<struct<method:string,path:string>>",
    )
    ends = spark.createDataFrame([("s2", "b.E#get", "GET", "/p", 1), ("s3", "old#get", "GET", "/p", 0)], "service_id string, symbol string, method string, path string, indexed_at int")
    nodes, edges = graph_projection.project_models(models, ends, spark.createDataFrame([("lib::T", "lib.T")], "id string, symbol_fqn string"))
    assert nodes.count() == 1
    assert {(r.to_node, r.edge_type) for r in edges.collect()} == {("s1::class::a.D", "DEPENDS_ON"), ("lib::T", "USES_TYPE"), ("s1::class::a.D", "INVOKES"), ("s2::endpoint::b.E#get", "OUTBOUND_TO")}


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_a_chain_is_walked_to_its_end_or_raises(spark, monkeypatch, levels):
    monkeypatch.setattr(traverse, "LEVELS", levels)
    steps = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n5", "n0"), ("n0", "n7")], "src string, dst string")
    seeds = traverse.seeds_of(spark, ["n0"])
    got = {r.node: r.depth for r in traverse.fixpoint(steps, seeds).collect()}
    near = {f"n{i}": i for i in range(1, 7)} | {f"n{i}": i - 6 for i in range(7, 21)}
    assert got == near | {"n0": 6}
    assert {r.node: r.depth for r in traverse.fixpoint(steps, seeds, 4).collect()} == {k: v for k, v in near.items() if v <= 4}
    with pytest.raises(RuntimeError):
        traverse.fixpoint(steps, seeds, most_depth=5)


def test_list_routes_come_once_and_from_many_tasks(spark):
    from factloom.operators import graph_projection

    f = spark.createDataFrame([("s", "a.F", "T1"), ("s", "a.F", "T2"), ("s", "a.F", "T2"), ("s", "a.G", "T2"), ("s", "a.H", None)], "factory_service string, factory_fqn string, list_type string")
    rows = [("s", "b.Both", t, False) for t in ("T1", "T2", "T2")] + [("s", "b.One", "T1", False), ("s", "b.No", "T1", True), ("s", "b.Null", None, False)]
    i = spark.createDataFrame(rows, "impl_service string, impl_fqn string, interface_fqn string, abstract boolean")
    got = graph_projection.project_list_routes(f, i)
    pairs = sorted((r.from_node.split(".")[-1], r.to_node.split(".")[-1]) for r in got.collect())
    assert pairs == [("F", "Both"), ("F", "One"), ("G", "Both")]
    big = spark.range(2000, numPartitions=1).selectExpr("'s' AS impl_service", "concat('b.I', id) AS impl_fqn", "'T1' AS interface_fqn", "false AS abstract")
    parts = graph_projection.project_list_routes(f, big).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 2 and sum(r["count"] for r in parts) == 2000


def test_many_steps_are_not_broadcast(spark, monkeypatch):
    plans, staged = [], traverse.staged

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(traverse, "staged", seen)
    monkeypatch.setattr(traverse, "FEW_STEPS", 2)
    steps = spark.createDataFrame([(str(i), str((i + 1) % 7)) for i in range(7)], "src string, dst string")
    got = traverse.fixpoint(steps, traverse.seeds_of(spark, ["0"])).collect()
    assert sorted((r.node, r.depth) for r in got) == sorted((str(i % 7), i) for i in range(1, 8))
    assert any("SortMergeJoin" in p for p in plans) and not any("Inner, Build" in p for p in plans)
