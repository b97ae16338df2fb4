"""Cycle-safe traversal and the graph queries built on it (G-05 to G-18).

Graphs are ``nodes(id, org_id, repo, service, module_type, node_type, symbol_fqn)``
and ``edges(from_node, to_node, edge_type, confidence, evidence_source)``; edges
may repeat.  A traversal starts with the targets of the anchor's edges, so the
anchor itself is in the result only if a cycle leads back to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import class_part
from ..session import staged

CLASS_EDGES = ("DEPENDS_ON", "INVOKES", "ROUTES_TO", "IMPLEMENTS")
METHOD_EDGES = ("INVOKES", "ROUTES_TO")
REVERSE_EDGES = ("CALLS", "DEPENDS_ON", "USES_TYPE", "INVOKES", "ROUTES_TO")
NEAR_EDGES = ("CALLS", "DEPENDS_ON", "INVOKES", "ROUTES_TO", "OUTBOUND_TO", "PUBLISHES_TO", "SUBSCRIBES_TO")
HYDRATED_EDGES = (
    "CALLS", "DEPENDS_ON", "INVOKES", "ROUTES_TO", "OUTBOUND_TO", "USES_TYPE", "PUBLISHES_TO", "SUBSCRIBES_TO", "GUARDED_BY", "TRIGGERED_BY",
)
DEFAULT_DEPTH = 6
#: From so few rows on, so many levels are walked at once.
FEW_ROWS, LEVELS = 50_000, 5
#: More steps than these are not broadcast: their files are much smaller than the rows that every level would send.
FEW_STEPS = 100_000


def seeds_of(spark: SparkSession, ids: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "seed string, node string")


def _steps(edges: DataFrame, types: Sequence[str] | None, reverse: bool = False) -> DataFrame:
    df = edges if types is None else edges.filter(F.col("edge_type").isin(*types))
    src, dst = ("to_node", "from_node") if reverse else ("from_node", "to_node")
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def fixpoint(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None, include_seeds: bool = False, most_depth: int = 10_000) -> DataFrame:
    """``seed, node, depth``: what each seed reaches over ``steps(src, dst)``, at its first depth.

    All seeds advance together.  A round goes one level on, or, from few rows,
    :data:`LEVELS` levels in one plan, as jobs cost more there than walking over
    a node twice.  Its new nodes are written to the shared folder: the next
    round joins those of the last level only, and what was visited is a read of
    the written rounds, so lineage does not grow.  A traversal without a depth
    that has not ended at ``most_depth`` is an error.
    """
    steps = staged(steps, "steps")
    steps = steps if steps.count() <= FEW_STEPS else steps.hint("merge")
    frontier = staged(seeds.select("seed", "node", F.lit(0).alias("depth")).distinct(), "frontier")
    rounds, depth, last = ([frontier] if include_seeds else []), 0, most_depth if max_depth is None else max_depth
    rows = frontier.count()
    while rows and depth < last:
        level, met = frontier, []
        for _ in range(min(LEVELS if rows <= FEW_ROWS else 1, last - depth)):
            depth += 1
            level = level.join(steps, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
            met.append(level.withColumn("depth", F.lit(depth)))
        new = _union(met) if len(met) == 1 else _union(met).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
        for done in rounds:
            new = new.join(done.select("seed", "node"), ["seed", "node"], "left_anti")
        rounds.append(staged(new, "visited"))
        frontier = rounds[-1].filter(F.col("depth") == depth)
        rows = frontier.count()
        if len(rounds) > 8:
            rounds = [staged(_union(rounds), "visited")]
    if rows and max_depth is None:
        raise RuntimeError(f"the traversal has not ended at depth {depth}")
    return _union(rounds) if rounds else frontier


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _typed(found: DataFrame, nodes: DataFrame, *types: str) -> DataFrame:
    """Found ids that are nodes (of these types)."""
    df = nodes.filter(F.col("node_type").isin(*types)) if types else nodes
    return found.join(df.select(F.col("id").alias("node")), "node").select("seed", "node")


def service_calls_forward(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """G-05."""
    return _typed(fixpoint(_steps(edges, ["CALLS"]), seeds), nodes, "SERVICE")


def class_forward(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """G-06."""
    return _typed(fixpoint(_steps(edges, CLASS_EDGES), seeds), nodes, "CLASS", "METHOD")


def method_forward(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """G-07: a depth of none or under one is the default."""
    return _typed(fixpoint(_steps(edges, METHOD_EDGES), seeds, max_depth if max_depth and max_depth > 0 else DEFAULT_DEPTH), nodes)


def endpoint_outbound(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """G-08."""
    return _typed(fixpoint(_steps(edges, ["OUTBOUND_TO"]), seeds), nodes)


def reverse_reachability(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """G-09: what depends on the seeds, however indirectly."""
    return _typed(fixpoint(_steps(edges, REVERSE_EDGES, reverse=True), seeds), nodes)


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """G-10: one step either way, without the seed."""
    both = _steps(edges, NEAR_EDGES).union(_steps(edges, NEAR_EDGES, reverse=True)).distinct()
    found = seeds.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
    return _typed(found.filter("seed <> node"), nodes)


def cross_service_boundary(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """G-11: the first step leaves the seed's service, later ones are free, and the result lies outside it."""
    steps = _steps(edges, ["OUTBOUND_TO", "CALLS"])
    home = seeds.join(nodes.select(F.col("id").alias("node"), F.col("service").alias("home")), "node").select("seed", "node", "home")
    place = nodes.select(F.col("id").alias("dst"), F.col("service").alias("there"))
    first = home.join(steps, F.col("node") == F.col("src")).join(place, "dst").filter("home <> there").select("seed", F.col("dst").alias("node")).distinct()
    reached = fixpoint(steps, first, include_seeds=True)
    away = reached.join(home.select("seed", "home"), "seed").join(place, F.col("node") == F.col("dst"))
    return away.filter("home <> there").select("seed", "node").distinct()


def shared_types(nodes: DataFrame, fqn: str) -> DataFrame:
    """G-12: library nodes of a name; ids only."""
    return nodes.filter((F.col("module_type") == "library") & (F.col("symbol_fqn") == fqn)).select("id")


def type_fan_out(nodes: DataFrame, edges: DataFrame, fqn: str) -> DataFrame:
    """G-13: who uses a library type; ids only."""
    types = shared_types(nodes, fqn)
    uses = edges.filter("edge_type = 'USES_TYPE'").join(types, F.col("to_node") == F.col("id"), "left_semi")
    return uses.select(F.col("from_node").alias("id")).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, types: Sequence[str]) -> DataFrame:
    """G-14: many starts, which are part of the result at depth 0."""
    starts = seeds.select(F.lit("*").alias("seed"), "node").distinct()
    return fixpoint(_steps(edges, types), starts, depth, include_seeds=True).select("node", "depth")


def edges_between(edges: DataFrame, ids: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """G-15: the induced subgraph; ``ids(id)`` are never collected."""
    df = edges if types is None else edges.filter(F.col("edge_type").isin(*types))
    keys = ids.select("id").distinct()
    one = keys.select(F.col("id").alias("from_node"))
    return df.join(one, "from_node", "left_semi").join(keys.select(F.col("id").alias("to_node")), "to_node", "left_semi").select(*edges.columns)


def hydrate(nodes: DataFrame, edges: DataFrame, anchor: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of a result and its anchor, in order of id, and the edges of the usual types between them."""
    ids = found.select(F.col("node").alias("id")).union(found.sparkSession.createDataFrame([(anchor,)], "id string")).distinct()
    loaded = nodes.join(ids, "id", "left_semi").select(*nodes.columns)
    return loaded.orderBy("id"), edges_between(edges, loaded, HYDRATED_EDGES)


def implementation_of(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """G-16: ``symbol, class_fqn``: the first implementation of the symbol's class by name, else the class itself."""
    wanted = symbols.select("symbol", class_part("symbol").alias("own"))
    name = nodes.select(F.col("id"), F.col("symbol_fqn"))
    pairs = (
        edges.filter("edge_type = 'IMPLEMENTS'")
        .join(name.select(F.col("id").alias("from_node"), F.col("symbol_fqn").alias("own")), "from_node")
        .join(name.select(F.col("id").alias("to_node"), F.col("symbol_fqn").alias("impl")), "to_node")
    )
    first = pairs.groupBy("own").agg(F.min("impl").alias("impl"))
    return wanted.join(first, "own", "left").select("symbol", F.coalesce("impl", "own").alias("class_fqn"))


def start_node(kind: str, node_id: str | None = None, service_id: str | None = None, name: str | None = None) -> str:
    """G-17: a given node id wins; else it is built from the kind; too little is an error."""
    if node_id:
        return node_id
    if kind == "service" and (service_id or name):
        return service_id or name or ""
    if kind in ("class", "method", "endpoint") and service_id and name:
        return f"{service_id}::{kind}::{name}"
    raise ValueError("a start node needs nodeId, or a kind with its service and name")


def routing(routes: DataFrame, factory: str | None = None) -> DataFrame:
    """G-18: one row a factory, its routes in order of key; selector from the first."""
    df = routes.filter(F.col("factory_class_fqn") == factory) if factory else routes
    each = F.struct("routing_key", "target_class_fqn", "fallback", "selector")
    return df.groupBy("factory_class_fqn").agg(F.sort_array(F.collect_list(each)).alias("routes")).select(
        "factory_class_fqn", F.col("routes")[0]["selector"].alias("selector"), "routes"
    )
