"""Flow diagrams of a service: what an anchor leads to, with roles, ingress, egress, gaps and Mermaid text (F-44, C-33)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_package, mermaid_id, mermaid_label, simple_name
from .traverse import DEFAULT_DEPTH, bfs, edges_between, seeds_of

FLOW_EDGES = ("DEPENDS_ON", "INVOKES", "ROUTES_TO", "IMPLEMENTS", "OUTBOUND_TO", "PUBLISHES_TO", "SUBSCRIBES_TO", "CALLS_EXTERNAL", "GUARDED_BY")
#: Role of a node type or of a name's ending, the first that fits.
ROLES = (("TOPIC", "topic"), ("SUBSCRIPTION", "topic"), ("GATE", "gate"), ("EXTERNAL_ENDPOINT", "external"), ("ENDPOINT", "endpoint"), ("SERVICE", "service"))
NAME_ROLES = (("(Controller|Resource)$", "controller"), ("(Dao|Repository|Repo)$", "store"), ("(Factory|Registry)$", "router"), ("(Publisher|Producer)$", "publisher"), ("(Consumer|Listener)$", "consumer"))
#: A diagram of more nodes than this is not drawn as text.
MOST_DRAWN = 400


def anchors(nodes: DataFrame, triggers: DataFrame, kind: str, value: str) -> DataFrame:
    """``node``: where a diagram starts: of a node, a symbol, a handler, a trigger, or all REST handlers of a package."""
    if kind == "nodeId":
        return nodes.filter(F.col("id") == value).select(F.col("id").alias("node"))
    if kind == "symbolFqn":
        return nodes.filter(F.col("symbol_fqn") == value).select(F.col("id").alias("node"))
    handler = F.split_part("linked_handler_fqn", F.lit("#"), F.lit(1))
    if kind == "triggerId":
        hit = triggers.filter(F.col("trigger_id") == value)
    elif kind == "handlerFqn":
        hit = triggers.filter(handler == value)
    elif kind == "rest":
        hit = triggers.filter(F.col("trigger_kind").isin("REST_INBOUND", "WEBHOOK_INBOUND") & in_package("linked_handler_fqn", value))
    else:
        raise ValueError(f"unknown anchor {kind}")
    names = hit.select(handler.alias("symbol_fqn")).distinct()
    return nodes.join(names, "symbol_fqn", "left_semi").select(F.col("id").alias("node"))


@dataclass(frozen=True)
class FlowDiagram:
    nodes: DataFrame
    edges: DataFrame
    ingress: DataFrame
    gaps: DataFrame

    def stats(self) -> DataFrame:
        return self.nodes.groupBy("role").agg(F.count("*").alias("nodes"))

    def mermaid(self) -> str:
        """A flow chart with one subgraph for each service, in order of names."""
        rows = self.nodes.select("service", mermaid_id("id").alias("i"), mermaid_label("label").alias("l")).orderBy("service", "l", "i").limit(MOST_DRAWN + 1).collect()
        if len(rows) > MOST_DRAWN:
            raise ValueError(f"more than {MOST_DRAWN} nodes; narrow the package or the depth")
        lines, service = ["flowchart LR"], None
        for r in rows:
            if r["service"] != service:
                lines += (["  end"] if service is not None else []) + [f"  subgraph {r['service']}"]
                service = r["service"]
            lines.append(f'    {r["i"]}["{r["l"]}"]')
        lines += ["  end"] if rows else []
        links = self.edges.select(mermaid_id("from_node").alias("a"), mermaid_id("to_node").alias("b"), "edge_type").distinct().orderBy("a", "b", "edge_type")
        drawn = links.limit(20 * MOST_DRAWN + 1).collect()
        if len(drawn) > 20 * MOST_DRAWN:
            raise ValueError(f"more than {20 * MOST_DRAWN} edges; narrow the package or the depth")
        return "\n".join([*lines, *(f"  {r['a']} -->|{r['edge_type']}| {r['b']}" for r in drawn)])


def compose(nodes: DataFrame, edges: DataFrame, triggers: DataFrame, starts: DataFrame, depth: int = DEFAULT_DEPTH, package: str | None = None, types: Sequence[str] = FLOW_EDGES) -> FlowDiagram:
    """The subgraph that ``starts(node)`` reach, kept to a package (messaging nodes stay), and what enters and leaves it."""
    reached = bfs(edges, starts.select("node"), depth, types)
    own = nodes.join(reached.select(F.col("node").alias("id"), "depth"), "id").filter(in_package(F.coalesce("symbol_fqn", F.lit("")), package, "node_type") | F.col("symbol_fqn").isNull())
    by_name = F.lit("class")
    for pattern, role in reversed(NAME_ROLES):
        by_name = F.when(F.coalesce("symbol_fqn", F.lit("")).rlike(pattern), role).otherwise(by_name)
    role = by_name
    for kind, name in reversed(ROLES):
        role = F.when(F.col("node_type") == kind, name).otherwise(role)
    shown = own.select("id", "service", "node_type", "symbol_fqn", "depth", role.alias("role"), F.coalesce(simple_name("symbol_fqn"), "id").alias("label"))
    inside = edges_between(edges, shown, types)
    handler = F.split_part("linked_handler_fqn", F.lit("#"), F.lit(1))
    ingress = triggers.select("trigger_id", "trigger_kind", handler.alias("symbol_fqn")).join(shown.select("symbol_fqn", "id"), "symbol_fqn").select("trigger_id", "trigger_kind", F.col("id").alias("to_node"))
    # a class that neither stores, publishes nor calls anything is where the known flow ends
    leads = inside.select(F.col("from_node").alias("id")).distinct()
    ends = shown.filter("role IN ('class', 'controller', 'router', 'consumer')").join(leads, "id", "left_anti")
    return FlowDiagram(shown, inside, ingress, ends.select(F.lit("FLOW_ENDS").alias("gap_type"), "id"))


def diagram_of(nodes: DataFrame, edges: DataFrame, triggers: DataFrame, node_id: str, depth: int = DEFAULT_DEPTH) -> FlowDiagram:
    return compose(nodes, edges, triggers, seeds_of(nodes.sparkSession, [node_id]), depth)
