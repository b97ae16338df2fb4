"""Facts to nodes and edges, and changes to the graph (G-01 to G-04, G-19 to G-28)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded_id, is_class_fqn, simple_name
from ..session import dealt
from .relational import distinct_on, replace_by_key

NODE = "id string, org_id string, repo string, service string, module_type string, node_type string, symbol_fqn string"
EDGE = "from_node string, to_node string, edge_type string, confidence double, evidence_source string"


def node_id(*parts: Column | str) -> Column:
    """G-01: parts joined by ``::``, bounded."""
    return bounded_id(F.concat_ws("::", *parts))


def class_id(service: Column | str, fqn: Column | str) -> Column:
    return node_id(service, F.lit("class"), fqn)


def method_id(service: Column | str, fqn: Column | str, method: Column | str) -> Column:
    return node_id(service, F.lit("method"), F.concat(fqn, F.lit("#"), method))


def endpoint_id(service: Column | str, symbol: Column | str) -> Column:
    return node_id(service, F.lit("endpoint"), symbol)


def type_id(service: Column | str, fqn: Column | str) -> Column:
    return node_id(service, F.lit("type"), fqn)


def artifact_id(group: Column | str, artifact: Column | str, version: Column | str) -> Column:
    return bounded_id(F.concat(F.lit("gav::"), F.concat_ws(":", group, artifact, F.coalesce(version, F.lit("UNRESOLVED")))))


def topic_id(org: Column | str, env: Column | str, short: Column | str) -> Column:
    return bounded_id(F.concat_ws(":", org, F.lit("topic"), env, short))


def edge(source: Column, target: Column, kind: Column | str, confidence: Column | float, evidence: Column | str) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        source.alias("from_node"), target.alias("to_node"), lit(kind).alias("edge_type"),
        lit(confidence).cast("double").alias("confidence"), lit(evidence).alias("evidence_source"),
    ]


def upsert_nodes(rows: DataFrame, sequence: str = "seq") -> DataFrame:
    """G-02: place columns from a node's first row, descriptive ones from its last."""
    first = lambda c: F.min_by(c, sequence).alias(c)
    last = lambda c: F.max_by(c, sequence).alias(c)
    return rows.groupBy("id").agg(first("org_id"), first("repo"), first("service"), last("module_type"), last("node_type"), last("symbol_fqn"))


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """G-03: no uniqueness."""
    return edges.unionByName(new)


def replace_edges(edges: DataFrame, new: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """G-04: all edges of the (from, type) pairs go first; ``scope`` names pairs without new edges."""
    kept = replace_by_key(edges, new, ["from_node", "edge_type"])
    return kept if scope is None else kept.join(scope.select("from_node", "edge_type").distinct(), ["from_node", "edge_type"], "left_anti").unionByName(
        new.join(scope.select("from_node", "edge_type").distinct(), ["from_node", "edge_type"], "left_semi").select(*new.columns)
    ).select(*edges.columns)


def project_models(models: DataFrame, endpoints: DataFrame, libraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-19: class nodes; DEPENDS_ON, or USES_TYPE where a library node has the name; INVOKES where the
    source text uses the injected variable; OUTBOUND_TO by method and path of the latest endpoint.

    ``models(org_id, repo, service_id, module_type, class_fqn, source, injected
    array<struct<name,type>>, outbound array<struct<method,path>>)``,
    ``endpoints(service_id, symbol, method, path, indexed_at)``, ``libraries(id, symbol_fqn)``.
    """
    own = class_id("service_id", "class_fqn")
    nodes = models.filter(is_class_fqn("class_fqn")).select(
        own.alias("id"), "org_id", "repo", F.col("service_id").alias("service"), "module_type", F.lit("CLASS").alias("node_type"), F.col("class_fqn").alias("symbol_fqn")
    )
    library = libraries.groupBy("symbol_fqn").agg(F.min("id").alias("library_id"))
    used = models.select(own.alias("src"), "service_id", "source", F.explode("injected").alias("x")).filter(is_class_fqn("x.type"))
    typed = used.join(library, F.col("x.type") == F.col("symbol_fqn"), "left")
    depends = typed.select(
        *edge(
            F.col("src"),
            F.coalesce("library_id", class_id("service_id", "x.type")),
            F.when(F.col("library_id").isNotNull(), "USES_TYPE").otherwise("DEPENDS_ON"),
            1.0,
            "MODEL",
        )
    )
    invokes = typed.filter(F.contains("source", F.concat("x.name", F.lit(".")))).select(*edge(F.col("src"), class_id("service_id", "x.type"), "INVOKES", 0.9, "MODEL"))
    newest = distinct_on(endpoints, ["method", "path"], [F.desc("indexed_at"), F.asc("symbol")])
    calls = models.select(own.alias("src"), F.explode("outbound").alias("o")).join(newest, (F.col("o.method") == F.col("method")) & (F.col("o.path") == F.col("path")))
    outbound = calls.select(*edge(F.col("src"), endpoint_id("service_id", "symbol"), "OUTBOUND_TO", 0.9, "MODEL"))
    return nodes.distinct(), depends.union(invokes).union(outbound).distinct()


#: Into so many shares the implementations of one type are split.
SHARES = 16


def project_list_routes(factories: DataFrame, implementations: DataFrame) -> DataFrame:
    """G-20: a factory with an injected list of a type routes to each concrete implementation of it.

    The result has a row for each pair, so nothing is shuffled, sorted or
    compared after the pairs are made.  Factories of the same types are one
    class, and so are implementations; which classes meet is made distinct
    between them, and then each pair comes once.  The implementations of one
    type are split into :data:`SHARES`, and a factory stands in all of them.
    """
    own, of = class_id("factory_service", "factory_fqn"), class_id("impl_service", "impl_fqn")
    makers = factories.groupBy(own.alias("maker")).agg(F.array_sort(F.collect_set("list_type")).alias("wanted"))
    made = implementations.filter(~F.col("abstract")).groupBy(of.alias("impl")).agg(F.array_sort(F.collect_set("interface_fqn")).alias("given"))
    wants = makers.select("wanted").distinct().withColumn("type", F.explode("wanted"))
    gives = made.select("given").distinct().withColumn("type", F.explode("given"))
    meeting = makers.join(wants.join(gives, "type").select("wanted", "given").distinct(), "wanted").select("maker", "given")
    # either side may be the smaller one, so both are dealt
    everywhere = dealt(meeting.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), "maker", "share")
    split = dealt(made.withColumn("share", F.pmod(F.xxhash64("impl"), F.lit(SHARES)).cast("int")), "impl")
    return split.join(everywhere, ["given", "share"]).select(*edge(F.col("maker"), F.col("impl"), "ROUTES_TO", 0.95, "LIST_INJECTION"))


def bridge_interfaces(controllers: DataFrame, invokes: DataFrame) -> DataFrame:
    """G-21: IMPLEMENTS from interface to its controller, and the controller's INVOKES copied onto the interface.

    ``controllers(seq, service_id, class_fqn, interfaces)``; of several controllers of an interface the last one stays.
    """
    each = controllers.select("seq", "service_id", "class_fqn", F.explode("interfaces").alias("interface_fqn"))
    last = distinct_on(each, ["service_id", "interface_fqn"], [F.desc("seq"), F.asc("class_fqn")]).select(
        class_id("service_id", "interface_fqn").alias("face"), class_id("service_id", "class_fqn").alias("impl")
    )
    implements = last.select(*edge(F.col("face"), F.col("impl"), "IMPLEMENTS", 0.95, "INTERFACE"))
    copied = invokes.filter("edge_type = 'INVOKES'").join(last, F.col("from_node") == F.col("impl"))
    return implements.union(copied.select("face", "to_node", "edge_type", "confidence", "evidence_source")).distinct()


def service_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G-22: CALLS between services from OUTBOUND_TO between their nodes."""
    at = lambda a, b: nodes.select(F.col("id").alias(a), F.col("service").alias(b))
    pairs = edges.filter("edge_type = 'OUTBOUND_TO'").join(at("from_node", "src"), "from_node").join(at("to_node", "dst"), "to_node")
    services = nodes.filter("node_type = 'SERVICE'").groupBy("service").agg(F.min("id").alias("id"))
    one, two = services.select(F.col("service").alias("src"), F.col("id").alias("a")), services.select(F.col("service").alias("dst"), F.col("id").alias("b"))
    return pairs.filter("src <> dst").select("src", "dst").distinct().join(one, "src").join(two, "dst").select(*edge(F.col("a"), F.col("b"), "CALLS", 1.0, "OUTBOUND"))


def bean_index(components: DataFrame, rules: DataFrame) -> DataFrame:
    """G-23: ``bean, class_fqn``: a rule's name, else the component's own, else the class name with a small first letter."""
    s = simple_name("class_fqn")
    default = F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 10_000))
    own = components.select(F.coalesce("name", default).alias("bean"), "class_fqn", F.when(F.col("name").isNull(), 2).otherwise(1).alias("rank"))
    ruled = rules.select("bean", "class_fqn", F.lit(0).alias("rank"))
    return distinct_on(own.union(ruled), ["bean"], [F.asc("rank"), F.asc("class_fqn")]).select("bean", "class_fqn")


def project_messaging(resources: DataFrame, gates: DataFrame) -> DataFrame:
    """G-24: PUBLISHES_TO, SUBSCRIBES_TO and GUARDED_BY."""
    target = bounded_id(F.concat_ws(":", "org_id", F.lower("resource_kind"), "env_lane", "short_id"))
    linked = resources.filter(F.col("linked_class_fqn").isNotNull())
    flows = linked.select(
        *edge(
            class_id("service_id", "linked_class_fqn"), target,
            F.when(F.col("role") == "PUBLISH", "PUBLISHES_TO").otherwise("SUBSCRIBES_TO"), F.col("confidence"), F.col("evidence_source"),
        )
    )
    gate = bounded_id(F.concat_ws(":", F.lit("gate"), "service_id", "gate_key"))
    guarded = gates.select(*edge(class_id("service_id", F.split_part("guarded_symbol", F.lit("#"), F.lit(1))), gate, "GUARDED_BY", F.col("confidence"), F.col("evidence_source")))
    return flows.union(guarded).distinct()


def project_external(endpoints: DataFrame, calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """G-25: from the caller, else from the class whose name ends like the client's; call sites use the unknown lane."""
    by_name = nodes.filter("node_type = 'CLASS'").select(simple_name("symbol_fqn").alias("client"), F.col("id").alias("client_id"))
    named = by_name.groupBy("client").agg(F.min("client_id").alias("client_id"))
    target = lambda env: node_id("org_id", F.lit("external"), env, "endpoint_id")
    own = endpoints.join(named, F.col("client_class") == F.col("client"), "left").select(
        F.when(F.col("caller_class_fqn").isNotNull(), class_id("service_id", "caller_class_fqn")).otherwise(F.col("client_id")).alias("src"),
        target(F.col("env_lane")).alias("dst"), "confidence", "evidence_source",
    )
    sites = calls.select(class_id("service_id", F.split_part("source_symbol", F.lit("#"), F.lit(1))), target(F.lit("unknown")), "confidence", "evidence_source")
    return own.union(sites).filter("src IS NOT NULL").select(*edge(F.col("src"), F.col("dst"), "CALLS_EXTERNAL", F.col("confidence"), F.col("evidence_source"))).distinct()


def project_triggers(triggers: DataFrame) -> DataFrame:
    """G-26: TRIGGERED_BY from trigger to handler; EXPOSES to the endpoint where method and path are known."""
    own = node_id("org_id", F.lit("entry"), "service_id", "env_lane", "trigger_id")
    runs = triggers.filter("linked_handler_fqn IS NOT NULL").select(
        *edge(own, class_id("service_id", F.split_part("linked_handler_fqn", F.lit("#"), F.lit(1))), "TRIGGERED_BY", F.col("confidence"), F.col("evidence_source"))
    )
    shown = triggers.filter("linked_handler_fqn IS NOT NULL AND http_method IS NOT NULL AND path_pattern IS NOT NULL")
    return runs.union(shown.select(*edge(own, endpoint_id("service_id", "linked_handler_fqn"), "EXPOSES", F.col("confidence"), F.col("evidence_source")))).distinct()


def project_component_scan(mains: DataFrame) -> DataFrame:
    """G-27: WIRES from a main class to each class of its scan annotation: by the import of that name, else in its own package; a name with dots is whole."""
    inner = F.regexp_extract("source", r"@ComponentScan\s*\(\s*basePackageClasses\s*=\s*\{([^}]+)\}", 1)
    names = F.regexp_extract_all(inner, F.lit(r"([\w.]+)\.class"), F.lit(1))
    imported = F.regexp_extract_all("source", F.lit(r"(?m)^import\s+([\w.]+\.\w+)\s*;"), F.lit(1))
    own = F.regexp_extract("class_fqn", r"^(.+)\.[^.]*$", 1)

    def full(name: Column) -> Column:
        hits = F.filter(imported, lambda i: simple_name(i) == name)
        local = F.when(name.contains(".") | (own == ""), name).otherwise(F.concat_ws(".", own, name))
        return F.coalesce(F.try_element_at(hits, F.lit(-1)), local)

    found = mains.select("service_id", "class_fqn", F.explode(F.transform(names, full)).alias("target"))
    return found.select(*edge(class_id("service_id", "class_fqn"), class_id("service_id", "target"), "WIRES", 0.88, "COMPONENT_SCAN")).distinct()


def project_maven(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """G-28: CONTAINS_MODULE, DEPENDS_ON_ARTIFACT, and OWNED_BY for links into other repositories."""
    own = lambda path: node_id("service_id", F.lit("maven"), path)
    nested = modules.filter(F.col("parent_path").isNotNull()).select(*edge(own("parent_path"), own("module_path"), "CONTAINS_MODULE", 1.0, "POM"))
    artifact = artifact_id("to_group", "to_artifact", "to_version")
    needs = dependencies.select(*edge(own("module_path"), artifact, "DEPENDS_ON_ARTIFACT", F.col("confidence"), "POM"))
    owned = dependencies.filter("cross_repo AND linked_service_id IS NOT NULL").select(*edge(artifact, F.col("linked_service_id"), "OWNED_BY", 0.95, "GAV"))
    return nested.union(needs).union(owned).distinct()


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
