"""Data catalogs, Maven modules, registry and workspace (F-32 to F-37, F-41 to F-47, I-18, I-27, I-28)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import accessor_entity, append_evidence, in_maven_scope, normalize_table, simple_name
from .relational import Page, distinct_on, page, parent_path, upsert, update_where, where_given
from .traverse import fixpoint

DDL_STORES = ("MARIADB", "CASSANDRA")


def catalog_page(objects: DataFrame, limit: int | None = None, offset: int | None = None, **wanted: object) -> Page:
    """F-32."""
    return page(where_given(objects, **wanted), [F.asc("service_id"), F.asc("physical_name")], limit, offset)


def resolve_entities(names: DataFrame, objects: DataFrame, pinned: DataFrame) -> DataFrame:
    """F-33: ``names(service_id, entity_fqn)`` in the pinned libraries, in order; in any library only where nothing is pinned.

    By simple name, pinned libraries come first but others count as well.
    """
    libs = pinned.select("service_id", F.col("library_id"), "position")
    has = libs.select("service_id").distinct().withColumn("has_pins", F.lit(True))
    lib = objects.select(F.col("service_id").alias("library_id"), F.col("entity_fqn").alias("found_fqn"), "physical_name", "store_type")
    wanted = names.join(has, "service_id", "left")
    exact = wanted.join(lib, F.col("entity_fqn") == F.col("found_fqn")).join(libs, ["service_id", "library_id"], "left")
    exact = exact.filter(F.col("has_pins").isNull() | F.col("position").isNotNull()).withColumn("tier", F.lit(0))
    short = wanted.withColumn("simple", simple_name("entity_fqn")).join(lib.withColumn("simple", simple_name("found_fqn")), "simple").drop("simple")
    short = short.join(libs, ["service_id", "library_id"], "left").withColumn("tier", F.lit(1)).select(*exact.columns)
    order = [F.asc("tier"), F.asc_nulls_last("position"), F.asc("library_id"), F.asc("found_fqn")]
    return distinct_on(exact.union(short), ["service_id", "entity_fqn"], order).select("service_id", "entity_fqn", "library_id", "found_fqn", "physical_name", "store_type")


def library_staleness(libraries: DataFrame, objects: DataFrame, as_of: dt.datetime | Column, hours: int = 24) -> DataFrame:
    """F-34."""
    at = objects.groupBy("service_id").agg(F.max("indexed_at").alias("indexed_at"))
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    state = F.when(F.col("indexed_at").isNull(), "LIBRARY_NOT_INDEXED").when(F.col("indexed_at") < now - F.expr(f"INTERVAL {hours} HOURS"), "LIBRARY_STALE")
    return libraries.select("service_id").distinct().join(at, "service_id", "left").select("service_id", "indexed_at", state.alias("gap_type"))


def data_object_gaps(objects: DataFrame, ddl: DataFrame, accesses: DataFrame) -> DataFrame:
    """F-35: ``gap_type, service_id, subject``."""
    name = normalize_table("physical_name").alias("t")
    have, declared = objects.select("service_id", "physical_name", "store_type", name), ddl.select("service_id", "physical_name", name)
    inferred = have.filter(F.col("store_type").isin(*DDL_STORES)).join(declared.select("t").distinct(), "t", "left_anti")
    unused = declared.join(have.select("t").distinct(), "t", "left_anti")
    touched = accesses.withColumn("t", normalize_table("table_or_entity")).join(have.select("t").distinct(), "t", "left_anti")
    return (
        inferred.select(F.lit("INFERRED_NOT_IN_DDL").alias("gap_type"), "service_id", F.col("physical_name").alias("subject"))
        .union(unused.select(F.lit("DDL_UNREFERENCED"), "service_id", "physical_name"))
        .union(touched.select(F.lit("HANDLER_WITHOUT_CATALOG"), "service_id", "handler_class_fqn"))
        .distinct()
    )


def validate_objects(objects: DataFrame, ddl: DataFrame) -> DataFrame:
    """F-37: DDL_CONFIRMED, INFERRED_NOT_IN_DDL, or null for stores without DDL; a null or empty catalog fits any."""
    declared = ddl.select(normalize_table("physical_name").alias("t"), F.col("catalog").alias("ddl_catalog")).distinct()
    joined = objects.withColumn("t", normalize_table("physical_name")).join(declared.withColumn("hit", F.lit(True)), "t", "left")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    fits = F.col("hit") & (blank("catalog") | blank("ddl_catalog") | (F.col("catalog") == F.col("ddl_catalog")))
    best = joined.groupBy(*objects.columns).agg(F.max(F.coalesce(fits, F.lit(False))).alias("fits"))
    state = F.when(F.col("fits"), "DDL_CONFIRMED").when(F.col("store_type").isin(*DDL_STORES), "INFERRED_NOT_IN_DDL")
    return best.select(*objects.columns, state.alias("validation_status"))


def merge_accesses(accesses: DataFrame, rules: DataFrame, validated: DataFrame) -> DataFrame:
    """F-36: a rule by entity, else by table, else by accessor suffix and method, overrides physical name and store.

    Confirmed objects gain 0.05 of confidence, up to 1.  ``rules(rule_id, entity,
    table_name, accessor_suffix, method, set_name, set_store)``.
    """
    own = accesses.withColumn("e", simple_name("table_or_entity")).withColumn("t", normalize_table("table_or_entity")).withColumn("a", accessor_entity("accessor_fqn"))
    rule = rules.withColumn("rt", normalize_table("table_name"))
    tests = [(F.col("e") == F.col("entity"), 0), (F.col("t") == F.col("rt"), 1), ((F.col("a") == F.col("accessor_suffix")) & (F.col("dao_method") == F.col("method")), 2)]
    hits = None
    for test, tier in tests:
        part = own.select("access_id", "e", "t", "a", "dao_method").join(rule, test).select("access_id", F.lit(tier).alias("tier"), "rule_id", "set_name", "set_store")
        hits = part if hits is None else hits.union(part)
    best = distinct_on(hits, ["access_id"], [F.asc("tier"), F.asc("rule_id")])
    sure = validated.filter("validation_status = 'DDL_CONFIRMED'").select(normalize_table("physical_name").alias("__t")).distinct().withColumn("confirmed", F.lit(True))
    out = own.join(best, "access_id", "left").withColumn("physical", F.coalesce("set_name", "table_or_entity"))
    out = out.join(sure, normalize_table("physical") == F.col("__t"), "left")
    return out.select(
        "access_id", "physical", F.coalesce("set_store", "store_type").alias("store_type"),
        F.when(F.col("confirmed"), F.least(F.col("confidence") + 0.05, F.lit(1.0))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("rule_id").isNotNull(), append_evidence("evidence_source", "RULE_PACK")).otherwise(F.col("evidence_source")).alias("evidence_source"),
    )


#: How a type name was found, in the order tried, and how sure that is.
TYPE_OUTCOMES = (
    ("QUALIFIED", 0.95), ("IMPORT", 0.95), ("CLASSPATH", 0.90), ("CATALOG", 0.80), ("SYMBOL_FACT", 0.85), ("SAME_PACKAGE", 0.50), ("UNKNOWN", 0.0),
)


def resolve_types(uses: DataFrame, imports: DataFrame, classpath: DataFrame, catalog: DataFrame, symbols: DataFrame) -> DataFrame:
    """I-18: ``uses(use_id, file_path, package, type_name)``; the first outcome that names a class wins."""
    best = lambda df, on, name: df.groupBy(*on).agg(F.min("fqn").alias(name))
    out = (
        uses.join(best(imports, ["file_path", "type_name"], "by_import"), ["file_path", "type_name"], "left")
        .join(best(classpath, ["type_name"], "by_path"), "type_name", "left")
        .join(best(catalog, ["type_name"], "by_catalog"), "type_name", "left")
        .join(best(symbols, ["type_name"], "by_symbol"), "type_name", "left")
    )
    qualified = F.when(F.contains("type_name", F.lit(".")), F.col("type_name"))
    same = F.when(F.coalesce("package", F.lit("")) != "", F.concat_ws(".", "package", "type_name"))
    tries = [qualified, F.col("by_import"), F.col("by_path"), F.col("by_catalog"), F.col("by_symbol"), same]
    outcome, sure = F.lit(TYPE_OUTCOMES[-1][0]), F.lit(0.0)
    for (name, conf), found in reversed(list(zip(TYPE_OUTCOMES, tries))):
        outcome, sure = F.when(found.isNotNull(), name).otherwise(outcome), F.when(found.isNotNull(), conf).otherwise(sure)
    return out.select("use_id", F.coalesce(*tries).alias("fqn"), outcome.alias("outcome"), sure.alias("confidence"))


def maven_dependencies(dependencies: DataFrame, scope: str | None = None, direct_only: bool = False, group: str | None = None, artifact: str | None = None, module: str | None = None) -> DataFrame:
    """F-41."""
    df = where_given(dependencies, to_group=group, to_artifact=artifact, module_path=module).filter(in_maven_scope("scope", scope))
    return df.filter("NOT transitive") if direct_only else df


def find_module(modules: DataFrame, hint: str | None = None) -> DataFrame:
    """F-42: the module of this path, else of this artifact, else the only or default one: jar, war, others, then the longest path."""
    order = [F.when(F.col("packaging") == "jar", 0).when(F.col("packaging") == "war", 1).otherwise(2), F.desc(F.length("module_path")), F.asc("module_path")]
    tier = F.when(F.col("module_path") == hint, 0).when(F.col("artifact_id") == hint, 1).otherwise(2) if hint else F.lit(2)
    return modules.withColumn("__tier", tier).orderBy("__tier", *order).limit(1).drop("__tier")


def module_tree(modules: DataFrame, roots: DataFrame, max_depth: int = 0) -> DataFrame:
    """F-43: ``root, module_path, depth`` below each root; parents by path; a depth under one is without bound."""
    steps = modules.select(parent_path("module_path").alias("src"), F.col("module_path").alias("dst")).filter("src IS NOT NULL")
    seeds = roots.select(F.col("module_path").alias("seed"), F.col("module_path").alias("node"))
    found = fixpoint(steps, seeds, max_depth if max_depth > 0 else None, include_seeds=True)
    return found.select(F.col("seed").alias("root"), F.col("node").alias("module_path"), "depth")


def module_artifacts(tree: DataFrame, dependencies: DataFrame, group_prefix: str | None = None) -> DataFrame:
    """F-43: artifacts and unresolved ones of each module in a tree."""
    deps = dependencies.filter(F.startswith("to_group", F.lit(group_prefix))) if group_prefix else dependencies
    ga = F.concat_ws(":", "to_group", "to_artifact", F.coalesce("to_version", F.lit("UNRESOLVED")))
    per = deps.groupBy("module_path").agg(F.sort_array(F.collect_set(ga)).alias("artifacts"), F.count_if(~F.col("resolved")).alias("unresolved"))
    return tree.join(per, "module_path", "left").select("root", "module_path", "depth", "artifacts", F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


#: Where a link's service was found, and how sure that is.
LINK_SOURCES = (("GAV", 0.98), ("CATALOG", 0.95), ("ALIAS", 0.92), ("REGISTRY", 0.90))


def link_artifacts(dependencies: DataFrame, index: DataFrame) -> DataFrame:
    """I-27: ``index(source, artifact_key, linked_service_id)``, keys ``group:artifact`` or ``artifact``.

    The surest source first, ``group:artifact`` before ``artifact``; never a service to itself.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for i, (s, _) in enumerate(LINK_SOURCES) for x in (s, i))), F.col("source"))
    sure = F.element_at(F.create_map(*(F.lit(x) for s, c in LINK_SOURCES for x in (s, c))), F.col("source"))
    known = index.withColumn("rank", rank).withColumn("link_confidence", sure)
    keys = dependencies.select(
        "*", F.posexplode(F.array(F.concat_ws(":", "to_group", "to_artifact"), F.col("to_artifact"))).alias("key_order", "artifact_key")
    )
    hits = keys.join(known, "artifact_key").filter("linked_service_id <> service_id")
    best = distinct_on(hits, ["dependency_id"], [F.asc("key_order"), F.asc("rank"), F.asc("linked_service_id")])
    return dependencies.join(best.select("dependency_id", "linked_service_id", F.col("source").alias("link_source"), "link_confidence"), "dependency_id", "left")


def backfill_links(dependencies: DataFrame, linked: DataFrame) -> DataFrame:
    """I-28: links that changed, onto dependencies that have columns of these names."""
    new = linked.select("dependency_id", F.col("linked_service_id").alias("__s"), F.col("link_source").alias("__l"))
    joined = dependencies.join(new, "dependency_id", "left")
    changed = F.col("__s").isNotNull() & ~F.col("__s").eqNullSafe(F.col("linked_service_id"))
    return update_where(joined, changed, {"link_source": F.col("__l"), "linked_service_id": F.col("__s")}).select(*dependencies.columns)


def register(registry: DataFrame, services: DataFrame) -> DataFrame:
    """F-46, B-04: new or known by (org_id, repo, service_name); known ones keep their id and are enabled again."""
    return upsert(registry, services, ["org_id", "repo", "service_name"], [c for c in registry.columns if c not in ("service_id", "org_id", "repo", "service_name")])


def unregister(registry: DataFrame, service_id: str) -> DataFrame:
    """F-46: a soft delete."""
    return update_where(registry, F.col("service_id") == service_id, {"enabled": F.lit(False)})


def workspace_entries(own: DataFrame, file: DataFrame, org_id: str, key: str) -> DataFrame:
    """F-47: an organisation's rows and the file's, by id, its own winning; the file's alone where it has none."""
    mine = own.filter(F.col("org_id") == org_id)
    both = mine.withColumn("__r", F.lit(0)).unionByName(file.withColumn("__r", F.lit(1)))
    return distinct_on(both, [key], [F.asc("__r")]).drop("__r")


def index_profile(repos: DataFrame, libraries: DataFrame, modules: DataFrame) -> DataFrame:
    """F-47: ``repo, kind, profile_id``: a library or module named outright, else by repository, libraries first."""
    parts: Sequence[DataFrame] = [
        repos.join(libraries.select(F.col("library_id").alias("asked"), F.col("library_id").alias("profile_id")), "asked").select("repo", F.lit("LIBRARY").alias("kind"), "profile_id", F.lit(0).alias("rank")),
        repos.join(modules.select(F.col("module_id").alias("asked"), F.col("module_id").alias("profile_id")), "asked").select("repo", F.lit("MODULE"), "profile_id", F.lit(1)),
        repos.join(libraries.select("repo", F.col("library_id").alias("profile_id")), "repo").select("repo", F.lit("LIBRARY"), "profile_id", F.lit(2)),
        repos.join(modules.select("repo", F.col("module_id").alias("profile_id")), "repo").select("repo", F.lit("MODULE"), "profile_id", F.lit(3)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return distinct_on(out, ["repo"], [F.asc("rank"), F.asc("profile_id")]).drop("rank")
