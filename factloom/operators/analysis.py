"""Freshness, gaps, impact and upkeep (E-01 to E-17)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_part, freshness_http, simple_name, test_name_keys
from .relational import delete_scoped, distinct_on, latest
from .traverse import reverse_reachability

STALE_MINUTES = 60


def freshness_of(status: Column | str, completed: Column | str, as_of: dt.datetime | Column, minutes: int = STALE_MINUTES) -> Column:
    """E-01: the state of a latest run; a completed run is current strictly after ``as_of`` minus the threshold."""
    status, completed = (F.col(x) if isinstance(x, str) else x for x in (status, completed))
    since = (as_of if isinstance(as_of, Column) else F.lit(as_of)) - F.expr(f"INTERVAL {minutes} MINUTES")
    return (
        F.when(status.isNull(), "NOT_INDEXED")
        .when(status.isin("RUNNING", "QUEUED"), "INDEXING")
        .when((status != "COMPLETE") | completed.isNull(), "NOT_INDEXED")
        .when(completed > since, "CURRENT")
        .otherwise("STALE")
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run enqueued last of each service; ties take the largest job id."""
    rest = [c for c in runs.columns if c not in ("service_id", "enqueued_at", "job_id")]
    newest = runs.groupBy("service_id").agg(F.max(F.struct("enqueued_at", "job_id", *rest)).alias("__r"))
    return newest.select("service_id", "__r.*")


def freshness(services: DataFrame, runs: DataFrame, as_of: dt.datetime | Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """E-01, E-03: ``service_id, status, freshness, http_status`` for each service."""
    joined = services.select("service_id").join(latest_runs(runs), "service_id", "left")
    out = joined.withColumn("freshness", freshness_of("status", "completed_at", as_of, minutes))
    return out.select("service_id", "status", "freshness", freshness_http("freshness").alias("http_status"))


def org_status(registry: DataFrame, runs: DataFrame, as_of: dt.datetime | Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """E-02: enabled services with their state, by organisation and repository."""
    live = registry.filter("enabled")
    return live.select("service_id", "org_id", "repo").join(freshness(live, runs, as_of, minutes), "service_id").orderBy("org_id", "repo", "service_id")


def job_status(runs: DataFrame, job_id: str) -> DataFrame:
    """E-03."""
    return runs.filter(F.col("job_id") == job_id)


def indexed_commits(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """E-04: of the (service_id, commit) asked for, exact or as a beginning, those with a complete run."""
    done = runs.filter("status = 'COMPLETE'").select("service_id", "commit_sha").distinct()
    hit = wanted.join(done, "service_id").filter(F.startswith("commit_sha", F.col("commit")))
    return hit.groupBy("service_id", "commit").agg(F.min("commit_sha").alias("commit_sha"))


def latest_commits(runs: DataFrame) -> DataFrame:
    """The commit of each service's last complete run."""
    done = runs.filter("status = 'COMPLETE'").select("service_id", "commit_sha", "completed_at")
    return latest(done, ["service_id"], "commit_sha", "completed_at").select("service_id", "commit_sha")


def untested_classes(classes: DataFrame, tests: DataFrame) -> DataFrame:
    """Classes ``(service_id, symbol_fqn)`` without a test by name: an anti-join on three names, and one on the ``Test`` prefix.

    A test called ``TestX...`` belongs to any class whose name its rest starts
    with, so its rest is cut to each length; every class meets it by equality.
    """
    names = tests.select("service_id", simple_name("symbol_fqn").alias("test")).distinct()
    rest = F.expr("substring(test, 5)")
    begun = names.filter(F.startswith("test", F.lit("Test")) & (F.length(rest) > 0))
    prefixes = begun.select("service_id", F.explode(F.transform(F.sequence(F.lit(1), F.length(rest)), lambda n: F.substr(rest, F.lit(1), n))).alias("simple"))
    own = classes.withColumn("simple", simple_name("symbol_fqn"))
    keyed = own.select("service_id", "simple").distinct().select("service_id", "simple", F.explode(test_name_keys("simple")).alias("test"))
    named = keyed.join(names, ["service_id", "test"], "left_semi").select("service_id", "simple")
    tested = named.union(prefixes).distinct()
    return own.join(tested, ["service_id", "simple"], "left_anti").select(*classes.columns)


def gap_report(symbols: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E-05: untested production classes with a kind, and counts by service, at each service's latest complete commit."""
    now = symbols.filter("symbol_kind = 'CLASS'").join(latest_commits(runs), ["service_id", "commit_sha"], "left_semi")
    unique = now.select("service_id", "symbol_fqn", "file_path").distinct()
    is_test = simple_name("symbol_fqn").rlike("(Test|Tests|IT)$") | F.contains("file_path", F.lit("src/test/java/"))
    production = unique.filter(F.contains("file_path", F.lit("src/main/java/"))).select("service_id", "symbol_fqn").distinct()
    tests = unique.filter(is_test).select("service_id", "symbol_fqn").distinct()
    gaps = untested_classes(production, tests).withColumn("gap_kind", F.when(F.contains(simple_name("symbol_fqn"), F.lit("Controller")), "CONTROLLER").otherwise("CLASS"))
    counts = (
        production.groupBy("service_id").agg(F.count("*").alias("classes"))
        .join(gaps.groupBy("service_id").agg(F.count("*").alias("untested")), "service_id", "left")
        .select("service_id", "classes", F.coalesce("untested", F.lit(0)).alias("untested"))
    )
    return gaps, counts


def changed_symbols(symbols: DataFrame, service_id: str, commit_sha: str) -> DataFrame:
    """E-06."""
    hit = symbols.filter((F.col("service_id") == service_id) & (F.col("commit_sha") == commit_sha))
    return hit.select("service_id", "symbol_fqn", "symbol_kind", "file_path", "attributes").orderBy("symbol_kind", "symbol_fqn")


def affected_consumers(changed: DataFrame, nodes: DataFrame, edges: DataFrame, registry: DataFrame, outbound: DataFrame) -> DataFrame:
    """E-07: what reaches a changed symbol in the graph, and other services that call its endpoints; all symbols at once."""
    seeds = changed.join(nodes.select("id", F.col("symbol_fqn")), "symbol_fqn").select(F.col("symbol_fqn").alias("seed"), F.col("id").alias("node")).distinct()
    reached = reverse_reachability(nodes, edges, seeds)
    names = registry.groupBy("service_name").agg(F.min("service_id").alias("owner_id"))
    graph = (
        reached.join(nodes.select(F.col("id").alias("node"), "service", "node_type", F.col("symbol_fqn").alias("consumer")), "node")
        .join(names, F.col("service") == F.col("service_name"), "left")
        .select("seed", F.coalesce("owner_id", "service").alias("consumer_service"), F.coalesce("consumer", "node").alias("consumer"), "node_type", F.lit("GRAPH").alias("via"))
    )
    ends = changed.filter("symbol_kind = 'ENDPOINT'").select(
        F.col("symbol_fqn").alias("seed"), F.col("service_id").alias("own"),
        F.get_json_object("attributes", "$.httpMethod").alias("http_method"), F.get_json_object("attributes", "$.path").alias("path"),
    )
    calls = outbound.join(ends, ["http_method", "path"]).filter("service_id <> own")
    direct = calls.select("seed", F.col("service_id").alias("consumer_service"), F.col("source_symbol").alias("consumer"), F.lit("ENDPOINT").alias("node_type"), F.lit("OUTBOUND_CALL").alias("via"))
    return graph.union(direct).distinct()


def downstream_calls(changed: DataFrame, outbound: DataFrame) -> DataFrame:
    """E-08."""
    keys = changed.select("service_id", class_part("symbol_fqn").alias("__c")).distinct()
    calls = outbound.filter("http_method IS NOT NULL").withColumn("__c", class_part("source_symbol"))
    return calls.join(keys, ["service_id", "__c"], "left_semi").select(*outbound.columns)


def downstream_external(changed: DataFrame, endpoints: DataFrame) -> DataFrame:
    """E-09."""
    keys = changed.select("service_id", class_part("symbol_fqn").alias("caller_class_fqn")).distinct()
    return endpoints.join(keys, ["service_id", "caller_class_fqn"], "left_semi").select(*endpoints.columns).distinct()


def test_suggestions(changed: DataFrame, consumers: DataFrame, external: DataFrame, tests: DataFrame) -> DataFrame:
    """E-10: ``kind, subject, test, exists``: unit tests by name or one to be written, integration tests of consumers, external contracts."""
    classes = changed.filter("symbol_kind = 'CLASS'").select("service_id", "symbol_fqn", simple_name("symbol_fqn").alias("simple"))
    names = tests.select("service_id", F.col("symbol_fqn").alias("test_fqn"), simple_name("symbol_fqn").alias("test_name"))
    # by equal names: the three a class may have, and what may stand after "Test" in a test's own name
    exact = classes.withColumn("test_name", F.explode(test_name_keys("simple"))).join(names, ["service_id", "test_name"])
    starts = names.filter(F.startswith("test_name", F.lit("Test"))).withColumn(
        "simple", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("test_name") - 4, F.lit(1))), lambda n: F.substr("test_name", F.lit(5), n)))
    )
    like = classes.join(starts, ["service_id", "simple"])
    columns = ("service_id", "symbol_fqn", "test_fqn")
    matched = exact.select(*columns).union(like.select(*columns)).distinct()
    unit = matched.select(F.lit("UNIT").alias("kind"), F.col("symbol_fqn").alias("subject"), F.col("test_fqn").alias("test"), F.lit(True).alias("exists"))
    missing = classes.join(matched.select("symbol_fqn").distinct(), "symbol_fqn", "left_anti").select(
        F.lit("UNIT"), "symbol_fqn", F.concat("simple", F.lit("Test")), F.lit(False)
    )
    integration = names.filter(F.contains("test_name", F.lit("Integration")) | F.endswith("test_name", F.lit("IT")))
    wanted = consumers.select(F.col("consumer_service").alias("service_id"), F.col("consumer").alias("subject")).distinct()
    through = wanted.join(integration, "service_id").select(F.lit("INTEGRATION"), "subject", "test_fqn", F.lit(True))
    contracts = external.select(F.lit("EXTERNAL"), F.col("endpoint_id"), F.concat("endpoint_id", F.lit("ContractTest")), F.lit(False))
    return unit.union(missing).union(through).union(contracts).distinct()


def missing_tests(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """E-11."""
    classes = changed.filter((F.col("symbol_kind") == "CLASS") & ~F.contains("file_path", F.lit("src/test/java")))
    return untested_classes(classes.select("service_id", "symbol_fqn").distinct(), tests)


def artifact_impact(dependencies: DataFrame, runs: DataFrame, service_id: str, commit_sha: str) -> DataFrame:
    """E-12: changed dependency versions and the other services that hold another one.

    ``dependencies(service_id, commit_sha, to_group, to_artifact, to_version, resolved)``.
    """
    key = ["to_group", "to_artifact"]
    now = dependencies.filter((F.col("service_id") == service_id) & (F.col("commit_sha") == commit_sha) & F.col("resolved")).select(*key, F.col("to_version").alias("version")).distinct()
    before_run = latest_commits(runs.filter((F.col("service_id") == service_id) & (F.col("commit_sha") != commit_sha)))
    before = dependencies.join(before_run, ["service_id", "commit_sha"], "left_semi").groupBy(*key).agg(F.min("to_version").alias("previous"))
    others = dependencies.filter(F.col("service_id") != service_id).join(latest_commits(runs), ["service_id", "commit_sha"], "left_semi")
    pinned = now.join(others.select(*key, F.col("service_id").alias("other"), "to_version"), key).filter("to_version <> version")
    downstream = pinned.groupBy(*key, "version").agg(F.sort_array(F.collect_set("other")).alias("downstream"))
    out = now.join(before, key, "left").join(downstream, [*key, "version"], "left")
    changed = F.col("previous").isNull() | (F.col("previous") != F.col("version"))
    return out.filter(changed & (F.col("previous").isNotNull() | F.col("downstream").isNotNull()))


def impact_report(tables: Mapping[str, DataFrame], service_id: str, commit_sha: str) -> dict[str, DataFrame]:
    """E-13: the parts by name."""
    changed = changed_symbols(tables["symbols"], service_id, commit_sha)
    consumers = affected_consumers(changed, tables["nodes"], tables["edges"], tables["registry"], tables["outbound"])
    external = downstream_external(changed, tables["external"])
    tests = tables["symbols"].filter(F.contains("file_path", F.lit("src/test/java/")) | simple_name("symbol_fqn").rlike("(Test|IT)$"))
    return {
        "changed": changed,
        "consumers": consumers,
        "downstream": downstream_calls(changed, tables["outbound"]),
        "external": external,
        "suggestions": test_suggestions(changed, consumers, external, tests),
        "missing": missing_tests(changed, tests),
        "artifacts": artifact_impact(tables["dependencies"], tables["runs"], service_id, commit_sha),
    }


def service_description(registry: DataFrame) -> DataFrame:
    """E-14: descriptive fields of the metadata, null where blank."""
    field = lambda f: F.nullif(F.trim(F.get_json_object("metadata", f"$.{f}")), F.lit("")).alias(f)
    return registry.select("service_id", field("description"), field("owner"), field("domain"))


def pr_comment(report: Mapping[str, DataFrame], most: int = 20) -> str:
    """E-15: markdown with the first rows of each part."""
    lines = ["## Impact"]
    for name, df in report.items():
        rows = df.limit(most + 1).collect()
        if rows:
            lines += [f"### {name}", *(f"- {', '.join(str(v) for v in r)}" for r in rows[:most]), *(["- and more"] if len(rows) > most else [])]
    return "\n".join(lines)


#: What clearing messaging alone removes.
MESSAGING_TABLES = ("pubsub_resource_facts", "message_schema_facts", "data_access_facts", "flow_gate_facts", "validation_hint_facts")


def clear_index(tables: Mapping[str, DataFrame], scope: str, key: str) -> dict[str, DataFrame]:
    """E-16: SERVICE and ORG clear every table, MESSAGING a service's messaging facts."""
    if scope == "ORG":
        return delete_scoped(tables, org_id=key)
    hit = tables if scope == "SERVICE" else {k: v for k, v in tables.items() if k in MESSAGING_TABLES}
    return dict(tables) | delete_scoped(hit, service_id=key)


def replayable(runs: DataFrame) -> DataFrame:
    """E-17: dead-lettered jobs, queued again with a first attempt."""
    return runs.filter("status = 'DLQ'").withColumns({"status": F.lit("QUEUED"), "attempt": F.lit(1).cast("short")})


def newest_tests(tests: DataFrame) -> DataFrame:
    """Each test class once, at its last indexing."""
    return distinct_on(tests, ["service_id", "symbol_fqn"], [F.desc("indexed_at"), F.asc("file_path")])
