"""Contracts against implementations and tests (F-27 to F-31)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key, normalize_inbound_path
from .relational import distinct_on, latest

INBOUND = ("REST_INBOUND", "WEBHOOK_INBOUND")


def at_latest_commit(facts: DataFrame, keys: tuple[str, ...] = ("service_id",), at: str = "indexed_at") -> DataFrame:
    """F-28: facts of the commit indexed last."""
    newest = latest(facts, list(keys), "commit_sha", at).select(*keys, "commit_sha")
    return facts.join(newest, [*keys, "commit_sha"], "left_semi").select(*facts.columns)


def contract_operations(operations: DataFrame, service_id: str | None = None, domain: str | None = None, catalog: str | None = None) -> DataFrame:
    """F-27: of the organisation's latest contract commit; a catalog service sees its own rows, others those mapped to them."""
    now = at_latest_commit(operations, ("org_id",))
    if service_id:
        column = "service_id" if service_id == catalog else "mapped_service_name"
        now = now.filter(F.col(column) == service_id)
    return now.filter(F.col("domain") == domain) if domain else now


def _keyed(df: DataFrame, method: str, path: str, order: list) -> DataFrame:
    keyed = df.withColumn("match_key", match_key(method, normalize_inbound_path(path)))
    return distinct_on(keyed, ["match_key"], order)


def reconcile(contracts: DataFrame, triggers: DataFrame) -> DataFrame:
    """F-29: ``gap_type, match_key, subject``; of equal keys on a side the first subject by name counts.

    A full anti-join: rows of either side whose key the other side lacks.
    """
    one = _keyed(contracts, "http_method", "path_template", [F.asc("operation_id")]).select("match_key", F.col("operation_id").alias("left_subject"))
    real = triggers.filter(F.col("trigger_kind").isin(*INBOUND) & F.col("http_method").isNotNull() & F.col("path_pattern").isNotNull())
    two = _keyed(real, "http_method", "path_pattern", [F.asc("trigger_id")]).select("match_key", F.col("trigger_id").alias("right_subject"))
    return _apart(one, two, "CONTRACT_ONLY", "IMPLEMENTATION_ONLY")


def test_coverage(contracts: DataFrame, calls: DataFrame) -> DataFrame:
    """F-30: contracts no test calls, and calls no contract has."""
    one = _keyed(contracts, "http_method", "path_template", [F.asc("operation_id")]).select("match_key", F.col("operation_id").alias("left_subject"))
    two = _keyed(calls, "http_method", "path_normalized", [F.asc("test_symbol")]).select("match_key", F.col("test_symbol").alias("right_subject"))
    return _apart(one, two, "CONTRACT_UNTESTED", "TEST_UNDOCUMENTED")


def _apart(one: DataFrame, two: DataFrame, left: str, right: str) -> DataFrame:
    both = one.join(two, "match_key", "full")
    gap = F.when(F.col("right_subject").isNull(), left).when(F.col("left_subject").isNull(), right)
    return both.select(gap.alias("gap_type"), "match_key", F.coalesce("left_subject", "right_subject").alias("subject")).filter("gap_type IS NOT NULL")


def link_entries(contracts: DataFrame, registry: DataFrame, runs: DataFrame, triggers: DataFrame) -> DataFrame:
    """F-31: ``operation_id, status, trigger_id``, with the first trigger by name where one matches."""
    own = contracts.withColumn("match_key", match_key("http_method", normalize_inbound_path("path_template")))
    services = registry.groupBy(F.col("service_name").alias("mapped_service_name")).agg(F.min("service_id").alias("found_service"))
    indexed = runs.filter("status = 'COMPLETE'").select(F.col("service_id").alias("found_service")).distinct().withColumn("indexed", F.lit(True))
    first = (
        triggers.filter(F.col("trigger_kind").isin(*INBOUND))
        .withColumn("match_key", match_key("http_method", normalize_inbound_path("path_pattern")))
        .groupBy(F.col("service_id").alias("found_service"), "match_key")
        .agg(F.min("trigger_id").alias("trigger_id"))
    )
    out = own.join(services, "mapped_service_name", "left").join(indexed, "found_service", "left").join(first, ["found_service", "match_key"], "left")
    status = (
        F.when(F.coalesce(F.trim("mapped_service_name"), F.lit("")) == "", "NO_MAPPED_SERVICE")
        .when(F.col("found_service").isNull(), "SERVICE_NOT_REGISTERED")
        .when(F.col("indexed").isNull(), "IMPLEMENTATION_NOT_INDEXED")
        .when(F.col("trigger_id").isNotNull(), "MATCHED")
        .otherwise("NO_HANDLER")
    )
    return out.select("operation_id", status.alias("status"), F.when(status == "MATCHED", F.col("trigger_id")).alias("trigger_id"))
