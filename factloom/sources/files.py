"""Source trees as DataFrames (B-01, B-05, B-06, B-09, B-11, B-14, B-17)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = "path string, text string"


def read_tree(spark: SparkSession, root: str, pattern: str = "*.{java,kt,sql,cql,json,xml,proto,yaml,yml}") -> DataFrame:
    """B-01: ``path, text`` of files under ``root``, paths relative to it; bytes that aren't UTF-8 are read as Windows-1252."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    # Spark has no Windows-1252; it is Latin-1 but for the bytes 0x80 to 0x9F
    here = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
    latin = F.translate(F.decode("content", "iso-8859-1"), "".join(here), "".join(here.values()))
    text = F.when(utf8, F.col("content").cast("string")).otherwise(latin)
    return files.select(F.regexp_replace("path", f"^.*{root.rstrip('/')}/", "").alias("path"), text.alias("text"))


def under_roots(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """B-01: files in one of the source roots."""
    hit = F.lit(False)
    for r in roots:
        hit = hit | F.startswith("path", F.lit(r.rstrip("/") + "/"))
    return files.filter(hit)


def build_tool(files: DataFrame) -> DataFrame:
    """B-01: one row: MAVEN, GRADLE or UNKNOWN, by the build files there are."""
    has = lambda p: F.max(F.col("path").rlike(p))
    return files.agg(F.when(has(r"(^|/)pom\.xml$"), "MAVEN").when(has(r"(^|/)build\.gradle(\.kts)?$"), "GRADLE").otherwise("UNKNOWN").alias("build_tool"))


def is_config(path: Column | str) -> Column:
    """B-05: proto files, and YAML of manifests, cron jobs and application settings."""
    p = F.col(path) if isinstance(path, str) else path
    yaml = p.rlike(r"\.ya?ml$") & p.rlike(r"(^|/)(k8s|cronjobs?)/|src/main/resources/application[^/]*\.ya?ml$|application-[a-z0-9]+\.ya?ml$")
    return p.endswith(".proto") | yaml


def is_pom(path: Column | str, roots: Sequence[str] = ()) -> Column:
    """B-06: any POM, or the root's and those under the roots."""
    p = F.col(path) if isinstance(path, str) else path
    pom = p.rlike(r"(^|/)pom\.xml$")
    if not roots:
        return pom
    inside = p == "pom.xml"
    for r in roots:
        inside = inside | p.startswith(r.rstrip("/") + "/")
    return pom & inside


def webhook_jobs(bodies: DataFrame) -> DataFrame:
    """B-09: landed bodies ``(event, body)`` as events; only pull requests that open or change, and branch pushes."""
    get = lambda p: F.get_json_object("body", p)
    pull = (F.col("event") == "pull_request") & get("$.action").isin("opened", "synchronize", "reopened")
    push = (F.col("event") == "push") & F.startswith(F.coalesce(get("$.ref"), F.lit("")), F.lit("refs/heads/"))
    return bodies.filter(pull | push).select(
        "event",
        get("$.repository.full_name").alias("repo"),
        F.coalesce(get("$.pull_request.head.sha"), get("$.after")).alias("commit_sha"),
        F.when(F.col("event") == "push", F.array_distinct(F.flatten(F.transform(
            F.from_json(get("$.commits"), "array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"),
            lambda c: F.concat(*(F.coalesce(c[k], F.array().cast("array<string>")) for k in ("added", "modified", "removed"))),
        )))).alias("changed_files"),
    )


def signature_ok(body: bytes, signature: str | None, secret: str) -> bool:
    """B-09: whether a webhook's signature header is that of its body."""
    import hmac

    wanted = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return signature is not None and hmac.compare_digest(wanted, signature)


def document_chunks(models: DataFrame, most_chars: int = 12_000_000, largest: int = 16_000_000) -> DataFrame:
    """B-11: ``service_id, file_path, chunk``: models in order of path, a new chunk after each ``most_chars``; larger ones are left out."""
    fit = models.filter(F.length("model_json") <= largest)
    before = Window.partitionBy("service_id").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    return fit.select("service_id", "file_path", F.floor(F.coalesce(F.sum(F.length("model_json")).over(before), F.lit(0)) / most_chars).cast("int").alias("chunk"))


EVENTS_KEPT = 200


def recent_events(events: DataFrame, after: object = None, limit: int = EVENTS_KEPT) -> DataFrame:
    """B-14: the newest events after a time, exclusive, in order."""
    df = events if after is None else events.filter(F.col("ts") > after)
    return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(limit, EVENTS_KEPT)).orderBy("ts", "event_id")


def rules_version(rules: bytes) -> str:
    """B-17: what tells one state of a rule pack from another."""
    return hashlib.sha256(rules).hexdigest()[:16]


def load_rules(spark: SparkSession, text: str) -> dict[str, list]:
    """B-17: a rule pack from YAML, if a YAML library is there, or JSON."""
    import json

    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)
