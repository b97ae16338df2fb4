"""Facts of a service at a commit, and batches of them committed as one (I-15, B-10).

A batch is many tables.  Each is written under a folder of its own, which
nothing refers to yet; then one manifest, the next in number, names the folders
of all tables and scopes.  Readers take the newest whole manifest, so they see a
batch's tables all at once or not at all, and a write that fails anywhere leaves
what was readable.  A batch takes the place of earlier ones of its scope by the
manifest alone.  A batch id that the manifest already has changes nothing.
Folders that no manifest names are left for the cluster to clean.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import module_name
from ..operators import access_links, class_links
from ..operators.relational import distinct_on
from ..session import staged
from . import config, extract


def index_facts(files: DataFrame, pubsub_rules: DataFrame | None = None, kafka_rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of facts from ``files(service_id, path, text)``, by name, in the order in which they need each other.

    Sources are read once and settings once.  Topics get their classes before
    anything refers to them; accesses by handlers, to Mongo and to BigQuery are
    merged by their confidence.
    """
    sources = files.filter(F.col("path").rlike(r"\.(java|kt)$"))
    parsed = extract.light_parse(sources)
    production = parsed.filter(~F.col("path").rlike("(^|/)src/test/"))
    services = files.select("service_id", "path").distinct()
    topics = extract.yaml_topics(config.config_entries(files)).join(services, "path")
    resources = topics.select(
        F.xxhash64("service_id", "path", "key").alias("resource_id"), "service_id", "path", "resource_kind", "short_id", "role", F.col("key").alias("spring_key"), module_name("path").alias("module_name"),
        F.when(F.contains("key", F.lit("kafka.topics")), '{"transport":"KAFKA"}').otherwise("{}").alias("attributes"), F.lit(None).cast("string").alias("linked_class_fqn"),
        F.lit(None).cast("string").alias("linked_method"), F.lit("YAML").alias("evidence_source"), "confidence",
    )
    objects = extract.entities(parsed).withColumns({"domain_fqn": F.lit(None).cast("string"), "catalog": F.lit(None).cast("string"), "evidence_source": F.lit("ENTITY_ANNOTATION"), "confidence": F.lit(0.9)})
    repositories = access_links.repository_links(parsed)
    objects = staged(access_links.with_mirrors(access_links.with_repositories(objects, repositories), access_links.mirrors(parsed), repositories), "facts-objects")
    methods = staged(access_links.accessor_methods(parsed, objects), "facts-methods")
    none = services.select("service_id").limit(0)
    return {
        "symbol_facts": extract.symbol_facts(parsed),
        "outbound_call_facts": extract.client_calls(parsed),
        "peripheral_facts": extract.peripherals(files.filter(F.endswith("path", F.lit(".java")))),
        "unsupported_construct_facts": extract.unsupported(sources, parsed),
        "pubsub_resource_facts": class_links.link_resources(resources, class_links.message_classes(parsed), pubsub_rules, kafka_rules),
        "data_object_facts": objects,
        "accessor_method_facts": methods,
        "data_access_facts": access_links.all_accesses(production, methods, objects, none),
        "flow_gate_facts": extract.flow_gates(parsed),
        "entry_trigger_facts": extract.triggers(parsed),
        "message_schema_facts": extract.proto_schemas(files),
        "maven_module_facts": extract.pom_modules(files),
        "maven_dependency_facts": extract.pom_dependencies(files),
    }


def merged_outbound(*ranked: DataFrame) -> DataFrame:
    """Outbound calls of several finders: of one source, verb and path the first finder's stays."""
    keys = ["service_id", "source_symbol", "http_method", "path_text"]
    every = reduce(DataFrame.unionByName, (df.withColumn("__rank", F.lit(i)) for i, df in enumerate(ranked)))
    return distinct_on(every, keys, [F.asc("__rank"), F.asc("client")]).drop("__rank")


class _Folder:
    """Small files beside the tables, by the file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.path = self.jvm.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def create(self, name: str, text: str) -> None:
        """Fails where the file is there already."""
        out = self.fs.create(self.jvm.Path(self.path, name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def _newest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest manifest that is whole; 0 and an empty one before the first."""
    names = [n for n in _Folder(spark, f"{root}/manifests").names() if n.endswith(".json")]
    for name in reversed(names):
        rows = spark.read.text(f"{root}/manifests/{name}", wholetext=True).collect()
        try:
            return int(name[:-5]), json.loads(rows[0][0])
        except (IndexError, ValueError):
            continue  # its writer ended while writing
    return 0, {"batches": [], "tables": {}}


def write_batch(spark: SparkSession, root: str, batch_id: str, scope: dict[str, str], tables: dict[str, DataFrame]) -> bool:
    """Write ``tables`` as the state of ``scope`` (say, a service and commit); false where the batch was written before.

    Of two writers at a time one creates the manifest of the next number; the
    other gets an error and may try again.
    """
    number, now = _newest(spark, root)
    if batch_id in now["batches"]:
        return False
    key = json.dumps(scope, sort_keys=True)
    after: dict[str, dict[str, dict]] = {name: {k: v for k, v in parts.items() if k != key} for name, parts in now["tables"].items()}
    for name, df in tables.items():
        path = f"{root}/data/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        after.setdefault(name, {})[key] = {"path": path, "schema": df.schema.json()}
    text = json.dumps({"batches": [*now["batches"], batch_id], "tables": after})
    taken = [int(n[:-5]) for n in _Folder(spark, f"{root}/manifests").names() if n.endswith(".json")]
    if taken and max(taken) > number and _newest(spark, root)[0] != number:
        raise RuntimeError("another batch was committed meanwhile: write this one again")
    _Folder(spark, f"{root}/manifests").create(f"{max([number, *taken]) + 1:012d}.json", text)
    return True


def read_table(spark: SparkSession, root: str, name: str, **scope: str) -> DataFrame:
    """A table as of the newest manifest, with the scope of each row as columns; with ``scope``, of those scopes alone."""
    from pyspark.sql.types import StructType

    parts = _newest(spark, root)[1]["tables"].get(name, {})
    found = []
    for key, part in sorted(parts.items()):
        own = json.loads(key)
        if all(own.get(k) == v for k, v in scope.items()):
            df = spark.read.schema(StructType.fromJson(json.loads(part["schema"]))).parquet(part["path"])
            found.append(df.withColumns({f"scope_{k}": F.lit(v) for k, v in own.items()}))
    if not found:
        raise ValueError(f"no batch has {name} of {scope or 'any scope'}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
