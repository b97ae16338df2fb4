"""What handlers read and write: accessors, their entities, and a ladder of fallbacks (I-09, I-10, I-16).

A path leads from a handler's call over the field it is made on to the field's
type, from there to the catalog's row of that accessor and method, and on to the
entity's table.  Each step is an equi-join that narrows the one before, and a
call whose path ends early keeps what it has at a lower confidence:
HANDLER_LINKER+CATALOG with an entity 0.93, without one 0.80, no accessor in the
catalog HANDLER_LINKER 0.80, and where the service has pinned catalogs that
failed it, HANDLER_WITHOUT_CATALOG 0.75.

Sources come from :func:`factloom.sources.extract.light_parse`; entities are
``(service_id, entity_fqn, domain_fqn, store_type, physical_name, catalog)`` and
accessor methods what :func:`accessor_methods` returns.  Where a catalog has two
rows for one name, the smallest is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import operation_of, simple_name, store_type
from ..session import staged
from ..sources.extract import _main, _members, _plain_type, annotation_value, calls
from .relational import distinct_on

#: Into so many shares the calls of one service are split.
SHARES = 64
_REPOSITORIES = r"(?:JpaRepository|MongoRepository|CassandraRepository|BaseNoSqlRepository)<\s*(\w+)"
_NO_SQL = r"(?:CassandraRepository|BaseNoSqlRepository)<\s*(\w+)"
ACCESSOR_METHOD = ("service_id", "accessor_kind", "accessor_fqn", "method_name", "operation", "entity_fqn", "domain_fqn", "store_type", "physical_name", "evidence_source", "confidence")
ACCESS = (
    "service_id", "handler_class_fqn", "handler_method", "operation", "store_type", "table_or_entity", "field", "dao_method", "entity_fqn", "domain_fqn", "accessor_fqn", "accessor_kind",
    "catalog", "evidence_source", "confidence",
)


def qualified(name: Column, imports: Column, package: Column, same_package: bool = True) -> Column:
    """Full name of a type: as written with dots, by its import, else of the same package (or null)."""
    plain = _plain_type(name)
    hit = F.get(F.filter(imports, lambda i: F.endswith(i, F.concat(F.lit("."), plain))), 0)
    own = F.when(F.coalesce(package, F.lit("")) == "", plain).otherwise(F.concat_ws(".", package, plain)) if same_package else F.lit(None).cast("string")
    return F.when(F.contains(plain, F.lit(".")), plain).otherwise(F.coalesce(hit, own))


def snake(name: Column) -> Column:
    """An underscore before each capital but the first."""
    return F.lower(F.regexp_replace(name, "(?<=.)([A-Z])", "_$1"))


def kind_of(accessor: Column) -> Column:
    return F.when(accessor.rlike("Dao$"), "DAO").when(accessor.rlike("(Repository|Repo)$"), "REPO").when(F.contains(accessor, F.lit("Template")), "TEMPLATE").otherwise("ACCESSOR")


def repository_links(parsed: DataFrame) -> DataFrame:
    """I-16: ``service_id, accessor_fqn, entity_fqn, store_type`` of interfaces that extend a repository of an entity."""
    main = _main(parsed)
    extended = F.array_join(main["extended"], ",")
    entity = F.regexp_extract(extended, _REPOSITORIES, 1)
    rows = parsed.filter((main["kind"] == "interface") & (entity != ""))
    store = F.when(F.contains(extended, F.lit("MongoRepository")), "MONGODB").when(extended.rlike("CassandraRepository|BaseNoSqlRepository"), "CASSANDRA").otherwise(store_type("class_fqn"))
    return rows.select("service_id", F.col("class_fqn").alias("accessor_fqn"), qualified(entity, F.col("imports"), F.col("package")).alias("entity_fqn"), store.alias("store_type"))


def with_repositories(entities: DataFrame, links: DataFrame) -> DataFrame:
    """I-16: entities with the repositories made for them in ``accessors``; a repository is evidence of 0.92 at least."""
    made = links.groupBy("service_id", "entity_fqn").agg(F.sort_array(F.collect_set("accessor_fqn")).alias("__made"))
    out = entities.join(made, ["service_id", "entity_fqn"], "left")
    known = F.col("__made").isNotNull()
    own = {
        "evidence_source": F.when(known, F.concat_ws("+", "evidence_source", F.lit("REPO_GENERIC"))).otherwise(F.col("evidence_source")),
        "confidence": F.when(known, F.greatest("confidence", F.lit(0.92))).otherwise(F.col("confidence")),
    }
    return out.select(*((own[c] if c in own else F.col(c)).alias(c) for c in entities.columns), F.coalesce("__made", F.array().cast("array<string>")).alias("accessors"))


def _first(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the smallest."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def dao_methods(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """I-16: methods of ``...Dao`` and ``...DaoImpl`` types under the interface's name.

    A parameter is of the domain if a mapping method of the implementation takes
    it (``XEntity mapDomainToEntity(X x)``, or the way back), or by its package.
    Its entity comes from the mapping, else from the catalog, else from a
    mapping in the same method that a repository saves: 0.93 with an entity,
    0.80 with a domain type, 0.75 with neither.
    """
    main = _main(parsed)
    simple = simple_name("class_fqn")
    dao = parsed.filter(simple.rlike("Dao(Impl)?$"))
    one = F.get(main["implemented"], 0)
    named = dao.select("service_id", "class_fqn", F.when(one.isNotNull(), qualified(one, F.col("imports"), F.col("package"))).alias("face"))
    # an implementation that names no interface takes the Dao of its name
    faces = named.filter(simple_name("class_fqn").rlike("Dao$")).groupBy("service_id", simple_name("class_fqn").alias("short")).agg(F.min("class_fqn").alias("by_name"))
    accessor = F.coalesce("face", F.when(simple_name("class_fqn").rlike("Dao$"), F.col("class_fqn")), "by_name")
    of = named.withColumn("short", F.regexp_replace(simple_name("class_fqn"), "Impl$", "")).join(faces, ["service_id", "short"], "left").select("service_id", "class_fqn", accessor.alias("accessor_fqn")).filter("accessor_fqn IS NOT NULL")

    member = parsed.select("service_id", "class_fqn", "package", "imports", F.explode(F.filter("members", lambda m: m["is_primary"] & (m["kind"] == "METHOD"))).alias("m"))
    full = lambda c: qualified(c, F.col("imports"), F.col("package"))
    m = F.col("m")
    param = F.get(m["params"], 0)["type"]
    forth = member.filter((m["name"] == "mapDomainToEntity") & m["type"].rlike("Entity$")).select("service_id", "class_fqn", full(param).alias("domain_fqn"), full(m["type"]).alias("entity_fqn"))
    back = member.filter((m["name"] == "mapEntityToDomain") & param.rlike("Entity$")).select("service_id", "class_fqn", full(m["type"]).alias("domain_fqn"), full(param).alias("entity_fqn"))
    mapped = _first(forth.union(back).join(of, ["service_id", "class_fqn"]).select("service_id", "accessor_fqn", "domain_fqn", F.col("entity_fqn").alias("mapped_entity")), "service_id", "accessor_fqn", "domain_fqn")

    saved = F.exists(m["calls"], lambda c: F.rlike(F.coalesce(c["scope"], F.lit("")), F.lit("(Repo|Repository)$")) & F.rlike(c["name"], F.lit("^(save|delete|insert|update)")))
    local = F.when(saved & F.exists(m["calls"], lambda c: c["name"] == "mapDomainToEntity"), F.lit(True))
    methods = member.join(of, ["service_id", "class_fqn"]).filter(~m["name"].rlike("^_") & ~m["name"].isin("mapDomainToEntity", "mapEntityToDomain"))
    listed = methods.select(
        "service_id", "accessor_fqn", m["name"].alias("method_name"), local.alias("maps_itself"),
        F.explode_outer(F.transform(m["params"], lambda p: F.struct(qualified(p["type"], F.col("imports"), F.col("package")).alias("fqn")))).alias("p"),
    ).select("service_id", "accessor_fqn", "method_name", "maps_itself", F.col("p.fqn").alias("domain_fqn"))
    catalog = _first(entities.filter("domain_fqn IS NOT NULL").select("service_id", "domain_fqn", F.col("entity_fqn").alias("known_entity")), "service_id", "domain_fqn")
    each = listed.join(mapped, ["service_id", "accessor_fqn", "domain_fqn"], "left").join(catalog, ["service_id", "domain_fqn"], "left")
    is_domain = F.col("mapped_entity").isNotNull() | ~F.col("domain_fqn").rlike("Entity$") & F.contains("domain_fqn", F.lit(".domain."))
    only = mapped.groupBy("service_id", "accessor_fqn").agg(F.min("mapped_entity").alias("any_entity"))
    best = each.withColumn("is_domain", F.coalesce(is_domain, F.lit(False))).groupBy("service_id", "accessor_fqn", "method_name").agg(
        F.min(F.when(F.col("is_domain"), F.struct(F.col("mapped_entity").isNull().alias("unmapped"), "domain_fqn", "mapped_entity", "known_entity"))).alias("d"), F.max("maps_itself").alias("maps_itself")
    )
    best = best.join(only, ["service_id", "accessor_fqn"], "left")
    entity = F.coalesce("d.mapped_entity", "d.known_entity", F.when(F.col("maps_itself"), F.col("any_entity")))
    rows = best.select("service_id", "accessor_fqn", "method_name", F.col("d.domain_fqn").alias("domain_fqn"), entity.alias("entity_fqn"))
    tables = _first(entities.select("service_id", "entity_fqn", "store_type", "physical_name"), "service_id", "entity_fqn")
    out = rows.join(tables, ["service_id", "entity_fqn"], "left")
    has = F.col("entity_fqn").isNotNull()
    return out.withColumns({
        "accessor_kind": kind_of(F.col("accessor_fqn")), "operation": operation_of("method_name"), "store_type": F.coalesce("store_type", store_type("accessor_fqn")),
        "evidence_source": F.when(has, "DAO_METHOD+ENTITY").otherwise("DAO_METHOD"), "confidence": F.when(has, 0.93).when(F.col("domain_fqn").isNotNull(), 0.80).otherwise(0.75),
    }).select(*ACCESSOR_METHOD)


def query_methods(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """I-16: methods of Cassandra repositories: annotated queries (0.90), and redeclared save, delete and insert methods (0.88).

    A query's table is its first quoted name; where the repository names no
    entity of the catalog, the table's is taken.
    """
    main = _main(parsed)
    repos = parsed.filter((main["kind"] == "interface") & (F.contains("class_fqn", F.lit(".nosql.")) | F.contains("class_fqn", F.lit("Cassandra"))))
    simple = F.regexp_extract(F.array_join(main["extended"], ","), _NO_SQL, 1)
    package = F.replace(F.concat("package", F.lit(".")), F.lit(".repo."), F.lit(".entities."))
    entity = F.when(simple != "", qualified(simple, F.col("imports"), F.regexp_replace(package, r"\.$", "")))
    each = repos.select("service_id", F.col("class_fqn").alias("accessor_fqn"), entity.alias("of_entity"), F.explode(F.filter("members", lambda m: m["is_primary"] & (m["kind"] == "METHOD"))).alias("m"))
    query = F.get(F.filter("m.annotations", lambda a: a["name"] == "Query"), 0)["args"]
    cql = F.regexp_replace(annotation_value(query, "value"), '^"|"$', "")
    named = F.nullif(F.regexp_extract(F.regexp_replace(cql, r'\\"', '"'), r"""["']([A-Za-z][A-Za-z0-9_]*)["']""", 1), F.lit(""))
    inherited = query.isNull() & F.col("m.name").rlike("^(save$|delete|insert)")
    rows = each.filter(query.isNotNull() | inherited).select(
        "service_id", "accessor_fqn", "of_entity", F.col("m.name").alias("method_name"), named.alias("table"), query.isNotNull().alias("is_query"),
        F.when(query.isNotNull(), F.when(F.upper(F.trim(cql)).rlike("^(UPDATE|INSERT|DELETE)"), "WRITE").otherwise("READ")).otherwise(operation_of("m.name")).alias("operation"),
    )
    by_name = _first(entities.select("service_id", F.col("entity_fqn").alias("of_entity"), F.col("domain_fqn").alias("d1"), F.col("physical_name").alias("p1")), "service_id", "of_entity")
    by_table = _first(entities.filter("physical_name IS NOT NULL").select("service_id", F.col("physical_name").alias("table"), F.col("entity_fqn").alias("e2"), F.col("domain_fqn").alias("d2")), "service_id", "table")
    out = rows.join(by_name, ["service_id", "of_entity"], "left").join(by_table, ["service_id", "table"], "left")
    first = distinct_on(out, ["service_id", "accessor_fqn", "method_name"], [F.desc("is_query"), F.asc_nulls_last("table")])
    return first.select(
        "service_id", F.lit("REPO").alias("accessor_kind"), "accessor_fqn", "method_name", "operation", F.coalesce("of_entity", "e2").alias("entity_fqn"),
        F.when(F.col("p1").isNotNull(), F.col("d1")).otherwise(F.col("d2")).alias("domain_fqn"), F.lit("CASSANDRA").alias("store_type"), F.coalesce("table", "p1").alias("physical_name"),
        F.when(F.col("is_query"), "CASSANDRA_QUERY").otherwise("CASSANDRA_REPO").alias("evidence_source"), F.when(F.col("is_query"), 0.90).otherwise(0.88).alias("confidence"),
    )


def accessor_methods(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """I-16: DAO methods, then those of repositories; of an accessor's method the first stays."""
    both = dao_methods(parsed, entities).withColumn("rank", F.lit(1)).unionByName(query_methods(parsed, entities).withColumn("rank", F.lit(2)))
    return distinct_on(both, ["service_id", "accessor_fqn", "method_name"], [F.asc("rank"), F.desc("confidence")]).select(*ACCESSOR_METHOD)


def mirrors(parsed: DataFrame) -> DataFrame:
    """I-16: ``service_id, accessor_fqn, method_name, table_name, operation, key_fields`` of methods whose writes are copied to BigQuery."""
    each = _members(parsed, "METHOD").select("service_id", "class_fqn", F.col("m.name").alias("method_name"), F.explode("m.annotations").alias("a")).filter("a.name = 'LogForBigQuerySync'")
    table = F.regexp_extract("a.args", 'tableName="([^"]+)"', 1)
    operation = F.coalesce(F.nullif(F.regexp_extract("a.args", r"operation=Operation\.(\w+)", 1), F.lit("")), F.lit("AUTO"))
    keys = F.regexp_extract_all(F.regexp_extract("a.args", r"keyFields=\{([^}]*)\}", 1), F.lit('"([^"]+)"'), F.lit(1))
    return each.filter(table != "").select("service_id", F.col("class_fqn").alias("accessor_fqn"), "method_name", table.alias("table_name"), operation.alias("operation"), keys.alias("key_fields"))


def with_mirrors(entities: DataFrame, mirrored: DataFrame, links: DataFrame) -> DataFrame:
    """I-16: entities with ``mirrors``: tables of the mirrors of their repositories; a mirror without one goes to the entity of its table's name."""
    of = _first(links.select("service_id", "accessor_fqn", F.col("entity_fqn").alias("by_repo")), "service_id", "accessor_fqn")
    tables = entities.groupBy("service_id", F.col("physical_name").alias("table_name")).agg(F.min("entity_fqn").alias("by_table"))
    found = mirrored.join(of, ["service_id", "accessor_fqn"], "left").join(tables, ["service_id", "table_name"], "left")
    found = found.select("service_id", F.coalesce("by_repo", "by_table").alias("entity_fqn"), F.struct("table_name", "operation", "accessor_fqn", "method_name").alias("x")).filter("entity_fqn IS NOT NULL")
    grouped = found.groupBy("service_id", "entity_fqn").agg(F.sort_array(F.collect_set("x")).alias("mirrors"))
    out = entities.join(grouped, ["service_id", "entity_fqn"], "left")
    evidence = F.when(F.col("mirrors").isNotNull(), F.concat_ws("+", "evidence_source", F.lit("BQ_MIRROR"))).otherwise(F.col("evidence_source"))
    return out.select(*((evidence if c == "evidence_source" else F.col(c)).alias(c) for c in entities.columns), "mirrors")


def field_types(parsed: DataFrame) -> DataFrame:
    """``service_id, class_fqn, field, type_fqn`` of fields, and of constructor parameters that no field is named after."""
    kinds = F.filter("members", lambda m: m["is_primary"] & m["kind"].isin("FIELD", "CONSTRUCTOR"))
    m = F.col("m")
    named = F.when(m["kind"] == "FIELD", F.array(F.struct(F.lit(0).alias("rank"), m["name"].alias("name"), m["type"].alias("type")))).otherwise(
        F.transform(m["params"], lambda p: F.struct(F.lit(1).alias("rank"), p["name"].alias("name"), p["type"].alias("type")))
    )
    rows = parsed.select("service_id", "class_fqn", "package", "imports", F.explode(kinds).alias("m")).select("service_id", "class_fqn", "package", "imports", F.explode(named).alias("n"))
    typed = rows.select("service_id", "class_fqn", F.col("n.name").alias("field"), F.col("n.rank").alias("rank"), qualified(F.col("n.type"), F.col("imports"), F.col("package")).alias("type_fqn"))
    return distinct_on(typed, ["service_id", "class_fqn", "field"], [F.asc("rank"), F.asc("type_fqn")]).select("service_id", "class_fqn", "field", "type_fqn")


def _accessor_calls(parsed: DataFrame, field: str, method: str = ".") -> DataFrame:
    """Calls on fields of these names, with the field's type."""
    found = calls(parsed).withColumn("field", F.regexp_extract("scope", r"^(?:this\.)?(\w+)$", 1)).filter(F.col("field").rlike(field) & F.col("called").rlike(method))
    return found.join(field_types(parsed), ["service_id", "class_fqn", "field"])


def handler_accesses(parsed: DataFrame, methods: DataFrame, entities: DataFrame, pinned: DataFrame) -> DataFrame:
    """I-09: a row for each handler, method, accessor and accessor's method; ``pinned(service_id)``: services that have catalogs pinned.

    ``methods`` and ``entities`` may lie in other services (libraries): their
    own ``service_id`` does not count here, names do.
    """
    found = _accessor_calls(parsed, "(Repo|Dao|Repository|Template)$")
    known = _first(methods.select("accessor_fqn", F.col("method_name").alias("called"), "operation", "entity_fqn", "domain_fqn", "store_type", "physical_name"), "accessor_fqn", "called")
    known = known.withColumn("hit", F.lit(True))
    tables = _first(entities.select("entity_fqn", F.col("store_type").alias("s2"), F.col("physical_name").alias("p2"), F.col("catalog").alias("catalog"), F.col("domain_fqn").alias("d2")), "entity_fqn").withColumn("in_catalog", F.lit(True))
    out = found.withColumnRenamed("type_fqn", "accessor_fqn").join(known, ["accessor_fqn", "called"], "left").join(tables, "entity_fqn", "left")
    # a service has any number of calls, so they meet its pins in shares
    pins = pinned.select("service_id").distinct().withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).withColumn("pins", F.lit(True))
    out = out.withColumn("share", F.pmod(F.xxhash64("class_fqn"), F.lit(SHARES)).cast("int")).join(pins, ["service_id", "share"], "left")
    hit, entity, accessor = F.coalesce("hit", F.lit(False)), F.col("entity_fqn").isNotNull(), F.col("accessor_fqn")
    failed = (~hit | ~entity) & F.coalesce("pins", F.lit(False))
    listed = F.coalesce("in_catalog", F.lit(False))
    guess = snake(F.regexp_replace(simple_name(accessor), "Dao|Repository|Repo", ""))
    return out.select(
        "service_id", F.col("class_fqn").alias("handler_class_fqn"), F.col("method").alias("handler_method"), F.coalesce("operation", operation_of("called")).alias("operation"),
        F.coalesce(F.when(listed, F.col("s2")).otherwise(F.col("store_type")), store_type(accessor)).alias("store_type"),
        F.coalesce(F.when(listed, F.col("p2")).otherwise(F.col("physical_name")), guess).alias("table_or_entity"),
        "field", F.col("called").alias("dao_method"), "entity_fqn", F.coalesce("domain_fqn", "d2").alias("domain_fqn"), "accessor_fqn", kind_of(accessor).alias("accessor_kind"), "catalog",
        F.when(failed, "HANDLER_WITHOUT_CATALOG").when(hit, "HANDLER_LINKER+CATALOG").otherwise("HANDLER_LINKER").alias("evidence_source"),
        F.when(failed, 0.75).when(hit & entity, 0.93).otherwise(0.80).alias("confidence"),
    ).distinct().select(*ACCESS)


def mongo_accesses(parsed: DataFrame, methods: DataFrame, entities: DataFrame) -> DataFrame:
    """I-10: calls on templates and repositories whose type is of Mongo: 0.90 with an entity of the catalog, else 0.78 with a collection named after the type."""
    found = _accessor_calls(parsed, "(Template|Repo|Repository)$", r"^(save$|insert$|find|delete|remove|update)").filter(F.contains(F.lower("type_fqn"), F.lit("mongo")))
    known = _first(methods.select(F.col("accessor_fqn").alias("type_fqn"), F.col("method_name").alias("called"), "entity_fqn", "domain_fqn", "physical_name"), "type_fqn", "called")
    tables = _first(entities.select("entity_fqn", F.col("physical_name").alias("p2")), "entity_fqn")
    out = found.join(known, ["type_fqn", "called"], "left").join(tables, "entity_fqn", "left")
    entity = F.col("entity_fqn").isNotNull()
    return out.select(
        "service_id", F.col("class_fqn").alias("handler_class_fqn"), F.col("method").alias("handler_method"), operation_of("called").alias("operation"), F.lit("MONGODB").alias("store_type"),
        F.coalesce("physical_name", "p2", snake(F.regexp_replace(simple_name("type_fqn"), "Repository|Repo", ""))).alias("table_or_entity"), "field", F.col("called").alias("dao_method"), "entity_fqn",
        "domain_fqn", F.col("type_fqn").alias("accessor_fqn"), kind_of(F.col("type_fqn")).alias("accessor_kind"), F.lit(None).cast("string").alias("catalog"),
        F.when(entity, "MONGO_ACCESS+CATALOG").otherwise("MONGO_ACCESS").alias("evidence_source"), F.when(entity, 0.90).otherwise(0.78).alias("confidence"),
    ).distinct().select(*ACCESS)


def bigquery_accesses(parsed: DataFrame) -> DataFrame:
    """I-10: rows saved through a BigQuery utility; the third argument names the table, by a constant of the class or by itself."""
    found = _accessor_calls(parsed, ".", "^(save|insertAll|insertRows|insert)$").filter(F.contains(F.lower("type_fqn"), F.lit("bigquery")) & (F.size("args") >= 3))
    ref = found.withColumn("ref", F.regexp_extract(F.get("args", 2), r"^(\w+)", 1)).filter("ref <> ''")
    known = _members(parsed, "FIELD").filter((F.col("m.type") == "String") & F.col("m.initial").rlike('^"[^"]*"$')).select("service_id", "class_fqn", F.col("m.name").alias("ref"), F.regexp_replace("m.initial", '"', "").alias("value"))
    out = ref.join(known, ["service_id", "class_fqn", "ref"], "left")
    table = F.coalesce("value", F.replace(F.replace(F.lower("ref"), F.lit("_table"), F.lit("")), F.lit("_"), F.lit(" ")))
    null = F.lit(None).cast("string")
    rows = out.select(
        "service_id", F.col("class_fqn").alias("handler_class_fqn"), F.col("method").alias("handler_method"), F.lit("WRITE").alias("operation"), F.lit("BIGQUERY").alias("store_type"), table.alias("table_or_entity"),
        "field", F.col("called").alias("dao_method"), null.alias("entity_fqn"), null.alias("domain_fqn"), F.col("type_fqn").alias("accessor_fqn"), F.lit("BIGQUERY_UTIL").alias("accessor_kind"), null.alias("catalog"),
        F.lit("BIGQUERY_DIRECT").alias("evidence_source"), F.lit(0.82).alias("confidence"),
    )
    return distinct_on(rows, ["service_id", "handler_class_fqn", "handler_method", "field", "table_or_entity"], [F.asc("dao_method")]).select(*ACCESS)


def plain_accesses(parsed: DataFrame) -> DataFrame:
    """I-10, the last resort: calls on fields named as repositories or DAOs, whatever their types, with the class's first public method as handler."""
    found = calls(parsed).withColumn("field", F.regexp_extract("scope", r"^(?:this\.)?(\w+(?:Repo|Repository|Dao))$", 1)).filter("field <> ''")
    public = F.get(F.filter("members", lambda m: m["is_primary"] & (m["kind"] == "METHOD") & F.arrays_overlap(m["modifiers"], F.array(F.lit("public"), F.lit("protected"))) & ~m["name"].rlike("^(get|set|equals$)")), 0)["name"]
    handlers = parsed.select("service_id", "class_fqn", public.alias("handler"), F.regexp_extract("text", r'@Table\s*\(\s*(?:name\s*=\s*)?"([^"]+)"', 1).alias("named"))
    out = found.join(handlers, ["service_id", "class_fqn"]).join(field_types(parsed), ["service_id", "class_fqn", "field"], "left")
    null = F.lit(None).cast("string")
    table = F.coalesce(F.nullif("named", F.lit("")), snake(F.regexp_replace("field", "ReadOnlyRepo|Repository|Repo|Dao", "")))
    operation = F.when(F.lower("called").rlike("^(save|insert|update|delete)"), "WRITE").otherwise("READ")
    return out.select(
        "service_id", F.col("class_fqn").alias("handler_class_fqn"), F.col("handler").alias("handler_method"), operation.alias("operation"), store_type(F.concat_ws(".", "field", "type_fqn")).alias("store_type"),
        table.alias("table_or_entity"), "field", F.col("called").alias("dao_method"), null.alias("entity_fqn"), null.alias("domain_fqn"), F.col("type_fqn").alias("accessor_fqn"), kind_of(F.initcap("field")).alias("accessor_kind"),
        null.alias("catalog"), F.lit("JAVA_AST").alias("evidence_source"), F.lit(0.85).alias("confidence"),
    ).distinct().select(*ACCESS)


def all_accesses(parsed: DataFrame, methods: DataFrame, entities: DataFrame, pinned: DataFrame) -> DataFrame:
    """I-09, I-10: accesses by handlers, to Mongo and to BigQuery; services without any get the last resort's.

    Of a handler's method, accessor and accessor's method the surest stays, of
    those as sure the first in this order.
    """
    found = (handler_accesses(parsed, methods, entities, pinned), mongo_accesses(parsed, methods, entities), bigquery_accesses(parsed))
    every = reduce(DataFrame.unionByName, (df.withColumn("rank", F.lit(i)) for i, df in enumerate(found)))
    keys = ["service_id", "handler_class_fqn", "handler_method", "accessor_fqn", "dao_method"]
    sure = distinct_on(every, keys, [F.desc("confidence"), F.asc("rank"), F.asc("table_or_entity")]).select(*ACCESS)
    sure = staged(sure, "accesses")
    rest = plain_accesses(parsed).join(sure.select("service_id").distinct(), "service_id", "left_anti").select(*ACCESS)
    return sure.unionByName(rest)
