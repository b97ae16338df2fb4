"""Facts from source texts (I-01 to I-26).

Each extractor takes ``files(path, text)``, with ``service_id`` where facts need
it, or files that :func:`light_parse` has read.  Facts about Java declarations
are DataFrame operations on what :mod:`.code` reads, so comments and string
literals declare nothing.  Facts by regular expression (Kotlin, gates, DDL,
POMs and others) see the text without its comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import camel_to_snake, normalize_path, operation_of, store_type
from ..operators.relational import distinct_on as first_wins
from ..session import staged
from .code import MOST_CALLS, read_sources

def _each(df: DataFrame, pattern: str, *groups: str, keep: tuple[str, ...] = ("service_id", "path", "class_fqn")) -> DataFrame:
    """A row for each match in ``text``; groups by name, blank ones null."""
    own = [c for c in keep if c in df.columns]
    hits = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)))
    return df.select(*own, F.explode(hits).alias("x")).select(*own, *(F.nullif(F.col(f"x.{g}"), F.lit("")).alias(g) for g in groups))


def light_parse(files: DataFrame, members: bool = True, calls: bool = True, args: bool = True, stage: bool = True) -> DataFrame:
    """I-01, I-02: files that declare a type, with package, primary type and kind, ``class_fqn`` of both, and all declarations.

    The primary type is the first class or interface at the top, else the first
    enum.  ``text`` comes back without comments.  A Java file whose brackets
    don't match is left out, see :func:`unsupported`.  Files are read once: what
    is read is staged, as most facts below take it several times.  For facts
    about types alone ``members`` need not be read, for others perhaps not their
    ``calls`` or the ``args`` of those.  Facts that take it once
    (:func:`symbol_facts`, :func:`call_graph`, :func:`method_calls` and
    :func:`data_accesses`) need no ``stage``.
    """
    read = read_sources(files, members, calls, args)
    java = ~F.endswith("path", F.lit(".kt"))
    main = F.get(F.filter("types", lambda t: t["is_primary"]), 0)
    typed = r"\b(class|interface|enum|record|object)\s+([A-Z]\w*)"
    package = F.when(java, F.col("package")).otherwise(F.regexp_extract("code", r"(?m)^\s*package\s+([\w.]+)", 1))
    kind = F.when(java, main["kind"]).otherwise(F.regexp_extract("code", typed, 1))
    name = F.when(java, main["name"]).otherwise(F.regexp_extract("code", typed, 2))
    fqn = F.concat_ws(".", F.nullif("package", F.lit("")), "type_name")
    out = read.withColumns({"package": package, "type_kind": kind, "type_name": name, "text": F.col("code")}).withColumn("class_fqn", fqn)
    broken = java & F.col("problem").isNotNull()
    out = out.filter((F.col("type_name") != "") & ~broken).drop("code", "problem")
    return staged(out, "sources") if stage else out


def _members(parsed: DataFrame, kind: str, primary: bool = True) -> DataFrame:
    """``m`` for each member of a kind, of the primary type or of all, beside what names its file."""
    own = [c for c in ("service_id", "path", "class_fqn", "package", "types") if c in parsed.columns]
    kept = F.filter("members", lambda m: (m["kind"] == kind) & (m["is_primary"] if primary else F.lit(True)))
    return parsed.select(*own, F.explode(kept).alias("m"))


def _main(parsed: DataFrame) -> Column:
    return F.get(F.filter("types", lambda t: t["is_primary"]), 0)


def _has(annotations: Column, *names: str) -> Column:
    return F.exists(annotations, lambda a: a["name"].isin(*names))


def _args(annotations: Column, name: str) -> Column:
    """Arguments of the first annotation of that name; null where there is none."""
    return F.get(F.filter(annotations, lambda a: a["name"] == name), 0)["args"]


_EXPRESSION = r'((?:"(?:[^"\\]|\\.)*"|\{[^}]*\}|[^,"{])+)'


def annotation_value(args: Column, *names: str) -> Column:
    """Source of the first of the named members, or of the only one where it is not named; an empty string without any."""
    named = F.regexp_extract(args, rf"(?:^|,)(?:{'|'.join(names)})={_EXPRESSION}", 1)
    return F.when(args.rlike(r"(?:^|[,}])\w+=(?!=)"), named).otherwise(args)


def _plain_type(c: Column) -> Column:
    """A type's name without its parameters."""
    return F.regexp_replace(c, r"<.*|\[\]|\.\.\.", "")


def implemented(parsed: DataFrame) -> DataFrame:
    """I-01: a row for each interface the primary type names."""
    names = F.transform(_main(parsed)["implemented"], lambda t: _plain_type(t))
    return parsed.select("service_id", "class_fqn", "package", F.explode(names).alias("interface"))


#: Annotations that inject, and parts of types that send to Kafka.
INJECTING = ("Autowired", "Resource", "Inject", "Qualifier")
_PRODUCER = "SyncProducer|AsyncProducer|KafkaTemplate"


def _how(m: Column, main: Column) -> Column:
    """``rank, kind`` of how field ``m`` of the primary type ``main`` is injected; null where it is not."""
    static = F.array_contains(m["modifiers"], "static")
    final = F.array_contains(m["modifiers"], "final")
    marked = F.get(F.filter(m["annotations"], lambda a: a["name"].isin(*INJECTING)), 0)["name"]
    producer = m["type"].rlike(_PRODUCER)
    all_args, required = _has(main["annotations"], "AllArgsConstructor"), _has(main["annotations"], "RequiredArgsConstructor")
    return (
        F.when(marked.isNotNull() | producer, F.struct(F.lit(1).alias("rank"), F.coalesce(marked, F.lit("FIELD")).alias("kind")))
        .when(~static & (all_args | required & final), F.struct(F.lit(3).alias("rank"), F.lit("LOMBOK_CONSTRUCTOR").alias("kind")))
        .when(~static & final & F.array_contains(m["modifiers"], "private") & m["initial"].isNull(), F.struct(F.lit(4).alias("rank"), F.lit("FINAL_FIELD").alias("kind")))
    )


def injections(parsed: DataFrame) -> DataFrame:
    """I-25: ``type, name, bean_name, injection`` of what is handed to the primary type.

    Annotated fields and Kafka producers, then constructor parameters, then what
    a constructor by Lombok takes (all fields that are not static, or the final
    ones), then other private final fields without a value, which only a
    constructor can set.  Of a name and type the first in this order stays.
    """
    own = ["service_id", "class_fqn", "package"]
    unquoted = lambda c: F.nullif(F.regexp_replace(c, r'^\w+=|"', ""), F.lit(""))
    m, how = F.col("m"), _how(F.col("m"), F.col("main"))
    field = _members(parsed, "FIELD").withColumn("main", _main(parsed))
    bean = F.when(how["rank"] == 1, F.coalesce(unquoted(_args(m["annotations"], "Resource")), unquoted(_args(m["annotations"], "Qualifier"))))
    fields = field.select(*own, m["type"].alias("type"), m["name"].alias("name"), bean.alias("bean_name"), how.alias("how")).filter("how IS NOT NULL")
    made = _members(parsed, "CONSTRUCTOR").select(*own, F.explode("m.params").alias("p")).select(
        *own, F.col("p.type").alias("type"), F.col("p.name").alias("name"), unquoted(_args(F.col("p.annotations"), "Qualifier")).alias("bean_name"),
        F.struct(F.lit(2).alias("rank"), F.lit("CONSTRUCTOR").alias("kind")).alias("how"),
    )
    first = first_wins(fields.unionByName(made), ["service_id", "class_fqn", "type", "name"], [F.asc("how.rank"), F.asc_nulls_last("bean_name")])
    return first.select(*own, "type", "name", "bean_name", F.col("how.kind").alias("injection"))


def injected(parsed: DataFrame) -> DataFrame:
    """I-25: ``type, name`` of :func:`injections`, types without their parameters."""
    return injections(parsed).withColumn("type", _plain_type(F.col("type"))).distinct()


def _public(m: Column) -> Column:
    accessor = m["name"].rlike("^(get|set|is)") & (F.size(m["params"]) <= 1)
    return F.array_contains(m["modifiers"], "public") & ~accessor


def methods(parsed: DataFrame) -> DataFrame:
    """I-01: public methods of the primary type that are no accessors (get, set, is with one parameter at most)."""
    m = F.col("m")
    return _members(parsed, "METHOD").filter(_public(m)).select(
        "service_id", "path", "class_fqn", m["type"].alias("returns"), m["name"].alias("method"), F.transform(m["params"], lambda p: p["type"]).alias("params"),
        m["thrown"].alias("thrown"), m["doc"].alias("doc"),
    )


def calls(parsed: DataFrame, public: bool = False) -> DataFrame:
    """``method, scope, chained, called, args`` of each call in the primary type's methods, the first of a method at ``position`` 0."""
    found = _members(parsed, "METHOD")
    found = found.filter(_public(F.col("m"))) if public else found
    each = found.select("service_id", "path", "class_fqn", F.col("m.name").alias("method"), F.posexplode("m.calls").alias("position", "c"))
    return each.select("service_id", "path", "class_fqn", "method", "position", "c.scope", "c.chained", F.col("c.name").alias("called"), "c.args")


def _calls_and_injected(parsed: DataFrame, public: bool = False) -> DataFrame:
    """In one pass, ``name, type`` of what is handed to the primary type, as :func:`injections` has it, and ``method, position, c`` of calls, as :func:`calls` has them; the others are null."""
    m, main = F.col("m"), _main(parsed)
    item = lambda name, type_, position, c: F.struct(name.alias("name"), type_.alias("type"), position.alias("position"), c.alias("c"))
    null = lambda t: F.lit(None).cast(t)
    call = "struct<scope:string,chained:string,name:string>"
    made = F.transform(m["calls"], lambda c, i: item(null("string"), null("string"), i, F.struct(c["scope"].alias("scope"), c["chained"].alias("chained"), c["name"].alias("name"))))
    params = F.transform(m["params"], lambda p: item(p["name"], p["type"], null("int"), null(call)))
    field = F.array(item(m["name"], m["type"], null("int"), null(call)))
    of_method = (m["kind"] == "METHOD") & _public(m) if public else m["kind"] == "METHOD"
    items = F.when(of_method, made).when(m["kind"] == "CONSTRUCTOR", params).when((m["kind"] == "FIELD") & _how(m, F.col("main")).isNotNull(), field)
    each = parsed.select("service_id", "class_fqn", F.struct(main["annotations"].alias("annotations")).alias("main"), F.explode(F.filter("members", lambda x: x["is_primary"])).alias("m"))
    return each.select("service_id", "class_fqn", F.col("m.name").alias("method"), F.explode(items).alias("i")).select("service_id", "class_fqn", "method", "i.*")


#: What calls are passed over by the start of their scope.
SKIPPED_SCOPES = ("log", "LOG", "logger", "LOGGER", "Optional", "String", "Objects", "CollectionUtils", "StringUtils", "ObjectUtils", "Collections", "Arrays")


def call_graph(parsed: DataFrame) -> DataFrame:
    """I-25: ``class_fqn, method, callee_type, callee, variable`` of public methods' calls.

    On an injected variable the callee is of its type; on ``this.x`` or on
    nothing, of the class itself; chained calls are passed over.  The first
    MOST_CALLS of a method stay.
    """
    each = _calls_and_injected(parsed, True).filter("c IS NULL OR c.chained IS NULL")
    scope = F.col("c.scope")
    skipped = F.greatest(*(F.startswith(scope, F.lit(x)) for x in SKIPPED_SCOPES))
    each = each.filter(F.col("c").isNull() | scope.isNull() | ~skipped)
    parts = F.split(scope, r"\.")
    called = F.when(F.size(parts) == 1, scope).when((F.size(parts) == 2) & (parts[0] != "this"), parts[0])
    each = each.select(
        "service_id", "class_fqn", "type", "method", "position", F.coalesce("name", called).alias("variable"), scope.isNull() | (F.size(parts) == 2) & (parts[0] == "this"),
        F.element_at(parts, -1).alias("shown"), F.col("c.name").alias("callee"),
    ).toDF("service_id", "class_fqn", "type", "method", "position", "variable", "own", "shown", "callee")
    # all of a class meets once, and is sorted within its task after that
    one = F.min("type").over(Window.partitionBy("service_id", "class_fqn", "variable"))
    typed = each.repartition("service_id", "class_fqn").withColumn("type", F.when(F.col("service_id").isNotNull() & F.col("variable").isNotNull(), one)).filter("callee IS NOT NULL")
    kept = typed.withColumn("callee_type", F.when(F.col("own"), F.col("class_fqn")).otherwise(F.col("type"))).filter("callee_type IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("service_id", "class_fqn", "method").orderBy("position", "callee_type", "callee", "shown"))
    kept = kept.withColumn("nth", nth).filter(F.col("nth") <= MOST_CALLS)
    return kept.select("service_id", "class_fqn", "method", "callee_type", "callee", F.col("shown").alias("variable")).distinct()


def method_calls(parsed: DataFrame) -> DataFrame:
    """I-25: calls on injected fields, in any method: ``type, called``; loggers are passed over."""
    keys = ["service_id", "class_fqn", "field"]
    field = F.coalesce("name", F.regexp_extract("c.scope", r"^(?:this\.)?(\w+)$", 1))
    each = _calls_and_injected(parsed).select("service_id", "class_fqn", field.alias("field"), _plain_type(F.col("type")).alias("type"), F.col("c.name").alias("called"))
    each = each.filter("service_id IS NOT NULL AND field NOT IN ('', 'log', 'logger')")
    met = each.groupBy(*keys).agg(F.collect_set("type").alias("types"), F.collect_set("called").alias("all")).filter("size(types) > 0 AND size(all) > 0")
    return met.withColumn("type", F.explode("types")).select("service_id", "class_fqn", "type", F.explode("all").alias("called")).distinct()


#: Verbs of mapping annotations; RequestMapping without a verb stands for all seven.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
_MAPPING = r"^(Get|Post|Put|Delete|Patch|Request)Mapping$"


def _paths(expression: Column) -> Column:
    """Each element of an array's source, or the source itself."""
    inside = F.regexp_extract(expression, r"^\{(.*)\}$", 1)
    many = F.regexp_extract_all(inside, F.lit(_EXPRESSION), F.lit(1))
    return F.when(expression.rlike(r"^\{.+\}$"), many).otherwise(F.array(expression))


def _base(parsed: DataFrame) -> Column:
    """What the primary type's mapping puts before the paths of its methods."""
    return F.coalesce(annotation_value(_args(_main(parsed)["annotations"], "RequestMapping"), "value", "path"), F.lit(""))


def mappings(parsed: DataFrame) -> DataFrame:
    """I-01: ``method, http_method, base, sub`` of mapping annotations of the primary type and its methods, paths as they stand in the source."""
    base = _base(parsed)
    each = _members(parsed, "METHOD").withColumn("base", base).select("service_id", "path", "class_fqn", "base", F.col("m.name").alias("method"), F.explode("m.annotations").alias("a"))
    each = each.filter(F.col("a.name").rlike(_MAPPING))
    rows = each.withColumn("http_method", F.explode(_verbs(F.col("a")))).withColumn("base", F.explode(_paths(F.col("base")))).withColumn("sub", F.explode(_subs(F.col("a"))))
    return rows.select("service_id", "path", "class_fqn", "method", "http_method", "base", "sub")


def _verbs(a: Column) -> Column:
    """The verbs of a mapping annotation."""
    verb = F.upper(F.regexp_extract(a["name"], _MAPPING, 1))
    wanted = annotation_value(F.concat(F.lit("x=,"), a["args"]), "method")
    named = F.filter(F.array(*map(F.lit, VERBS)), lambda v: F.contains(F.upper(wanted), F.concat(F.lit("."), v)) | F.rlike(F.upper(wanted), F.concat(F.lit(r"\b"), v, F.lit(r"\b"))))
    return F.when(verb != "REQUEST", F.array(verb)).when(F.size(named) > 0, named).otherwise(F.array(*map(F.lit, VERBS)))


def _subs(a: Column) -> Column:
    """The paths of a mapping annotation, as they stand in the source."""
    return _paths(annotation_value(a["args"], "value", "path"))


def _joined(base: Column, sub: Column) -> Column:
    bare = lambda c: F.replace(c, F.lit('"'), F.lit(""))
    return normalize_path(F.concat(F.lit("/"), bare(base), F.lit("/"), bare(sub)))


def resolved(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """I-19: ``rows`` with the source expression in ``column`` put together: literals, and constants of ``known(service_id, constant, value)``.

    ``A.B`` is constant ``A#B``, a name alone one of the class that names it.
    What is no literal and not known stays as it is written.
    """
    parts = F.regexp_extract_all(F.col(column), F.lit(r'"(?:[^"\\]|\\.)*"|[\w.]+|[^"\w.+]+'), F.lit(0))
    others = [c for c in rows.columns if c != column]
    each = rows.distinct().select(F.struct(*rows.columns).alias("at"), F.posexplode_outer(parts).alias("nth", "part"))
    simple = F.substring_index("at.class_fqn", ".", -1)
    key = F.when(F.contains("part", F.lit(".")), F.regexp_replace("part", r"^(?:.*\.)?(\w+)\.(\w+)$", "$1#$2")).otherwise(F.concat_ws("#", simple, "part"))
    values = known.groupBy(F.col("service_id").alias("of"), F.col("constant").alias("named")).agg(F.min("value").alias("value"))
    joined = each.join(values, (F.col("at.service_id") == F.col("of")) & (key == F.col("named")), "left")
    text = F.when(F.startswith("part", F.lit('"')), F.regexp_replace("part", '^"|"$', "")).otherwise(F.coalesce("value", "part"))
    again = joined.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("nth", F.coalesce(text, F.lit("")).alias("text")))).alias("texts"))
    return again.select(*(F.col(f"at.{c}").alias(c) for c in others), F.array_join("texts.text", "").alias(column))


def endpoints(parsed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """I-01, I-19: ``class_fqn, http_method, path``: class and method mappings joined; ``known`` constants are put into paths."""
    rows = mappings(parsed).withColumnRenamed("path", "file_path")
    if known is not None:
        rows = resolved(resolved(rows, "base", known), "sub", known)
    return rows.select("service_id", "file_path", "class_fqn", "http_method", _joined(F.col("base"), F.col("sub")).alias("path")).distinct()


#: Verbs of fluent clients and of templates, and types that are clients.
_TEMPLATES = {"getForEntity": "GET", "getForObject": "GET", "postForEntity": "POST", "postForObject": "POST", "delete": "DELETE", "patchForEntity": "PATCH"}
_CLIENTS = "RestClient|WebClient|RestTemplate|FeignClient"


def client_calls(parsed: DataFrame) -> DataFrame:
    """I-01: ``client, http_method, path_text, source_symbol``: calls to other services by the client they go through.

    Fluent clients (a verb, then ``uri``), templates, ``exchange`` (whose path is
    always null), Feign interfaces (their endpoints), subclasses of RestService
    (their settings' prefix), and each field of a client's type (without a verb).
    """
    found = calls(parsed)
    plain = lambda c: F.replace(c, F.lit('"'), F.lit(""))
    simple = F.substring_index("class_fqn", ".", -1)
    at = F.concat_ws("#", simple, "method").alias("source_symbol")
    own = ["service_id", "class_fqn"]
    null = F.lit(None).cast("string")
    verbs = F.create_map(*(F.lit(x) for kv in _TEMPLATES.items() for x in kv))
    verb = F.regexp_extract(F.get("args", 1), r"\.(POST|PUT|GET|DELETE|PATCH)", 1)
    web = F.when(F.contains("scope", F.lit("WebClient")), "WebClient").otherwise("RestTemplate")
    call = lambda client, verb, path: F.struct(client.alias("client"), verb.alias("http_method"), path.alias("path_text"))
    # a call is of one kind at most, by its name, so calls are gone through once
    kind = (
        F.when(F.expr("called = 'uri' AND size(args) > 0 AND chained IN ('get', 'post', 'put', 'delete', 'patch')"), call(F.lit("RestClient"), F.upper("chained"), plain(F.get("args", 0))))
        .when(F.col("called").isin(*_TEMPLATES) & (F.size("args") > 0), call(F.lit("RestTemplate"), F.element_at(verbs, F.col("called")), plain(F.get("args", 0))))
        .when(F.expr("called = 'exchange' AND size(args) >= 2"), call(web, F.nullif(verb, F.lit("")), null))
    )
    named = found.filter(F.col("called").isin("uri", "exchange", *_TEMPLATES))
    made = named.select(*own, kind.alias("x"), at).filter("x IS NOT NULL").select(*own, "x.*", "source_symbol")
    main = _main(parsed)
    feign = mappings(parsed.filter(_has(main["annotations"], "FeignClient"))).select(*own, F.lit("FeignClient"), "http_method", plain(F.concat("base", "sub")), F.concat_ws("#", "class_fqn", "method"))
    prefix = F.nullif(plain(annotation_value(_args(main["annotations"], "ConfigurationProperties"), "value", "prefix")), F.lit(""))
    retried = F.exists("members", lambda m: m["is_primary"] & F.exists(m["calls"], lambda c: c["name"] == "callWithRetry"))
    service = parsed.filter(F.exists(main["extended"], lambda t: F.contains(t, F.lit("RestService"))) & (retried | prefix.isNotNull())).select(*own, F.lit("RestService"), F.lit("POST"), prefix, simple)
    fields = _members(parsed, "FIELD").filter(_plain_type(F.col("m.type")).rlike(_CLIENTS)).select(*own, F.col("m.type"), null, null, simple)
    out = made
    for part in (feign, service, fields):
        out = out.union(part)
    return out.distinct()


def outbound_calls(parsed: DataFrame) -> DataFrame:
    """I-01, I-03: ``http_method, path_text`` of calls to other services, at a confidence of 0.9."""
    return client_calls(parsed).select("service_id", "class_fqn", "http_method", "path_text", F.lit(0.9).alias("confidence")).distinct()


def symbol_facts(parsed: DataFrame) -> DataFrame:
    """I-03: classes, enums, methods and endpoints as symbols; files are gone through once."""
    own = ["service_id", "path", "class_fqn"]
    symbol = lambda fqn, kind, confidence: F.struct(fqn.alias("symbol_fqn"), kind.alias("symbol_kind"), F.lit(confidence).alias("confidence"))
    kind = F.when(F.col("type_kind") == "enum", "ENUM").otherwise("CLASS")
    base = _base(parsed)
    each = parsed.select(*own, kind.alias("kind"), base.alias("base"), F.posexplode_outer(F.filter("members", lambda m: (m["kind"] == "METHOD") & m["is_primary"])).alias("nth", "m"))
    each = each.select(*own, "kind", "base", "nth", F.col("m.name").alias("method"), _public(F.col("m")).alias("public"), F.filter("m.annotations", lambda a: a["name"].rlike(_MAPPING)).alias("mapped"))
    each = each.withColumns({"first": F.coalesce(F.col("nth"), F.lit(0)) == 0, "a": F.explode_outer("mapped")})
    each = each.withColumn("verb", F.explode_outer(F.when(F.col("a").isNotNull(), _verbs(F.col("a"))))).withColumn("base", F.explode_outer(_paths(F.col("base")))).withColumn("sub", F.explode_outer(_subs(F.col("a"))))
    end = F.concat(F.col("class_fqn"), F.lit("#"), F.col("verb"), F.lit(" "), _joined(F.col("base"), F.col("sub")))
    symbols = F.array(
        F.when(F.col("first"), symbol(F.col("class_fqn"), F.col("kind"), 1.0)), F.when(F.col("public"), symbol(F.concat_ws("#", "class_fqn", "method"), F.lit("METHOD"), 0.9)),
        F.when(end.isNotNull(), symbol(end, F.lit("ENDPOINT"), 1.0)),
    )
    return each.select("service_id", "path", F.explode(F.array_compact(symbols)).alias("s")).select("service_id", "path", "s.*").distinct()


def unsupported(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """I-03: files of which no type could be read, or whose brackets don't match; ``parsed``: the files, where they are read already."""
    parsed = light_parse(files) if parsed is None else parsed
    return files.join(parsed.select("path"), "path", "left_anti").select("service_id", "path", F.lit("PARSE_ERROR").alias("reason_code"))


#: Peripherals by names of annotations and types, whole or a part; tier 1 is sure, tier 3 needs to be set up by hand.
PERIPHERALS = (
    ("kafka", 1, "^KafkaListener$"),
    ("rabbitmq", 1, "^RabbitListener$"),
    ("redis", 1, "RedisTemplate"),
    ("mongodb", 1, "MongoTemplate"),
    ("s3", 1, "^AmazonS3$"),
    ("gcp-pubsub", 1, "^BasicPublishSubscribeConsumer$"),
    ("postgres", 1, "postgresql"),
    ("oracle", 2, "(?i)oracle"),
    ("sqlserver", 2, "(?i)sqlserver"),
    ("spring-cloud-config", 3, "ConfigServer"),
)


def peripherals(files: DataFrame) -> DataFrame:
    """I-04: told by annotations, and by types of fields and of constructor parameters; postgres also needs an entity."""
    read = read_sources(files)
    names = F.array_distinct(F.concat(
        F.flatten(F.transform("types", lambda t: F.transform(t["annotations"], lambda a: a["name"]))),
        F.flatten(F.transform("members", lambda m: F.transform(m["annotations"], lambda a: a["name"]))),
        F.transform(F.filter("members", lambda m: m["kind"] == "FIELD"), lambda m: m["type"]),
        F.flatten(F.transform(F.filter("members", lambda m: m["kind"] == "CONSTRUCTOR"), lambda m: F.transform(m["params"], lambda p: p["type"]))),
    ))
    signals = read.select("service_id", "path", names.alias("names"))

    def hit(name: str, pattern: str) -> Column:
        found = F.exists("names", lambda n: n.rlike(pattern))
        return found & F.array_contains("names", "Entity") if name == "postgres" else found

    hits = F.filter(
        F.array(*(F.when(hit(n, p), F.struct(F.lit(n).alias("peripheral_type"), F.lit(t).cast("short").alias("detection_tier"))) for n, t, p in PERIPHERALS)),
        lambda x: x.isNotNull(),
    )
    return signals.select("service_id", "path", F.explode(hits).alias("x")).select("service_id", "path", "x.*")


def attribute_callers(calls: DataFrame, invokes: DataFrame, most: int = 6) -> DataFrame:
    """I-05: outbound calls given to the classes that reach the caller in at most six INVOKES steps, at a confidence of 0.88 at most.

    ``calls(class_fqn, http_method, path_text, confidence)``, ``invokes(src, dst)``.
    """
    from ..operators.traverse import fixpoint

    seeds = calls.select(F.col("class_fqn").alias("seed"), F.col("class_fqn").alias("node")).distinct()
    callers = fixpoint(invokes.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), seeds, most).filter("seed <> node")
    given = calls.join(callers, F.col("class_fqn") == F.col("seed"))
    return given.select(F.col("node").alias("class_fqn"), "http_method", "path_text", F.least("confidence", F.lit(0.88)).alias("confidence"), F.lit("CALLER_ATTRIBUTION").alias("evidence_source")).distinct()


def yaml_entries(files: DataFrame) -> DataFrame:
    """C-17: ``path, key, value`` of YAML texts, nested keys joined by dots; lists and anchors are passed over.

    A key's parents are the nearest lines above with less indentation; they are
    kept in order of indentation while lines are folded one after the other.
    """
    line = r"^( *)([A-Za-z0-9_.\-]+)\s*:\s*(.*)$"
    kept = F.filter(F.split("text", "\n"), lambda x: x.rlike(line))
    rows = F.transform(
        kept,
        lambda x: F.struct(
            F.length(F.regexp_extract(x, line, 1)).alias("indent"), F.regexp_extract(x, line, 2).alias("key"),
            F.trim(F.regexp_replace(F.regexp_extract(x, line, 3), r"\s+#.*$|^[\"']|[\"']$", "")).alias("value"),
        ),
    )
    kind = "struct<stack:array<struct<indent:int,key:string>>,done:array<struct<key:string,value:string>>>"
    start = F.struct(F.array().cast("array<struct<indent:int,key:string>>").alias("stack"), F.array().cast("array<struct<key:string,value:string>>").alias("done")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        above = F.filter(s["stack"], lambda k: k["indent"] < x["indent"])
        stack = F.array_append(above, F.struct(x["indent"].alias("indent"), x["key"].alias("key")))
        entry = F.struct(F.array_join(F.transform(stack, lambda k: k["key"]), ".").alias("key"), x["value"].alias("value"))
        done = F.when(x["value"] == "", s["done"]).otherwise(F.array_append(s["done"], entry))
        return F.struct(stack.alias("stack"), done.alias("done")).cast(kind)

    return files.select("path", F.explode(F.aggregate(rows, start, step)["done"]).alias("x")).select("path", "x.*")


def yaml_topics(entries: DataFrame) -> DataFrame:
    """I-06: topics and subscriptions from settings; full resource names are certain."""
    full = F.col("value").rlike("^projects/[^/]+/(topics|subscriptions)/")
    kind = F.when(F.lower("key").rlike("subscription") | F.contains("value", F.lit("/subscriptions/")), "SUBSCRIPTION").when(F.lower("key").rlike("topic") | F.contains("value", F.lit("/topics/")), "TOPIC")
    role = F.when(F.lower("key").rlike("consumer|subscription|pipeline"), "SUBSCRIBE").otherwise("PUBLISH")
    return entries.withColumn("resource_kind", kind).filter("resource_kind IS NOT NULL").select(
        "path", "key", "resource_kind", role.alias("role"), F.regexp_extract("value", "([^/]+)$", 1).alias("short_id"), F.when(full, 1.0).otherwise(0.85).alias("confidence")
    )


def proto_schemas(files: DataFrame) -> DataFrame:
    """I-08: messages and enums of proto files; nested braces end a body."""
    found = _each(files.filter(F.endswith("path", F.lit(".proto"))), r"\b(message|enum)\s+(\w+)\s*\{([^{}]*)\}", "kind", "name", "body", keep=("service_id", "path"))
    fields = F.regexp_extract_all("body", F.lit(r"(\w+)\s*=\s*\d+"), F.lit(1))
    return found.select("service_id", "path", "kind", "name", fields.alias("fields"))


def payload_uses(parsed: DataFrame) -> DataFrame:
    """I-08: messages unpacked (inbound) and packed (outbound)."""
    inbound = _each(parsed, r"\.unpack\(\s*(\w+)\.class\s*\)", "payload").select("service_id", "class_fqn", "payload", F.lit("INBOUND").alias("direction"), F.lit(0.9).alias("confidence"))
    return inbound.union(_each(parsed, r"\bAny\.pack\(\s*(\w+)", "payload").select("service_id", "class_fqn", "payload", F.lit("OUTBOUND"), F.lit(0.85))).distinct()


def data_accesses(parsed: DataFrame) -> DataFrame:
    """I-09, I-10, I-16: calls on fields whose type is a repository or DAO, read or write by their name."""
    hit = method_calls(parsed).filter(F.col("type").rlike("(Repository|Repo|Dao|Template)$"))
    return hit.select("service_id", F.col("class_fqn").alias("handler_class_fqn"), F.col("type").alias("accessor"), F.col("called").alias("dao_method"), operation_of("called").alias("operation"), store_type("type").alias("store_type"))


def flow_gates(parsed: DataFrame) -> DataFrame:
    """I-11: conditional beans, value flags and negated flags; the surest of a key stays."""
    own = ["service_id", "class_fqn"]
    bean = _each(parsed, r'@ConditionalOnProperty\s*\((?:[^)]*?(?:name|value)\s*=\s*)?"([^"]+)"', "gate_key").select(*own, "gate_key", F.lit("CONDITIONAL_BEAN").alias("gate_kind"), F.lit("NO_BEAN").alias("effect"), F.lit(0.95).alias("confidence"))
    value = _each(parsed, r'@Value\(\s*"\$\{([^:}"]+):(?:true|false)\}"', "gate_key").select(*own, "gate_key", F.lit("CODE_FLAG"), F.lit("NO_PUBLISH"), F.lit(0.90))
    flag = _each(parsed, r"\bif\s*\(\s*!\s*(\w+)\s*\)", "gate_key").select(*own, "gate_key", F.lit("CODE_FLAG"), F.lit("SKIP"), F.lit(0.85))
    return first_wins(bean.union(value).union(flag), [*own, "gate_key"], [F.desc("confidence"), F.asc("effect")])


def publishes(parsed: DataFrame) -> DataFrame:
    """I-13: sends on Kafka producers and Pub/Sub gateways, with the topic where it is a literal."""
    kafka = _each(parsed, r'\b(\w*[pP]roducer|kafkaTemplate)\.send\(\s*(?:"([^"]+)")?', "field", "topic").select("service_id", "class_fqn", "topic", F.lit("KAFKA").alias("transport"), F.lit(0.92).alias("confidence"))
    pubsub = _each(parsed, r'\b(\w*[gG]ateway)\.sendByteArrayToPubSub\(\s*(?:"([^"]+)")?', "field", "topic").select("service_id", "class_fqn", "topic", F.lit("PUBSUB"), F.lit(0.92))
    return kafka.union(pubsub).distinct()


def entities(parsed: DataFrame) -> DataFrame:
    """I-16: annotated entities with their physical name, else the class name in snake case."""
    hit = parsed.filter(F.col("text").rlike(r"@(Entity|Table|Document)\b"))
    named = F.nullif(F.regexp_extract("text", r'@(?:Table|Document)\s*\(\s*(?:(?:value|name|collection)\s*=\s*)?"([^"]+)"', 1), F.lit(""))
    return hit.select("service_id", F.col("class_fqn").alias("entity_fqn"), F.coalesce(named, camel_to_snake("type_name")).alias("physical_name"), F.when(F.contains("text", F.lit("@Document")), "MONGODB").otherwise(store_type("text")).alias("store_type"))


def repository_entities(parsed: DataFrame) -> DataFrame:
    """I-16: the entity a repository interface is made for."""
    return _each(parsed, r"\binterface\s+(\w+)\s+extends\s+\w*Repository<\s*(\w+)", "repository", "entity")


def ddl_tables(files: DataFrame) -> DataFrame:
    """I-17: tables of ``.sql`` and ``.cql`` files, with a catalog from the name or ``USE``."""
    ddl = files.filter(F.col("path").rlike(r"\.(sql|cql)$")).withColumn("use", F.nullif(F.regexp_extract("text", r"(?i)\bUSE\s+[`\"]?(\w+)", 1), F.lit("")))
    found = _each(ddl, r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[`\"]?(\w+)[`\"]?\.)?[`\"]?(\w+)[`\"]?", "own", "physical_name", keep=("service_id", "path", "use"))
    return found.select("service_id", "path", F.coalesce("own", "use").alias("catalog"), "physical_name", F.when(F.endswith("path", F.lit(".cql")), "CASSANDRA").otherwise("MARIADB").alias("store_type")).distinct()


def constants(parsed: DataFrame) -> DataFrame:
    """I-19: static string constants by ``Class#FIELD``."""
    found = _each(parsed, r'\bstatic\s+final\s+String\s+(\w+)\s*=\s*"([^"]*)"', "field", "value")
    return found.select("service_id", F.concat_ws("#", F.substring_index("class_fqn", ".", -1), "field").alias("constant"), "value")


def openapi_operations(files: DataFrame) -> DataFrame:
    """I-21: ``operation_id, http_method, path`` of JSON specifications; bundled ones are left out."""
    spec = files.filter(F.endswith("path", F.lit(".json")) & ~F.contains("path", F.lit(".bundled.")))
    paths = F.from_json(F.get_json_object("text", "$.paths"), "map<string,map<string,string>>")
    each = spec.select(F.col("path").alias("file"), F.explode(paths).alias("path", "verbs")).select("file", "path", F.explode("verbs").alias("verb", "body"))
    each = each.filter(F.upper("verb").isin(*VERBS))
    domain = F.regexp_extract("file", r"([^/]+?)(?:-spec)?\.json$", 1)
    return each.select(F.concat_ws("|", domain, F.upper("verb"), normalize_path("path")).alias("operation_id"), F.upper("verb").alias("http_method"), F.col("path").alias("path_template"), F.get_json_object("body", "$.operationId").alias("name"))


def _resolved_id(ref: Column, file: Column) -> Column:
    """The file a reference names: itself before ``#``, seen from the folder of ``file`` where it starts with a dot; ``file`` for ``#`` alone."""
    target = F.replace(F.substring_index(ref, "#", 1), F.lit("\\"), F.lit("/"))
    folder = F.regexp_replace(file, "[^/]*$", "")
    joined = F.regexp_replace(F.concat(folder, target), r"(?<=^|/)\./", "")
    # each ".." takes the folder before it along
    up = F.regexp_extract_all(joined, F.lit(r"[^/]+"), F.lit(0))
    walked = F.aggregate(up, F.array().cast("array<string>"), lambda at, x: F.when((x == "..") & (F.size(at) > 0), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, x)))
    return F.when(target == "", file).when(F.startswith(target, F.lit(".")), F.array_join(walked, "/")).otherwise(target)


def _pointer(ref: Column) -> Column:
    """The JSON path of what stands after ``#``."""
    inside = F.filter(F.split(F.regexp_extract(ref, "#/?(.*)$", 1), "/"), lambda x: x != "")
    return F.concat(F.lit("$"), F.array_join(F.transform(inside, lambda x: F.concat(F.lit("['"), F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")), F.lit("']"))), ""))


def schema_fields(files: DataFrame, most_depth: int = 12) -> DataFrame:
    """I-22: ``path, field``: dotted names of a JSON schema's fields, arrays as ``[]``; a schema without fields gives its type.

    References are followed, within a file (``#/definitions/A``), to the file of
    the path they name, or to one beside it.  All schemas go on together: a round
    opens the properties, items and references of what the round before found,
    and each row carries the references it came by, so one that comes back to a
    schema it is in ends there, without a name.  A property or an array's items
    are one level further down; levels beyond ``most_depth`` are left out.
    """
    docs = files.filter(F.endswith("path", F.lit(".json"))).groupBy("path").agg(F.min("text").alias("body"))
    index = docs.select(F.col("path").alias("of"), F.col("body").alias("whole"))
    part = lambda p: F.get_json_object("body", p)
    level = docs.select("path", F.col("path").alias("file"), F.lit("").alias("prefix"), "body", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("followed"))
    found = []
    while True:
        level = staged(
            level.withColumns({
                "ref": part("$['$ref']"), "kind": part("$.type"), "items": part("$.items"), "props": F.from_json(part("$.properties"), "map<string,string>"),
            }), "schema-level",
        )
        plain = level.filter("ref IS NULL")
        array = (F.col("kind") == "array") | F.col("kind").isNull() & F.col("items").isNotNull() & F.col("props").isNull()
        is_array, has_props = F.coalesce(array, F.lit(False)), F.coalesce(F.size("props") > 0, F.lit(False))
        named = plain.filter(F.col("prefix") != "").select("path", F.col("prefix").alias("field"))
        bare = plain.filter((F.col("prefix") == "") & ~is_array & ~has_props & F.col("kind").isNotNull()).select("path", F.lower("kind"))
        found.append(named.union(bare))
        deeper = plain.filter(F.col("depth") < most_depth)
        inside = deeper.filter(is_array & F.col("items").isNotNull()).select("path", "file", F.concat("prefix", F.lit("[]")).alias("prefix"), F.col("items").alias("body"), (F.col("depth") + 1).alias("depth"), "followed")
        dot = F.when(F.col("prefix") == "", "").otherwise(F.concat("prefix", F.lit(".")))
        fields = deeper.filter(~is_array & has_props).select("path", "file", dot.alias("dot"), F.explode("props").alias("name", "body"), "depth", "followed")
        fields = fields.filter(F.startswith("body", F.lit("{"))).select("path", "file", F.concat("dot", "name").alias("prefix"), "body", (F.col("depth") + 1).alias("depth"), "followed")
        refs = level.filter("ref IS NOT NULL").withColumn("target", _resolved_id(F.col("ref"), F.col("file"))).withColumn("named", F.concat_ws("#", "target", F.regexp_extract("ref", "#/?(.*)$", 1)))
        refs = refs.filter(~F.array_contains("followed", F.col("named"))).join(index, F.col("target") == F.col("of"))
        opened = F.when(_pointer(F.col("ref")) == "$", F.col("whole")).otherwise(F.call_function("get_json_object", F.col("whole"), _pointer(F.col("ref"))))
        refs = refs.select("path", F.col("target").alias("file"), "prefix", opened.alias("body"), "depth", F.array_append("followed", F.col("named")).alias("followed")).filter("body IS NOT NULL")
        if level.isEmpty():
            break
        level = inside.union(fields).union(refs)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def operation_schemas(files: DataFrame) -> DataFrame:
    """I-21: ``operation_id, request_schema, response_schema``: files of the schemas that an operation's bodies refer to.

    JSON bodies come first; of responses 200, 201, 202, 204, default, then others.
    """
    spec = files.filter(F.endswith("path", F.lit(".json")) & ~F.contains("path", F.lit(".bundled.")))
    paths = F.from_json(F.get_json_object("text", "$.paths"), "map<string,map<string,string>>")
    each = spec.select(F.col("path").alias("file"), F.explode(paths).alias("path", "verbs")).select("file", "path", F.explode("verbs").alias("verb", "body")).filter(F.upper("verb").isin(*VERBS))
    texts = "map<string,string>"

    def schema_of(content: Column) -> Column:
        """The first reference among media types, in the order of their names but JSON before others."""
        types = F.array_sort(F.transform(F.map_entries(F.from_json(content, texts)), lambda e: F.struct((e["key"] != "application/json").alias("later"), e["key"].alias("name"), F.coalesce(F.get_json_object(e["value"], "$.schema['$ref']"), F.get_json_object(e["value"], "$.schema.items['$ref']")).alias("ref"))))
        return F.get(F.filter(types, lambda t: t["ref"].isNotNull()), 0)["ref"]

    order = F.create_map(*(F.lit(x) for i, c in enumerate(("200", "201", "202", "204", "default")) for x in (c, i)))
    replies = F.array_sort(F.transform(F.map_entries(F.from_json(F.get_json_object("body", "$.responses"), texts)), lambda e: F.struct(F.coalesce(F.element_at(order, e["key"]), F.lit(9)).alias("rank"), e["key"].alias("code"), schema_of(F.get_json_object(e["value"], "$.content")).alias("ref"))))
    request = schema_of(F.get_json_object("body", "$.requestBody.content"))
    response = F.get(F.filter(replies, lambda r: r["ref"].isNotNull()), 0)["ref"]
    domain = F.regexp_extract("file", r"([^/]+?)(?:-spec)?\.json$", 1)
    return each.select(
        F.concat_ws("|", domain, F.upper("verb"), normalize_path("path")).alias("operation_id"),
        _resolved_id(request, F.col("file")).alias("request_schema"), _resolved_id(response, F.col("file")).alias("response_schema"),
    )


def rest_assured_calls(parsed: DataFrame) -> DataFrame:
    """I-23: calls of tests: ``http_method, path_normalized``."""
    found = _each(parsed, r'\.(get|post|put|delete|patch)\(\s*"([^"]+)"', "verb", "raw")
    tests = found.filter(F.col("class_fqn").rlike("(Test|Tests|IT)$"))
    return tests.select("service_id", F.col("class_fqn").alias("test_symbol"), F.upper("verb").alias("http_method"), normalize_path("raw").alias("path_normalized")).distinct()


def triggers(parsed: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """I-24: entry triggers of ten kinds less those that need rules; of an id the first in the order below stays."""
    own = ["service_id", "class_fqn"]
    cols = [*own, "trigger_kind", "http_method", "path_pattern", "confidence"]
    webhook = F.col("path").rlike("(?i)webhook|callback")
    rest = endpoints(parsed).select(*own, F.when(webhook, "WEBHOOK_INBOUND").otherwise("REST_INBOUND").alias("trigger_kind"), "http_method", F.col("path").alias("path_pattern"), F.when(webhook, 0.88).otherwise(0.80).alias("confidence"))
    cron = _each(parsed, r'@Scheduled\s*\(\s*cron\s*=\s*"([^"]+)"', "p").select(*own, F.lit("CRON_SPRING"), F.lit(None).cast("string"), "p", F.lit(0.88))
    gcs = _each(parsed, r'"(gs://[^"]+)"', "p").select(*own, F.lit("FILE_DROP_GCS"), F.lit(None).cast("string"), "p", F.lit(0.82))
    listener = _each(parsed, r'@KafkaListener\s*\([^)]*topics\s*=\s*\{?\s*"([^"]+)"', "p").select(*own, F.lit("KAFKA_SUBSCRIBE"), F.lit(None).cast("string"), "p", F.when(F.startswith("p", F.lit("${")), 0.88).otherwise(0.95))
    run = F.contains("text", F.lit("SpringApplication.run"))
    batch = parsed.filter(run & F.contains("text", F.lit("CommandLineRunner")) & F.lower("class_fqn").contains("retry")).select(*own, F.lit("BATCH_LAUNCHER"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0.88))
    main = parsed.filter(run & F.contains("text", F.lit("@SpringBootApplication")) & ~F.contains("text", F.lit("CommandLineRunner"))).select(*own, F.lit("SPRING_BOOT_MAIN"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0.85))
    parts = [rest.select(*cols), cron, gcs, listener, batch, main]
    if manifests is not None:
        job = manifests.filter(F.col("text").rlike(r"(?m)^kind:\s*CronJob"))
        parts.append(job.select("service_id", F.lit(None).cast("string"), F.lit("CRON_K8S"), F.lit(None).cast("string"), F.concat(F.lit("/cronjob/"), F.regexp_extract("text", r"(?m)^\s+name:\s*([\w-]+)", 1)), F.lit(0.90)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    trigger_id = F.concat_ws("|", "trigger_kind", F.coalesce("http_method", F.lit("")), F.coalesce("path_pattern", "class_fqn"))
    return first_wins(out.withColumn("trigger_id", trigger_id), ["service_id", "trigger_id"], [F.desc("confidence"), F.asc("class_fqn")])


def factory_routes(parsed: DataFrame) -> DataFrame:
    """I-25: ``put(key, bean)`` in factories; ``orElse(bean)`` is the fallback, with key ``*``."""
    make = parsed.filter(F.contains("text", F.lit("@PostConstruct")))
    put = _each(make, r'\.put\(\s*(?:"([^"]+)"|[\w.]*?(\w+))\s*,\s*(\w+)\s*\)', "literal", "named", "bean").select("service_id", "class_fqn", F.coalesce("literal", "named").alias("routing_key"), "bean", F.lit(False).alias("fallback"))
    other = _each(make, r"\.(?:orElse|getOrDefault)\([^,)]*?,?\s*(\w+)\s*\)", "bean").select("service_id", "class_fqn", F.lit("*"), "bean", F.lit(True))
    return put.union(other).distinct()


def list_routes(parsed: DataFrame) -> DataFrame:
    """I-25: ``factory_class_fqn, selector, routing_key, implementor_fqn`` of factories that collect an injected list into a map by adapter name.

    The list is a constructor parameter; its implementors are the classes of the
    service that name its element type and are not abstract.  A key is the
    implementor's ADAPTER_NAME where it returns that, else its simple name.
    """
    simple = lambda c: F.substring_index(c, ".", -1)
    lists = F.filter(F.flatten(F.transform(F.filter("members", lambda m: m["is_primary"] & (m["kind"] == "CONSTRUCTOR")), lambda m: F.transform(m["params"], lambda p: p["type"]))), lambda t: t.rlike(r"^(?:java\.util\.)?List<"))
    element = F.regexp_extract(F.get(lists, 0), r"^[\w.]*List<(?:\?extends)?([\w.]+)", 1)
    named = F.filter("members", lambda m: m["is_primary"] & (m["kind"] == "METHOD") & _public(m))
    selector = F.when(F.contains("text", F.lit(".get(")), F.get(named, 0)["name"])
    collects = F.contains("text", F.lit("Collectors.toMap(")) & F.contains("text", F.lit("::getAdapterName"))
    factories = parsed.filter(collects & (element != "")).select("service_id", F.col("class_fqn").alias("factory_class_fqn"), F.coalesce(selector, F.lit("getProcessor")).alias("selector"), simple(element).alias("element"))
    main = _main(parsed)
    supers = F.concat(F.transform(main["implemented"], lambda t: simple(_plain_type(t))), F.when(F.exists(main["extended"], lambda t: simple(_plain_type(t)) == "OfferBaseAdapter"), F.array(F.lit("BaseAdapter"))).otherwise(F.array().cast("array<string>")))
    constant = F.get(F.filter("members", lambda m: (m["kind"] == "FIELD") & (m["name"] == "ADAPTER_NAME") & m["initial"].rlike('^"')), 0)["initial"]
    key = F.when(F.col("text").rlike(r"return\s+\w+\.ADAPTER_NAME"), F.regexp_replace(constant, '"', ""))
    concrete = parsed.filter((main["kind"] == "class") & ~F.array_contains(main["modifiers"], "abstract"))
    implementors = concrete.select("service_id", F.col("class_fqn").alias("implementor_fqn"), F.coalesce(key, simple("class_fqn")).alias("routing_key"), F.explode(F.array_distinct(supers)).alias("element"))
    return factories.join(implementors, ["service_id", "element"]).select("service_id", "factory_class_fqn", "selector", "routing_key", "implementor_fqn").distinct()


def pom_modules(files: DataFrame) -> DataFrame:
    """I-26: one row a POM: coordinates with those of the parent where absent, packaging, and module path."""
    body = F.regexp_replace("text", r"(?s)<(dependencies|dependencyManagement|build|profiles)>.*?</\1>", "")
    head = F.regexp_replace(body, r"(?s)<parent>.*?</parent>", "")
    parent = F.regexp_extract("text", r"(?s)<parent>(.*?)</parent>", 1)
    tag = lambda c, t: F.nullif(F.regexp_extract(c, rf"<{t}>\s*([^<\s]+)\s*</{t}>", 1), F.lit(""))
    return files.filter(F.col("path").rlike(r"(^|/)pom\.xml$")).select(
        "service_id", F.regexp_replace("path", r"/?pom\.xml$", "").alias("module_path"),
        F.coalesce(tag(head, "groupId"), tag(parent, "groupId")).alias("group_id"), tag(head, "artifactId").alias("artifact_id"),
        F.coalesce(tag(head, "version"), tag(parent, "version")).alias("version"), F.coalesce(tag(head, "packaging"), F.lit("jar")).alias("packaging"),
    )


def pom_dependencies(files: DataFrame) -> DataFrame:
    """I-26: declared dependencies; a ``${}`` version is unresolved as PROPERTY, an absent one as MISSING_VERSION."""
    poms = files.filter(F.col("path").rlike(r"(^|/)pom\.xml$")).withColumn("text", F.regexp_replace("text", r"(?s)<dependencyManagement>.*?</dependencyManagement>", ""))
    each = _each(poms, r"(?s)<dependency>(.*?)</dependency>", "inside", keep=("service_id", "path"))
    tag = lambda t: F.nullif(F.regexp_extract("inside", rf"<{t}>\s*([^<\s]+)\s*</{t}>", 1), F.lit(""))
    out = each.select("service_id", F.regexp_replace("path", r"/?pom\.xml$", "").alias("module_path"), tag("groupId").alias("to_group"), tag("artifactId").alias("to_artifact"), tag("version").alias("to_version"), F.coalesce(tag("scope"), F.lit("compile")).alias("scope"))
    why = F.when(F.col("to_version").isNull(), "MISSING_VERSION").when(F.contains("to_version", F.lit("${")), "PROPERTY")
    return out.withColumn("unresolved_reason", why).withColumn("resolved", F.col("unresolved_reason").isNull())


_TREE_LINE = r"^(?:\[INFO\] )?((?:[|+\\ -]{3})*)([\w.-]+):([\w.-]+):[\w-]+:([\w.-]+)(?::(\w+))?\s*$"


def dependency_tree(files: DataFrame) -> DataFrame:
    """I-26: a row for each line of a dependency tree's text, with ``depth`` and the ``parent`` it hangs from.

    ``service_id, path, line, group_id, artifact_id, version, scope, depth,
    parent_line, parent``; the root has depth 0 and no parent, and a tree after
    it in the same text starts anew.  A line's parent is the last line above it
    that is one level nearer to the root: each line stands once at its own level
    and once, as a child, at its parent's, and the last own line before it there
    is found by one ordered pass over each level.
    """
    lines = files.select("service_id", "path", F.posexplode(F.split("text", "\r?\n")).alias("line", "raw")).filter(F.col("raw").rlike(_TREE_LINE))
    got = lambda i: F.regexp_extract("raw", _TREE_LINE, i)
    rows = lines.select(
        "service_id", "path", "line", got(2).alias("group_id"), got(3).alias("artifact_id"), got(4).alias("version"), F.coalesce(F.nullif(got(5), F.lit("")), F.lit("compile")).alias("scope"),
        (F.length(got(1)) / 3).cast("int").alias("depth"),
    )
    own = F.struct("line", F.concat_ws(":", "group_id", "artifact_id", "version").alias("name"))
    as_parent = rows.select("service_id", "path", "line", F.col("depth").alias("level"), own.alias("own"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("x")).schema["x"].dataType).alias("child"))
    as_child = rows.select("service_id", "path", "line", (F.col("depth") - 1).alias("level"), F.lit(None).cast("struct<line:int,name:string>").alias("own"), F.struct(*rows.columns).alias("child"))
    before = Window.partitionBy("service_id", "path", "level").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    met = as_parent.union(as_child).withColumn("above", F.last("own", ignorenulls=True).over(before)).filter("child IS NOT NULL")
    return met.select(*(F.col(f"child.{c}").alias(c) for c in rows.columns), F.col("above.line").alias("parent_line"), F.col("above.name").alias("parent"))


def tree_dependencies(files: DataFrame) -> DataFrame:
    """I-26: distinct dependencies below a tree's root, all of which count as transitive; of a line that comes again the first file's stays."""
    rows = dependency_tree(files).filter("depth > 0").select("service_id", "path", F.col("group_id").alias("to_group"), F.col("artifact_id").alias("to_artifact"), F.col("version").alias("to_version"), "scope", F.lit(True).alias("transitive"))
    return first_wins(rows, ["service_id", "to_group", "to_artifact", "scope", "to_version"], [F.asc("path")])
