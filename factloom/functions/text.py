"""Column functions on symbols, paths, topics and tags (C-01 to C-33)."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(tests: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))


def simple_name(fqn: Column | str) -> Column:
    """C-01: what follows the last dot."""
    return F.substring_index(_c(fqn), ".", -1)


def class_part(symbol: Column | str) -> Column:
    """C-02: what precedes the first ``#``."""
    return F.split_part(_c(symbol), F.lit("#"), F.lit(1))


def test_name_keys(simple: Column | str) -> Column:
    """C-03: the test names that an equality can find, as an array."""
    s = _c(simple)
    return F.array(F.concat(s, F.lit("Test")), F.concat(s, F.lit("Tests")), F.concat(s, F.lit("IT")))


def is_test_of(test: Column | str, simple: Column | str) -> Column:
    """C-03: whether a simple test name belongs to a simple class name."""
    return F.array_contains(test_name_keys(simple), _c(test)) | F.startswith(_c(test), F.concat(F.lit("Test"), _c(simple)))


def normalize_path(path: Column | str) -> Column:
    """C-04: parameters as ``{*}``, single slashes, none at the end."""
    p = F.regexp_replace(_c(path), r"\{[^}]+\}", "{*}")
    return F.regexp_replace(F.regexp_replace(p, "/+", "/"), "/$", "")


def normalize_inbound_path(path: Column | str) -> Column:
    """C-05: as C-04 with a slash in front; blank is the root."""
    p = F.trim(F.coalesce(_c(path), F.lit("")))
    return normalize_path(F.when(p == "", F.lit("/")).when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)))


def match_key(method: Column | str, path: Column | str) -> Column:
    """C-06: upper-case method (GET if absent) and path."""
    return F.concat(F.upper(F.coalesce(_c(method), F.lit("GET"))), F.lit("|"), F.coalesce(_c(path), F.lit("")))


def normalize_table(name: Column | str) -> Column:
    """C-07."""
    return F.lower(F.replace(_c(name), F.lit("_"), F.lit("")))


def entity_name(fqn: Column | str) -> Column:
    """C-08: simple name without ``Entity`` at its end."""
    return F.regexp_replace(simple_name(fqn), "Entity$", "")


def accessor_entity(fqn: Column | str) -> Column:
    """C-08: the entity an accessor's name tells of, null for other names."""
    s = simple_name(fqn)
    return F.when(s.rlike("(Repository|Repo|Dao)$"), F.regexp_replace(s, "(Repository|Repo|Dao)$", ""))


def glob_match(value: Column | str, pattern: str) -> Column:
    """C-09: ``*`` and ``?``; equality without them."""
    if not re.search(r"[*?]", pattern):
        return _c(value) == pattern
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return _c(value).rlike(f"^(?s:{body})$")


def topic_stem(topic: Column | str) -> Column:
    """C-11: what follows ``_T.``, or else the topic."""
    t = _c(topic)
    at = F.instr(t, "_T.")
    return F.when(at > 0, F.substr(t, at + 3)).otherwise(t)


def subscription_topic(subscription: Column | str) -> Column:
    """C-11."""
    return F.replace(_c(subscription), F.lit("_S."), F.lit("_T."))


#: Transports, the strongest first.
TRANSPORTS = ("HTTP_PUBSUB", "KAFKA", "PUBSUB")


def transport(attributes: Column | str) -> Column:
    """C-12: the attribute ``transport``, else a name it contains, else PUBSUB."""
    a = F.coalesce(_c(attributes), F.lit(""))
    named = F.regexp_extract(a, '"transport"\\s*:\\s*"([^"]+)"', 1)
    found = F.when(a.contains("HTTP_PUBSUB"), "HTTP_PUBSUB").when(a.contains("KAFKA"), "KAFKA")
    return F.when(named != "", named).otherwise(F.coalesce(found, F.lit("PUBSUB")))


def hop_transport(transports: Column | str) -> Column:
    """C-13: of a set of transports, the only one or else the strongest."""
    t = F.array_distinct(_c(transports))
    strongest = functools.reduce(lambda rest, x: F.when(F.array_contains(t, x), x).otherwise(rest), reversed(TRANSPORTS), F.lit("PUBSUB"))
    return F.when(F.size(t) == 1, F.element_at(t, 1)).otherwise(strongest)


def parse_handler(handler: Column | str) -> Column:
    """C-14: struct of class and method, from ``C#m`` or ``pkg.C.m``."""
    h = F.trim(_c(handler))
    last = simple_name(h)
    dotted = h.contains(".") & last.rlike("^[a-z][A-Za-z0-9_]*$")
    return F.struct(
        F.when(h.contains("#"), class_part(h)).when(dotted, F.regexp_replace(h, r"\.[^.]+$", "")).otherwise(h).alias("class_fqn"),
        F.when(h.contains("#"), F.split_part(h, F.lit("#"), F.lit(2))).when(dotted, last).alias("method"),
    )


def env_lane(path: Column | str) -> Column:
    """C-15: the lane that a configuration path names: file profile, then folder; else ``unknown``."""
    p = F.lower(_c(path))
    lanes = r"(pdn|qa|prod|dev|pn[a-z0-9]*)"
    profile = F.regexp_extract(p, rf"application-{lanes}\.ya?ml$", 1)
    folder = F.regexp_extract(p, rf"(?:^|/){lanes}/", 1)
    return F.when(profile != "", profile).when(folder != "", folder).otherwise("unknown")


def module_name(path: Column | str) -> Column:
    """C-16: the folder above ``src/main``; null without one."""
    m = F.regexp_extract(_c(path), r"(?:^|.*/)([^/]+)/src/main/(?:resources|java|kotlin)/", 1)
    return F.nullif(m, F.lit(""))


def in_package(symbol: Column | str, prefix: str | None, node_type: Column | str | None = None) -> Column:
    """C-18: the class part has the prefix; messaging nodes pass."""
    if not prefix:
        return F.lit(True)
    own = F.startswith(class_part(symbol), F.lit(prefix))
    return own if node_type is None else own | _c(node_type).isin("TOPIC", "SUBSCRIPTION", "GATE")


def is_production_handler(fqn: Column | str) -> Column:
    """C-19."""
    return ~simple_name(class_part(fqn)).rlike("(Test|IT|IntTest)$") & ~_c(fqn).rlike(r"\.(inttest|test)\.")


def in_source_roots(source: Column | str, roots: Sequence[str]) -> Column:
    """C-20: in one of the folders; null sources fail, blank roots don't count, and without roots all pass."""
    s = F.replace(_c(source), F.lit("\\"), F.lit("/"))
    folders = [f"{r.replace(chr(92), '/').rstrip('/')}/" for r in roots if r and r.strip()]
    return F.coalesce(_any(F.startswith(s, F.lit(x)) for x in folders), F.lit(False)) if folders else F.lit(True)


def in_maven_scope(scope: Column | str, wanted: str | None) -> Column:
    """C-21: ``runtime`` takes ``compile`` too; ``all`` or nothing takes any."""
    w = (wanted or "").strip().lower()
    if w in ("", "all"):
        return F.lit(True)
    return F.lower(_c(scope)).isin(*(("compile", "runtime") if w == "runtime" else (w,)))


def gate_state(required: Column | str, live: Column | str) -> Column:
    """C-22."""
    r, v = _c(required), _c(live)
    same = F.when(F.lower(r).isin("true", "false"), F.lower(r) == F.lower(v)).otherwise(r == v)
    return F.when(v.isNull() | r.isNull(), "UNKNOWN").when(same, "OPEN").otherwise("CLOSED")


#: Method name beginnings that read, that write, and what writes wherever it stands; reads come first, others read.
READ_PREFIXES = ("find", "get", "is", "load", "count", "exists")
WRITE_PREFIXES = ("save", "insert", "mark", "update", "delete")
WRITE_PART = "persist"


def operation_of(method: Column | str) -> Column:
    """C-23."""
    m = F.lower(_c(method))
    writes = m.rlike(f"^({'|'.join(WRITE_PREFIXES)})") | m.contains(WRITE_PART)
    return F.when(writes & ~m.rlike(f"^({'|'.join(READ_PREFIXES)})"), "WRITE").otherwise("READ")


def accessor_kind(fqn: Column | str) -> Column:
    """C-24."""
    s = simple_name(fqn)
    return F.when(s.rlike("(Repository|Repo)$"), "REPOSITORY").when(s.rlike("Dao(Impl)?$"), "DAO").otherwise("OTHER")


def store_type(hint: Column | str) -> Column:
    """C-24: from a package or annotation."""
    h = F.lower(_c(hint))
    kinds = (("cassandra", "CASSANDRA"), ("mongo", "MONGODB"), ("bigquery", "BIGQUERY"), ("redis", "REDIS"))
    return functools.reduce(lambda rest, x: F.when(h.contains(x[0]), x[1]).otherwise(rest), reversed(kinds), F.lit("MARIADB"))


def camel_to_snake(name: Column | str) -> Column:
    """C-25: no underscore before a leading capital."""
    return F.lower(F.regexp_replace(_c(name), "(?<=[a-z0-9])([A-Z])", "_$1"))


def slug(text: Column | str) -> Column:
    """C-25."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def append_evidence(tags: Column | str, tag: str) -> Column:
    """C-26: an ordered set joined by ``+``, at most 255 characters."""
    old = F.filter(F.split(F.coalesce(_c(tags), F.lit("")), r"\+"), lambda t: t != "")
    return F.substring(F.array_join(F.array_distinct(F.array_append(old, F.lit(tag))), "+"), 1, 255)


def bounded_id(node_id: Column | str, most: int = 1024) -> Column:
    """C-27: longer ids keep a prefix and 8 bytes of their SHA-256."""
    x = _c(node_id)
    tail = F.concat(F.lit("::h:"), F.substring(F.sha2(x, 256), 1, 16))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 20), tail)).otherwise(x)


def is_class_fqn(fqn: Column | str) -> Column:
    """C-28."""
    return F.coalesce(_c(fqn).rlike(r"^[\w.$]+$") & (F.length(_c(fqn)) <= 500), F.lit(False))


def retry_delay_ms(attempt: Column | str, base_ms: int, most_ms: int = 600_000) -> Column:
    """C-29."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), _c(attempt) - 1), F.lit(float(most_ms))).cast("long")


def freshness_http(status: Column | str) -> Column:
    """C-30."""
    return F.when(_c(status) == "NOT_INDEXED", 404).when(_c(status) == "INDEXING", 202).otherwise(200)


def path_suffix_pattern(path: Column | str) -> Column:
    """C-31: a LIKE pattern for the last step of a path."""
    return F.concat(F.lit("%"), F.regexp_extract(_c(path), "(/?[^/]*)$", 1))


def json_strings(text: Column | str) -> Column:
    """C-32: an array of strings; empty for anything that isn't one."""
    return F.coalesce(F.from_json(_c(text), T.ArrayType(T.StringType()), {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def json_structs(text: Column | str, item: str) -> Column:
    """C-32: an array of ``item`` structs; empty for anything that isn't one."""
    kind = f"array<struct<{item}>>"
    return F.coalesce(F.from_json(_c(text), kind, {"mode": "PERMISSIVE"}), F.array().cast(kind))


def mermaid_id(node_id: Column | str) -> Column:
    """C-33: a short id that diagrams accept."""
    return F.concat(F.lit("n"), F.substring(F.sha2(_c(node_id), 256), 1, 10))


def mermaid_label(text: Column | str) -> Column:
    """C-33."""
    return F.regexp_replace(F.replace(_c(text), F.lit('"'), F.lit("'")), r"[\[\]{}|<>\n]", " ")


def like_any(value: Column | str, patterns: Sequence[str]) -> Column:
    """A-06: LIKE against any; ``_`` and ``%`` are wildcards wherever they come from."""
    return _any(_c(value).like(p) for p in patterns)
