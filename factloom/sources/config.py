"""Configuration files as entries (C-17), with placeholders filled in and the profile they are for (C-15).

A YAML file is read on its own into dotted keys; lists of plain values are one
entry, ``[a, b]``, and their items entries of ``key[0]``, ``key[1]``.  Blocks of a
ConfigMap's ``data`` that hold YAML are documents of their own, with source
``path#name``.  This is the part of YAML that configuration is written in:
nested keys, lists, quoted and plain values, ``|`` and ``>`` blocks, ``[a, b]``,
comments, several documents; anchors, tags and ``{a: b}`` stay text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import env_lane
from ..session import staged

_KEY = re.compile(r"""^(\s*)((?:-\s+)*)(?:("(?:[^"\\]|\\.)*"|'[^']*'|[^\s#:'"\[{&*!|>-][^:#]*?|-[^\s:][^:#]*?|[^\s'":]+?)\s*:(?:\s+|$))?(.*)$""")
_LANES = ("pdn", "qa", "prod", "dev")


def _scalar(raw: str) -> str:
    """A value without its comment and quotes."""
    raw = raw.strip()
    if raw[:1] in "\"'":
        end = re.match(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\']|\'\')*)\'', raw)
        if end:
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), end[1]) if end[1] is not None else end[2].replace("''", "'")
    return re.split(r"(?:^|\s)#", raw, maxsplit=1)[0].strip()


def read_yaml(text: str) -> list[tuple[str, str]]:
    """Dotted keys and values of a text, in their order; a key that comes again counts anew."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[int, str]] = []
    counts: dict[tuple[str, int], int] = {}
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].rstrip("\r")
        i += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.startswith(("---", "...")) and not line[3:].strip():
            stack, counts = [], {}
            continue
        m = _KEY.match(line)
        indent, dashes, key, rest = len(m[1]), m[2], m[3], m[4]
        if line.strip() == "-":
            dashes, key, rest = "- ", None, ""
        at = indent
        for _ in range(dashes.count("-")):
            # a list may stand at its key's own indentation
            while stack and (stack[-1][0] > at or stack[-1][0] == at and stack[-1][1].startswith("[")):
                stack.pop()
            above = ".".join(k for _, k in stack)
            n = counts.get((above, at), 0)
            counts[above, at] = n + 1
            stack.append((at, f"[{n}]"))
            at += 2
        if key is None and not dashes:
            continue
        if key is not None:
            at = indent + len(dashes)
            while stack and (stack[-1][0] > at or stack[-1][0] == at and not (dashes and stack[-1][1].startswith("["))):
                stack.pop()
            name = _scalar(key)
            stack.append((at, name))
            whole = ".".join(k for _, k in stack)
            for known in [c for c in counts if c[0] == whole]:
                del counts[known]
        path = ".".join(k for _, k in stack).replace(".[", "[")
        value = rest.strip()
        if re.match(r"^[|>][+-]?\d*\s*(?:#.*)?$", value):
            block: list[str] = []
            base = indent + len(dashes)
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > base):
                block.append(lines[i].rstrip("\r"))
                i += 1
            pad = min((len(x) - len(x.lstrip(" ")) for x in block if x.strip()), default=0)
            body = [x[pad:] for x in block]
            while body and not body[-1].strip():
                body.pop()
            out.append((path, "\n".join(body) if value[0] == "|" else " ".join(x.strip() for x in body)))
        elif re.match(r"^\[.*\]\s*(?:#.*)?$", value):
            items = [_scalar(x) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'[^']*'|[^,\]]+)""", value[1 : value.rindex("]")])]
            out.append((path, f"[{', '.join(items)}]"))
            out += [(f"{path}[{n}]", x) for n, x in enumerate(items)]
        elif value and _scalar(value):
            out.append((path, _scalar(value)))
        elif value[:1] in ("'", '"') and value:
            out.append((path, ""))
        if key is None and dashes and not value:
            continue
    lists: dict[str, list[str]] = {}
    for path, value in out:
        m = re.match(r"^(.*)\[\d+\]$", path)
        if m and not m[1].endswith("]"):
            lists.setdefault(m[1], []).append(value)
    have = {p for p, _ in out}
    return out + [(p, f"[{', '.join(v)}]") for p, v in lists.items() if p not in have]


def _documents(path: str, text: str) -> list[tuple[str, str, str]]:
    entries = read_yaml(text)
    rows = [(path, k, v) for k, v in entries]
    if any(k == "kind" and v.lower() == "configmap" for k, v in entries):
        for k, v in entries:
            if k.startswith("data.") and "\n" in v and re.search(r"(?m)^\s*[\w.\-]+\s*:(?:\s|$)", v):
                rows += [(f"{path}#{k[5:]}", a, b) for a, b in read_yaml(v)]
    return rows


def config_entries(files: DataFrame) -> DataFrame:
    """``path, source, position, key, value`` of YAML files; of a key that comes again in a source the last stays, as readers of YAML have it."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<struct<source:string,key:string,value:string>>")
    def entries(path, text):
        import pandas as pd

        return pd.Series([[{"source": s, "key": k, "value": v} for s, k, v in _documents(p, t or "")] for p, t in zip(path, text)])

    yaml = files.filter(F.lower("path").rlike(r"\.ya?ml$"))
    each = yaml.select("path", F.posexplode(entries("path", "text")).alias("position", "e")).select("path", "e.source", "position", "e.key", "e.value")
    last = each.groupBy("path", "source", "key").agg(F.max_by(F.struct("position", "value"), "position").alias("x"))
    return last.select("path", "source", F.col("x.position").alias("position"), "key", F.col("x.value").alias("value"))


#: The innermost placeholder of a value: a name, and what stands for it where it is not set.
_PLACEHOLDER = r"\$\{([^${}:]+)(?::([^{}]*))?\}"
#: What an opening of a placeholder that nothing can fill is written as while others are filled.
_OPEN = "\ue000"


def filled(entries: DataFrame, scope: list[str]) -> DataFrame:
    """``entries(scope..., key, value)``, a key once in its scope, with placeholders filled from the scope's own entries.

    ``${a:b}`` is the value of ``a``, else ``b``, which may hold placeholders itself.
    A round fills those whose key has a value without placeholders, or is not
    set; so chains are followed to their ends whatever their length, and what is
    left in the end are placeholders that lead back to themselves.  These, and
    those that are not set and have no default, stay as they are written.
    """
    keys = [*scope, "key"]
    now = staged(entries.withColumn("value", F.coalesce("value", F.lit(""))), "config-values")
    while True:
        open_ = F.contains("value", F.lit("${"))
        names = F.array_distinct(F.arrays_zip(
            F.regexp_extract_all("value", F.lit(_PLACEHOLDER), F.lit(0)).alias("text"), F.regexp_extract_all("value", F.lit(_PLACEHOLDER), F.lit(1)).alias("name"),
            F.regexp_extract_all("value", F.lit(_PLACEHOLDER), F.lit(2)).alias("other"),
        ))
        wanted = now.filter(open_).select(*keys, F.explode(names).alias("p"))
        known = now.select(*scope, F.col("key").alias("__name"), F.when(~open_, F.col("value")).alias("__value"), F.lit(True).alias("__set"))
        met = wanted.withColumn("__name", F.trim("p.name")).join(known, [*scope, "__name"], "left")
        literal = F.when(F.contains("p.text", F.lit(":")), F.col("p.other")).otherwise(F.replace("p.text", F.lit("${"), F.lit(_OPEN)))
        ready = met.filter(F.col("__set").isNull() | F.col("__value").isNotNull()).withColumn("by", F.coalesce("__value", literal))
        changes = ready.groupBy(*keys).agg(F.collect_list(F.struct(F.col("p.text").alias("text"), "by")).alias("__changes"))
        changes = staged(changes, "config-changes")
        if changes.isEmpty():
            break
        replaced = F.aggregate(F.coalesce("__changes", F.array().cast("array<struct<text:string,by:string>>")), F.col("value"), lambda v, c: F.replace(v, c["text"], c["by"]))
        now = staged(now.join(changes, keys, "left").withColumn("value", replaced).drop("__changes"), "config-values")
    return now.withColumn("value", F.replace("value", F.lit(_OPEN), F.lit("${")))


def lanes(files: DataFrame, entries: DataFrame) -> DataFrame:
    """C-15: ``path, source, env_lane``: the lane the path names, else the name of a ConfigMap's block, else the active profile, else the ConfigMap's name; else ``unknown``."""
    per = entries.groupBy("path", "source").agg(
        F.min(F.when(F.col("key") == "spring.profiles.active", F.col("value"))).alias("active"), F.min(F.when(F.col("key").isin("metadata.name", "metadata.namespace"), F.col("value"))).alias("named")
    )
    of_path = per.groupBy("path").agg(F.min("active").alias("path_active"), F.min("named").alias("path_named"))

    def lane(text: Column) -> Column:
        found = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), rf"(?:^|[^a-z0-9])({'|'.join(_LANES)}|pn[a-z0-9]+)(?:$|[^a-z0-9])", 1)
        return F.nullif(found, F.lit(""))

    block = F.when(F.contains("source", F.lit("#")), env_lane(F.regexp_extract("source", "#(.*)$", 1)))
    by_path, by_block = F.nullif(env_lane("path"), F.lit("unknown")), F.nullif(block, F.lit("unknown"))
    out = per.join(of_path, "path")
    return out.select("path", "source", F.coalesce(by_path, by_block, lane(F.col("active")), lane(F.col("path_active")), lane(F.col("path_named")), F.lit("unknown")).alias("env_lane"))
