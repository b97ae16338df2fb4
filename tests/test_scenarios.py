"""Scenarios of several participants against handlers, by a plain comparison of all with all."""

import random

from factloom.operators import consistency

SCENARIO = "service_id string, scenario_id string, pattern string, scope_kind string, scope_ref string, participants array<struct<physicalName:string,role:string>>"


def plain(scenarios, accesses):
    def names(t):
        t = t.lower().replace("_", "")
        return t

    out = set()
    handlers = {(s, h) for s, h, _, _ in accesses}
    for s, i, pattern, kind, ref, participants in scenarios:
        for hs, h in handlers:
            if hs != s:
                continue
            touched = {names(t) for a, b, _, t in accesses if (a, b) == (s, h)}
            written = {names(t) for a, b, o, t in accesses if (a, b, o) == (s, h, "WRITE")}
            needed = [names(p) for p, r in participants or [] if r in consistency.WRITTEN_ROLES]
            if pattern in consistency.CO_TABLE:
                if needed and all(n in written or f"{n}entity" in written for n in needed):
                    out.add((s, i, h, "CO_TABLE"))
            elif kind == "HANDLER" and (ref or "").split("#")[0] == h:
                out.add((s, i, h, "HANDLER"))
            elif any(names(p) in touched for p, _ in participants or []):
                out.add((s, i, h, "TABLE"))
    return out


def test_division_by_tables(spark):
    r = random.Random(4)
    tables = ["t_a", "tb", "TC", "td", "te"]
    accesses = [(r.choice("st"), f"a.H{r.randrange(12)}", r.choice(["READ", "WRITE", "WRITE"]), r.choice(tables)) for _ in range(60)]
    scenarios = []
    for n in range(40):
        parts = [(r.choice(tables), r.choice(["PRIMARY", "REQUIRED", "OPTIONAL", "SECONDARY"])) for _ in range(r.randrange(4))]
        scenarios.append((r.choice("st"), f"x{n}", r.choice([*consistency.CO_TABLE, "CROSS_STORE_WRITE"]), r.choice(["HANDLER", "SERVICE", None]), f"a.H{r.randrange(12)}#m", parts or None))
    got = consistency.match_scenarios(spark.createDataFrame(scenarios, SCENARIO), spark.createDataFrame(accesses, "service_id string, handler_class_fqn string, operation string, table_or_entity string"))
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(scenarios, accesses)
    assert {x[3] for x in rows} == {"CO_TABLE", "HANDLER", "TABLE"}
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
