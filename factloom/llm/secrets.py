"""Secrets in texts, with DataFrame functions only.

Three kinds by pattern (assign, access, hex) and one by entropy.  Spans are
code points of the text, the end exclusive.  A null text counts as empty.

Entropy: candidates are maximal runs of a class's characters that hold a digit.
A window slides over a candidate; its Shannon entropy follows from the sum of
c * log2(c) over the counts c of its characters, and a step changes only the
counts of the character that enters and of the one that leaves.  A candidate
with a window at the class's threshold or above is a span, unless an allow-list
pattern matches it or spans of other kinds cover the whole of it.

Rows are judged one by one: rows that repeat an id or a text each get their
spans, a null id is as good as any, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Group 2 must have 12 characters or more, group 0 of the others 18 and 16.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run, and each shorter one in it, fails as AKIA[A-Z0-9]+ of under 18 does
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "entropy")

#: Name, characters, window, least entropy in bits.
CLASSES = (("base64", "A-Za-z0-9+/_=-", 24, 3.9), ("hexadecimal", "0-9A-Fa-f", 32, 3.4))
#: Candidates that are no secrets: identifiers with words, plain numbers, placeholders, repeated characters.  What
#: surrounds a placeholder or a repeated character must be shorter than a window, else the candidate holds more than it.
#: Repeated groups are possessive, so that a match needs no stack, however long the candidate.
ALLOW = (
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z]++(?:[-_/=+][A-Za-z]++)*+[-_/]?[0-9]{1,4}$",
    r"(?i)^.{0,23}(?:example|sample|placeholder|xxxx|changeme|dummy).{0,23}$",
    r"^.{0,23}?(.)\1{7,}+.{0,23}$",
    r"(?i)^(?:abcdefghijklmnopqrstuvwxyz|0123456789|abcdef)++[=]*$",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
_SPANNED = "struct<start:int,kind:int,stop:int>"


def _class_pattern(chars: str, window: int) -> str:
    return rf"(?<![{chars}])(?=[{chars}]*[0-9])[{chars}]{{{window},}}+"


#: Items that :func:`_scan` folds into one list, and characters of a piece of text that is cut out of as a whole.
_RUN = 128
_PIECE = 1024


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """``out``: what ``step`` gives out for each item, and ``state``: the last one; ``step`` takes (state, item) and returns the next state and what to give out.

    What a fold keeps is copied with each item, lists with all they hold.  So
    items are folded in runs of _RUN: first for the state before each run alone,
    then each run by itself for what it gives out, and time grows with the
    items, not with their square.
    """
    places = lambda xs: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / _RUN).cast("int") - 1, F.lit(0)))
    # a list that is a column's value would be copied whole for each slice; what transform gives out is not
    runs = _once(F.transform(items, lambda x: x), lambda xs: F.transform(places(xs), lambda i: F.slice(xs, i * _RUN + 1, _RUN)))

    def over(s: Column, xs: Column) -> Column:
        after = F.aggregate(xs, s["state"], lambda t, x: step(t, x)[0])
        return F.struct(after.alias("state"), F.concat(s["before"], F.array(s["state"])).alias("before"))

    def one(s: Column, x: Column) -> Column:
        state, out = step(s["state"], x)
        return F.struct(state.alias("state"), F.concat(s["out"], F.array(out)).alias("out"))

    def given_out(r: Column) -> Column:
        return F.aggregate(r["run"], F.struct(r["before"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)["out"]

    def both(rs: Column) -> Column:
        states = F.aggregate(rs, F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("before")), over)
        return _once(states, lambda f: F.struct(F.flatten(F.transform(F.arrays_zip(rs.alias("run"), f["before"].alias("before")), given_out)).alias("out"), f["state"].alias("state")))

    return _once(runs, both)


def _located(kind: int, gaps: str, hits: str) -> Column:
    """Spans from what lies between matches and the matches themselves."""
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), F.transform(hits, F.length).alias("hit"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        stop = at + x["gap"] + x["hit"]
        return stop, F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))

    return _scan(pairs, F.lit(0), step, _SPANNED)["out"]


def _stretches(spans: Column, touching: bool) -> Column:
    """What sorted spans cover, as sorted stretches (kind -1) apart from each other; ``touching`` ones are joined or not."""
    none = F.lit(None).cast(_SPANNED)
    make = lambda a, b: F.struct(a.alias("start"), F.lit(-1).alias("kind"), b.alias("stop"))
    apart = (lambda x, at: x > at) if touching else (lambda x, at: x >= at)

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        new = s["stop"].isNull() | apart(x["start"], s["stop"])
        state = F.struct(F.when(new, x["start"]).otherwise(s["start"]).alias("start"), F.when(new, x["stop"]).otherwise(F.greatest(s["stop"], x["stop"])).alias("stop"))
        return state, F.when(new & s["stop"].isNotNull(), make(s["start"], s["stop"])).otherwise(none)

    def closed(done: Column) -> Column:
        last = done["state"]
        final = F.when(last["stop"].isNotNull(), make(last["start"], last["stop"])).otherwise(none)
        return F.filter(F.concat(done["out"], F.array(final)), lambda x: x.isNotNull())

    return _once(_scan(spans, F.lit(None).cast("struct<start:int,stop:int>"), step, _SPANNED), closed)


def _not_covered(spans: Column, stretches: Column) -> Column:
    """Those sorted ``spans`` that no stretch covers whole, each once."""

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        stretch = x["kind"] < 0
        again = s["last"].eqNullSafe(x)
        out = F.when(stretch | again | (x["stop"] <= s["at"]), F.lit(None)).otherwise(x)
        return F.struct(F.when(stretch, x["stop"]).otherwise(s["at"]).alias("at"), x.alias("last")), out

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPANNED).alias("last"))
    return F.filter(_scan(F.array_sort(F.concat(stretches, spans)), start, step, _SPANNED)["out"], lambda x: x.isNotNull())


#: Codes of a class's characters run from U+002B (plus) to U+007A (z); a character's place in the counts is its code less this.
_BEFORE = 42
_PLACES = 80


def window_entropy(text: Column, window: int) -> Column:
    """The largest entropy of a window of ``text``, which has at least ``window`` characters (78 at most).

    The text is taken apart once, into events: a character enters, or (negative)
    the one ``window`` before it leaves.  The fold keeps the counts as a string
    with one place for each character, "0" and up, and an event changes one
    place and the sum, so a step costs the same however long the text is.
    """
    codes = F.transform(F.split(text, ""), F.ascii)
    pairs = F.arrays_zip(codes.alias("enters"), F.concat(F.array_repeat(F.lit(0), window), codes).alias("leaves"))
    events = F.filter(
        F.flatten(F.transform(F.filter(pairs, lambda x: x["enters"].isNotNull()), lambda x: F.array(-x["leaves"], x["enters"]))), lambda e: e != 0
    )
    weighed = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))  # c * log2(c)

    def step(s: Column, e: Column) -> Column:
        place = F.abs(e) - _BEFORE
        count = F.ascii(F.substring(s["counts"], place, 1)) - 48
        change = F.when(e > 0, 1).otherwise(-1)
        total = s["total"] - F.element_at(weighed, count + 1) + F.element_at(weighed, count + change + 1)
        inside = s["inside"] + change
        best = F.when(inside == window, F.greatest(s["best"], F.lit(math.log2(window)) - total / window)).otherwise(s["best"])
        counts = F.overlay(s["counts"], F.char(count + change + 48), place)
        return F.struct(counts.alias("counts"), inside.alias("inside"), total.alias("total"), best.alias("best"))

    start = F.struct(F.lit("0" * _PLACES).alias("counts"), F.lit(0).alias("inside"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.round(F.aggregate(events, start, step)["best"], 6)


def _is_secret(window: int, least: float) -> Callable[[Column], Column]:
    def test(x: Column) -> Column:
        allowed = F.greatest(*(x["hit"].rlike(p) for p in ALLOW))
        return F.when(allowed, False).otherwise(window_entropy(x["hit"], window) >= least)

    return test


def secret_spans(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with ``spans``: start, kind (its place in KINDS), stop; sorted.

    One pass, nothing shuffled.  A text is taken apart only where a kind's
    pattern matches at all.
    """
    text = F.coalesce("row.text", F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {name: _class_pattern(chars, w) for name, chars, w, _ in CLASSES}
    df = docs.select(F.struct(*docs.columns).alias("row"))
    cut = df.select(
        "row",
        *(
            F.when(text.rlike(p), F.transform(F.split(text, p, -1), F.length)).otherwise(F.array().cast("array<int>")).alias(f"{n}_gaps")
            for n, p in patterns.items()
        ),
        *(
            F.when(text.rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"{n}_hits")
            for n, p in patterns.items()
        ),
        F.when(text.rlike(ASSIGN), F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length)).otherwise(F.array().cast("array<int>")).alias("assign_sizes"),
    )
    base = {n: _located(k, f"{n}_gaps", f"{n}_hits") for k, n in enumerate(KINDS[:3])}
    base["assign"] = F.transform(
        F.filter(F.arrays_zip(base["assign"].alias("span"), F.col("assign_sizes").alias("size")), lambda x: x["size"] >= 12), lambda x: x["span"]
    )
    found = []
    for name, _, window, least in CLASSES:
        spans = F.arrays_zip(_located(3, f"{name}_gaps", f"{name}_hits").alias("span"), F.col(f"{name}_hits").alias("hit"))
        found.append(F.transform(F.filter(spans, _is_secret(window, least)), lambda x: x["span"]))
    parts = cut.select("row", F.array_sort(F.concat(base["assign"], base["access"], base["hex"])).alias("base"), F.concat(*found).alias("more"))
    added = F.when(F.size("more") == 0, F.col("more")).otherwise(_not_covered(F.col("more"), _stretches(F.col("base"), touching=True)))
    return parts.select("row", F.array_sort(F.concat("base", added)).alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``.

    What lies between stretches is cut out of pieces of _PIECE characters, so
    that no cut starts counting at the text's start.
    """

    def within(pieces: Column, i: Column, a: Column, b: Column) -> Column:
        return F.substring(F.coalesce(F.get(pieces, i), F.lit("")), a - i * _PIECE + 1, b - a)

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / _PIECE).cast("int"), F.floor(b / _PIECE).cast("int")
        middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        long = F.concat(within(pieces, first, a, (first + 1) * _PIECE), middle, within(pieces, last, last * _PIECE, b))
        return F.when(b <= a, "").when(first == last, within(pieces, first, a, b)).otherwise(long)

    def whole(v: Column) -> Column:
        starts, stops = F.transform(v["cut"], lambda x: x["start"]), F.transform(v["cut"], lambda x: x["stop"])
        gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), stops).alias("a"), F.concat(starts, F.array(v["size"])).alias("b"))
        return F.array_join(F.transform(gaps, lambda g: between(v["pieces"], g["a"], g["b"])), mark)

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))
    known = F.struct(pieces.alias("pieces"), _stretches(spans, touching=False).alias("cut"), F.length(text).alias("size"))
    return F.when(F.size(spans) == 0, text).otherwise(_once(known, whole))


def secret_digests(found: DataFrame) -> DataFrame:
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "row.doc_id",
        *(kind(k).alias(f"n_{n}") for k, n in enumerate(KINDS[:3])),
        F.sha2(spelled(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        kind(3).alias("n_entropy"),
    )
