"""Java sources read into declarations, over Arrow batches (I-01, I-03, I-25).

A file becomes tokens, of which comments are none and strings are one each, and
tokens become declarations by matching braces, brackets and generics.  What
stands in comments or strings is therefore no declaration, no annotation and no
call, and a nested class has members of its own.  A file is read once and on its
own; everything after that is DataFrame operations on the arrays of its row.

Files that have no type, and files whose braces or brackets don't match, say so
in ``problem``.  A null text is an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_STRING = r"""\"\"\"(?:[^\\]|\\.)*?(?:\"{3}|\Z)|\"[^"\\\n]*(?:\\.[^"\\\n]*)*(?:\"|(?=\n)|\Z)|'[^'\\\n]*(?:\\.[^'\\\n]*)*(?:'|(?=\n)|\Z)"""
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
#: White space, then a token, whose first character tells its kind; an empty one at the end.
_TOKEN = re.compile(rf"\s*((?:[^\W\d]|\$)[\w$]*|[(){{}}\[\];,@<>=]|{_STRING}|\d[\w.]*|{_COMMENT}|->|::|\.\.\.|.|\Z)", re.S)
#: Comments, and the strings in which there are none.
_APART = re.compile(rf"{_COMMENT}|{_STRING}", re.S)
MODIFIERS = frozenset("public protected private static final abstract default synchronized native transient volatile strictfp sealed".split())
_TYPES = frozenset(["class", "interface", "enum", "record"])
#: Words that stand before a bracket and call nothing.
_NO_CALLS = frozenset("if for while switch catch synchronized return new try assert throw else do case yield instanceof super this".split())
_PAIRS = {"(": ")", "{": "}", "[": "]"}
_BRACKETS = frozenset("(){}[]")
#: What annotations and modifiers start with.
_MARKS = MODIFIERS | {"@", "non"}
#: Empty tokens after the last one; as many are read before the first.
_PADS = 16
MOST_CALLS = 200

_ANNOTATIONS = "array<struct<name:string,args:string>>"
TYPES = f"array<struct<fqn:string,kind:string,name:string,is_primary:boolean,modifiers:array<string>,annotations:{_ANNOTATIONS},extended:array<string>,implemented:array<string>,constants:array<string>,doc:string>>"
MEMBERS = (
    f"array<struct<owner:string,is_primary:boolean,kind:string,name:string,type:string,modifiers:array<string>,annotations:{_ANNOTATIONS},"
    f"params:array<struct<type:string,name:string,annotations:{_ANNOTATIONS}>>,thrown:array<string>,initial:string,doc:string,"
    "calls:array<struct<scope:string,chained:string,name:string,args:array<string>>>>>"
)
#: What a row of files gets: its text without comments, its package and imports, its types and their members, and what is wrong with it.
ADDED = {"code": "string", "package": "string", "imports": "array<string>", "types": TYPES, "members": MEMBERS, "problem": "string"}


class _Kinds(dict):
    """The kind of a token by its first character: a text is a string, a character or a text block."""

    def __missing__(self, c: str) -> str:
        word = c.isalnum() and not c.isdecimal() or c in "_$"
        self[c] = "word" if word else "number" if c.isdecimal() else "text" if c in "\"'" else "sign"
        return self[c]


_KINDS = _Kinds()


def uncommented(text: str) -> str:
    """``text`` with each comment replaced by a space; line ends stay."""
    return _APART.sub(lambda m: " " + "\n" * m[0].count("\n") if m[0][0] == "/" else m[0], text) if "/" in text else text


class Reader:
    """Declarations of one file; without ``members``, its types alone; without ``calls`` or ``args``, members without theirs.

    ``t`` and ``w``, the tokens and which of them are words, go on past both
    ends, so places beside a token need no check.
    """

    def __init__(self, text: str, members: bool = True, calls: bool = True, args: bool = True):
        self.reads_members, self.reads_calls, self.reads_args = members, calls, args
        #: The text as :func:`uncommented` gives it.
        self.code = uncommented(text) if "//" in text or "/*" in text else text
        # only documentation is looked for among the tokens
        documented = "/**" in text
        self.tokens: list[str] = _TOKEN.findall(text if documented else self.code)
        while self.tokens and not self.tokens[-1]:
            self.tokens.pop()
        self.docs: dict[int, str] = {}
        if documented:
            self._drop_comments()
        self.kinds: list[str] = [_KINDS[t[0]] for t in self.tokens]
        self.n = len(self.tokens)
        self.t = self.tokens + [""] * _PADS
        self.w = [k == "word" for k in self.kinds] + [False] * _PADS
        self.closes: dict[int, int] = {}
        self.problem: str | None = None
        self._match()
        self.package, self.imports = "", []
        self.types: list[dict] = []
        self.members: list[dict] = []
        self._file()
        if not self.types and not self.problem:
            self.problem = "no type"

    def _drop_comments(self) -> None:
        kept: list[str] = []
        for t in self.tokens:
            if t[0] != "/" or t[:2] not in ("//", "/*"):
                kept.append(t)
            elif t.startswith("/**"):
                self.docs[len(kept)] = t
        self.tokens = kept

    def _match(self) -> None:
        """The place of each closing bracket, by that of its opening one."""
        stack: list[int] = []
        tokens, closes = self.tokens, self.closes
        for i, t in [(i, t) for i, t in enumerate(tokens) if t in _BRACKETS]:
            if t in _PAIRS:
                stack.append(i)
            elif not stack or _PAIRS[tokens[stack[-1]]] != t:
                self.problem = self.problem or f"unmatched {t}"
            else:
                closes[stack.pop()] = i
        for i in stack:
            self.problem = self.problem or f"unmatched {self.tokens[i]}"
            self.closes[i] = self.n

    def after(self, i: int) -> int:
        """The place after a bracket that opens at ``i`` has closed."""
        return self.closes.get(i, i) + 1

    def source(self, a: int, b: int) -> str:
        """Tokens put together again, words apart by a space."""
        if b - a == 1 and b <= self.n:
            return self.tokens[a]
        out = []
        for i in range(a, min(b, self.n)):
            if out and self.kinds[i] in ("word", "number") and self.kinds[i - 1] in ("word", "number"):
                out.append(" ")
            out.append(self.tokens[i])
        return "".join(out)

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """What commas separate between ``a`` and ``b``, outside inner brackets and generics."""
        out, start, i = [], a, a
        while i < b:
            t = self.tokens[i]
            if t in _PAIRS:
                i = self.after(i)
                continue
            if t == "<" and (end := self.generics(i)) and end <= b:
                i = end
                continue
            if t == ",":
                out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return out

    def generics(self, i: int) -> int:
        """The place after ``<...>`` that opens at ``i``; 0 where it is no list of types."""
        depth, start = 0, i
        while i < self.n:
            t = self.tokens[i]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif t == "@" or t in ("?", ",", ".", "&", "[", "]"):
                pass
            elif t == "(" and self.t[start] == "<" and self.w[i - 1] and self.t[i - 2] == "@":
                i = self.after(i)
                continue
            elif self.kinds[i] != "word":
                return 0
            i += 1
        return 0

    def annotations(self, i: int) -> tuple[int, list[dict], list[str]]:
        """Annotations and modifiers from ``i`` on."""
        found, modifiers = [], []
        while True:
            t = self.t[i]
            if t not in _MARKS:
                return i, found, modifiers
            if t == "@" and self.w[i + 1] and self.t[i + 1] != "interface":
                a = i + 1
                i = a + 1
                while self.t[i] == "." and self.w[i + 1]:
                    i += 2
                name = self.source(a, i).rsplit(".", 1)[-1]
                args = ""
                if self.t[i] == "(":
                    args = self.source(i + 1, self.closes[i])
                    i = self.after(i)
                found.append({"name": name, "args": args})
            elif t in MODIFIERS and not (t == "default" and self.t[i + 1] in (":", "->")):
                modifiers.append(t)
                i += 1
            elif t == "non" and self.t[i + 1] == "-":
                i += 3
            else:
                return i, found, modifiers

    def type_at(self, i: int) -> int:
        """The place after a type that starts at ``i``; ``i`` where none does."""
        start = i
        if self.t[i] in _MARKS:
            i, _, _ = self.annotations(i)
        if not self.w[i]:
            return start
        while True:
            i += 1
            t = self.t[i]
            if t == "<":
                i = self.generics(i)
                if not i:
                    return start
                t = self.t[i]
            if t == "." and self.w[i + 1]:
                i += 1
                continue
            break
        while t == "[" and self.t[i + 1] == "]":
            i += 2
            t = self.t[i]
        return i + 1 if t == "..." else i

    def doc(self, i: int) -> str | None:
        """First sentence-like part of a documentation comment before ``i``, without its stars and tags."""
        raw = self.docs.get(i) if self.docs else None
        if raw is None:
            return None
        lines = (re.sub(r"^\s*\*+ ?", "", x).strip() for x in raw[3:].removesuffix("*/").split("\n"))
        kept: list[str] = []
        for line in lines:
            if line.startswith("@"):
                break
            kept.append(line)
        return "\n".join(kept).strip() or None

    def _file(self) -> None:
        i, n = 0, self.n
        bodies: list[tuple[int, int, str, str, bool, str]] = []
        while i < n:
            start = i
            found, modifiers = [], []
            if self.t[i] in _MARKS:
                i, found, modifiers = self.annotations(i)
            t = self.t[i]
            if t in ("package", "import"):
                end = i
                while end < n and self.t[end] != ";":
                    end += 1
                if t == "package":
                    self.package = "".join(self.tokens[i + 1 : end])
                else:
                    self.imports.append(self.source(i + 1, end))
                i = end + 1
            elif self._opens_type(i):
                i = self._type(i, start, found, modifiers, "", bodies)
            elif t in _PAIRS:
                i = self.after(i)
            else:
                i += 1
        # the primary type is the first class or interface, else the first enum, else the first type
        top = [x for x in self.types if x["name"] == x["fqn"][len(self.package) :].lstrip(".")]
        rank = {"class": 0, "interface": 0, "enum": 1}
        main = min(top, key=lambda x: rank.get(x["kind"], 2), default=None)
        while bodies:
            a, b, owner, name, _, kind = bodies.pop(0)
            self._body(a, b, owner, name, kind, bodies)
        for x in self.types:
            x["is_primary"] = x is main
        for m in self.members:
            m["is_primary"] = main is not None and m["owner"] == main["fqn"]

    def _opens_type(self, i: int) -> bool:
        t = self.t[i]
        if t == "@":
            return self.t[i + 1] == "interface"
        if t not in _TYPES or not self.w[i + 1]:
            return False
        return t != "record" or self.t[i + 2] in ("(", "<")

    def _type(self, i: int, start: int, found: list, modifiers: list, outer: str, bodies: list) -> int:
        kind = "annotation" if self.t[i] == "@" else self.t[i]
        i += 2 if kind == "annotation" else 1
        name = self.t[i]
        i += 1
        if self.t[i] == "<":
            i = self.generics(i) or i + 1
        params: tuple[int, int] | None = None
        if self.t[i] == "(":
            params = (i + 1, self.closes[i])
            i = self.after(i)
        lists: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        part = ""
        while i < self.n and self.t[i] not in ("{", ";"):
            if self.t[i] in lists and self.w[i]:
                part = self.t[i]
                i += 1
                continue
            end = self.type_at(i)
            if part and end > i:
                lists[part].append(self.source(i, end))
                i = end
            else:
                i += 1
        fqn = f"{outer}.{name}" if outer else f"{self.package}.{name}" if self.package else name
        self.types.append({
            "fqn": fqn, "kind": kind, "name": name, "is_primary": False, "modifiers": modifiers, "annotations": found, "extended": lists["extends"],
            "implemented": lists["implements"], "constants": [], "doc": self.doc(start),
        })
        if params and kind == "record":
            self._member("CONSTRUCTOR", fqn, name, None, [], [], params, start)
        if self.t[i] != "{":
            return i + 1
        end = self.closes[i]
        a = self._constants(i + 1, end, self.types[-1]["constants"]) if kind == "enum" else i + 1
        bodies.append((a, end, fqn, name, False, kind))
        return end + 1

    def _constants(self, i: int, end: int, out: list[str]) -> int:
        while i < end and self.t[i] != ";":
            i, _, _ = self.annotations(i)
            if self.w[i]:
                out.append(self.t[i])
            i += 1
            while i < end and self.t[i] not in (",", ";"):
                i = self.after(i) if self.t[i] in _PAIRS else i + 1
            i += self.t[i] == ","
        return min(i + 1, end)

    def _member(self, kind, owner, name, type_, modifiers, found, params, start, body=None, thrown=(), initial=None) -> None:
        if not self.reads_members:
            return
        listed = []
        for a, b in self.split(*params) if params else ():
            own: list[dict] = []
            if self.t[a] in _MARKS:
                a, own, _ = self.annotations(a)
            end = self.type_at(a)
            if end > a and self.w[end]:
                listed.append({"type": self.source(a, end), "name": self.t[end], "annotations": own})
        self.members.append({
            "owner": owner, "is_primary": False, "kind": kind, "name": name, "type": type_, "modifiers": modifiers, "annotations": found, "params": listed,
            "thrown": list(thrown), "initial": initial, "doc": self.doc(start), "calls": self._calls(*body) if body and self.reads_calls else [],
        })

    def _body(self, i: int, end: int, owner: str, name: str, kind: str, bodies: list) -> None:
        while i < end:
            start = i
            found, modifiers = [], []
            if self.t[i] in _MARKS:
                i, found, modifiers = self.annotations(i)
            if kind == "interface" and "private" not in modifiers and "public" not in modifiers:
                modifiers = [*modifiers, "public"]
            if self._opens_type(i):
                i = self._type(i, start, found, modifiers, owner, bodies)
                continue
            if self.t[i] == "<":
                i = self.generics(i) or i + 1
            if self.t[i] == name and self.w[i] and self.t[i + 1] in ("(", "{"):
                params = (i + 2, self.closes[i + 1]) if self.t[i + 1] == "(" else None
                i = self.after(i + 1) if params else i + 1
                i, thrown, body = self._rest(i, end)
                if params:
                    self._member("CONSTRUCTOR", owner, name, None, modifiers, found, params, start, body, thrown)
                continue
            to = self.type_at(i)
            if to == i or not self.w[to]:
                i = self.after(i) if self.t[i] in _PAIRS else i + 1
                continue
            type_, called = self.source(i, to), self.t[to]
            if self.t[to + 1] == "(":
                params = (to + 2, self.closes[to + 1])
                i, thrown, body = self._rest(self.after(to + 1), end)
                self._member("METHOD", owner, called, type_, modifiers, found, params, start, body, thrown)
                continue
            i = to
            while i < end:
                names = self.t[i]
                i += 1
                while self.t[i] == "[":
                    i = self.after(i)
                initial = None
                if self.t[i] == "=":
                    a = i + 1
                    i = a
                    while i < end and self.t[i] not in (",", ";"):
                        skip = self.generics(i) if self.t[i] == "<" else 0
                        i = skip or (self.after(i) if self.t[i] in _PAIRS else i + 1)
                    initial = self.source(a, i)[:4000]
                self._member("FIELD", owner, names, type_, modifiers, found, None, start, initial=initial)
                if self.t[i] != ",":
                    i += self.t[i] == ";"
                    break
                i += 1

    def _rest(self, i: int, end: int) -> tuple[int, list[str], tuple[int, int] | None]:
        """After a parameter list: what is thrown, and the body if there is one."""
        thrown = []
        if self.t[i] == "throws":
            i += 1
            while i < end and self.t[i] not in ("{", ";"):
                to = self.type_at(i)
                if to > i:
                    thrown.append(self.source(i, to))
                i = max(to, i + 1)
        while i < end and self.t[i] not in ("{", ";"):
            i = self.after(i) if self.t[i] in "([" else i + 1
        if self.t[i] == "{":
            return self.after(i), thrown, (i + 1, self.closes[i])
        return i + 1, thrown, None

    def _calls(self, a: int, b: int) -> list[dict]:
        """Calls in a body, in order: what they are called on, or the call they are chained to, and their arguments."""
        out: list[dict] = []
        openings: dict[int, int] = {}
        t, w = self.t, self.w
        for i in range(a, min(b, self.n)):
            if t[i] != "(":
                continue
            openings[self.closes[i]] = i
            k = i - 1
            if not w[k] or t[k] in _NO_CALLS:
                continue
            scope, chained = None, None
            if t[k - 1] == ".":
                p = k - 2
                if t[p] == ")" and p in openings:
                    before = openings[p] - 1
                    chained = t[before] if w[before] else ""
                else:
                    s = p
                    while w[s] and t[s - 1] == "." and w[s - 2]:
                        s -= 2
                    scope = self.source(s, p + 1) if w[p] and t[s - 1] != "." else None
                    chained = None if scope else ""
            elif t[k - 1] == "new" or t[k - 1] in ("::", "@"):
                continue
            elif w[k - 1] and t[k - 1] not in _NO_CALLS:
                continue
            args = [self.source(x, y)[:2000] for x, y in self.split(i + 1, self.closes[i])] if self.reads_args else None
            out.append({"scope": scope, "chained": chained, "name": t[k], "args": args})
            if len(out) >= 5 * MOST_CALLS:
                break
        return out


#: So many files, or so many characters and one file more, become declarations at once in a task.
SLICE_FILES, SLICE_CHARS = 256, 1_000_000


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of texts that are held as declarations together."""
    start, chars = 0, 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        chars += n or 0
        if chars >= SLICE_CHARS or i + 1 - start == SLICE_FILES:
            yield start, i + 1 - start
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts) - start


def read_sources(files: DataFrame, members: bool = True, calls: bool = True, args: bool = True) -> DataFrame:
    """``files(path, text, ...)`` with the columns of :data:`ADDED`, all or all but the members; nothing is shuffled.

    Where calls are not read, members have none; where their arguments are not, those are null.
    A task reads the files of its partition, a slice at a time, so rows from
    which files are made should be :func:`~factloom.session.dealt` before.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    own = [c for c in files.columns if c not in ADDED]
    base = files.select(*own)
    added = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in ADDED.items() if members or n != "members"))
    arrow = to_arrow_schema(added)
    place = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in _slices(batch.column(place)):
                part = batch.slice(start, n)
                rows: dict[str, list] = {n: [] for n in ADDED}
                for text in part.column(place).to_pylist():
                    r = Reader(text or "", members, calls, args)
                    for name, v in zip(ADDED, (r.code, r.package, r.imports, r.types, r.members, r.problem)):
                        rows[name].append(v)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(rows[f.name], type=f.type) for f in arrow)], names=[*part.schema.names, *arrow.names]
                )

    return base.mapInArrow(run, StructType(base.schema.fields + added.fields))
