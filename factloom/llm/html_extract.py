"""Main text of web pages, by templates deduced from the pages of each host.

1. Outline.  A page is read into a tree of elements.  A token is an element with
   its path (tags, classes and ids without numbers) or a text with the path it
   stands at.
2. Classes.  For each host, tokens with the same occurrence vector (how often on
   which page) are one equivalence class.  Vectors are compared by sums of
   hashes of (page, count), which combine before any shuffle, so no vector is
   ever gathered, however many pages a host has.
3. Template.  Classes on at least half of a host's pages are candidates.  A class
   is valid if its tokens follow each other in the same order wherever they
   occur, and nests if that is always at the same place of the same other class.
   Both are checked on every page and reduced to minima and maxima.  The classes
   that pass, nested in the one of tokens that stand once on every page, are
   the template; texts that are not in it fill its slots.
4. Region.  The deepest container of the template that holds at least
   REGION_SHARE of the slots' text, an article or main element if one does.  What
   menus, headers, footers, forms, notices, adverts, comments and the like hold
   doesn't count: these are told by tag, role, class and id.
5. Text.  All blocks of the region, in page order, without the parts told in 4
   and without notices of the template: blocks whose text and element stand once
   on every page while the region's other text varies.  Other text that pages
   share stays, so passages that many articles repeat are kept.  A heading h1
   before the region is a part of the article unless the template has its text.

A host of fewer than LEAST_PAGES pages, without a valid region, or whose pages
are copies of each other has no template; its pages, and pages without their
host's region, give their outermost article, else main, else body.

Each row is a page of its own, also where page ids or urls repeat; pages without
a host are one host.  A null or empty html gives an empty text, as does a page
that holds nothing but markup.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, map_batches, staged

LEAST_PAGES = 4
SUPPORT = 0.5
REGION_SHARE = 0.9
#: Tokens a task counts before it hands them on (about 100 MB).
HELD_TOKENS = 400_000

# Fixed names of HTML and of common site layouts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header
    hgroup hr html legend li main menu nav noframes ol option p pre search section summary table tbody td tfoot th thead title tr ul""".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
APART = frozenset(
    "head nav header footer aside form script style noscript template iframe object svg canvas button select textarea menu dialog audio video map noembed noframes xmp title".split()
)
CONTAINERS = frozenset("body div section article main td center".split())
MAIN = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
WORDS_OF_COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
WORDS_OF_LAYOUT = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion sidebar navbar nav navigation menu
    menus breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe subscription share
    sharing social related recommended recommendations widget widgets pagination pager banner banners header hidden""".split()
)
_NAMED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|(?<==)\"[^\"]*(?:\"|\Z)|(?<==)'[^']*(?:'|\Z)|(?<== )\"[^\"]*(?:\"|\Z)|(?<== )'[^']*(?:'|\Z)|[\"'])*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
#: Numbers in classes and ids that may be those of a post; single digits tell columns and parts of a layout apart.
_DIGITS = re.compile(r"\d{2,}")
#: Opening one of these ends an open one of the second kind, unless one of the third kind lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
_SCOPE = {"html", "table", "td", "th", "caption", "button", "object", "template"}


class Element:
    __slots__ = ("tag", "parent", "role", "depth", "apart", "comment", "texts", "nested")

    def __init__(self, tag: str, parent: int, role: int, depth: int, apart: str, nested: bool):
        self.tag, self.parent, self.role, self.depth, self.apart, self.nested = tag, parent, role, depth, apart, nested


def _told(tag: str, attributes: dict[str, str]) -> str:
    """Why an element is no part of an article: ``tag``, ``comment``, ``layout``, ``header``, or an empty string."""
    if tag in APART:
        return "header" if tag == "header" else "tag"
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return "tag"
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "tag"
    if tag in ("html", "body", "main") or not attributes:
        return ""
    words = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        if not re.match(r"(?:has|with|no|without|is)[-_]", name):
            words.update(w.lower() for w in _NAMED.findall(name))
    if words & WORDS_OF_COMMENTS:
        return "comment"
    found = words & WORDS_OF_LAYOUT
    if tag == "article":
        return "layout" if found - {"header"} and found & {"ad", "ads", "advert", "sponsored", "promo", "related", "widget"} else ""
    return "header" if found == {"header"} else "layout" if found else ""


class Page:
    """Elements in page order and the texts between them."""

    def __init__(self, html: str):
        self.elements: list[Element] = []
        #: (element, text with character references decoded); a ``None`` text ends a block
        self.texts: list[tuple[int, str | None]] = []
        self._read(html)
        self._settle()

    def _read(self, html: str) -> None:
        stack: list[int] = []
        open_tags: Counter[str] = Counter()
        elements, texts = self.elements, self.texts
        at, size = 0, len(html)

        def text(raw: str) -> None:
            if raw:
                texts.append((stack[-1] if stack else -1, _html.unescape(raw) if "&" in raw else raw))

        def pop(to: int) -> None:
            open_tags.subtract(elements[i].tag for i in stack[to:])
            del stack[to:]

        def open_(tag: str, raw: str) -> None:
            attributes = {}
            if raw and not raw.isspace():
                for m in _ATTRIBUTE.finditer(raw):
                    attributes.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
            kinds, bounds = _ENDS.get(tag, (set(), set()))
            if any(open_tags[k] for k in kinds):
                for k in range(len(stack) - 1, -1, -1):
                    name = elements[stack[k]].tag
                    if name in bounds:
                        break
                    if name in kinds:
                        pop(k)
                        if tag not in ("tr", "thead", "tbody", "tfoot", "dd", "dt"):
                            break
            if tag in BLOCK:
                for k in range(len(stack) - 1, -1, -1) if open_tags["p"] else ():
                    name = elements[stack[k]].tag
                    if name == "p":
                        pop(k)
                        break
                    if name in _SCOPE:
                        break
                texts.append((stack[-1] if stack else -1, None))
            parent = stack[-1] if stack else -1
            label = tag
            if "class" in attributes or "id" in attributes:
                label += "." + _DIGITS.sub("#", " ".join(sorted(attributes.get("class", "").split())) + "#" + attributes.get("id", ""))
            above = elements[parent] if parent >= 0 else None
            role = xxhash.xxh3_64_intdigest(label.encode("utf-8", "replace"), above.role if above else 0)
            nested = above is not None and (above.nested or above.tag == "article")
            elements.append(Element(tag, parent, role, above.depth + 1 if above else 0, _told(tag, attributes), nested))
            if tag not in VOID:
                stack.append(len(elements) - 1)
                open_tags[tag] += 1

        for m in iter(lambda: _MARKUP.search(html, at), None):
            text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:].removesuffix("]]>"))
                continue
            tag = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                    name = elements[stack[k]].tag
                    if name == tag:
                        if tag in BLOCK:
                            texts.append((stack[-1], None))
                        pop(k)
                        break
                    if tag not in BLOCK and name in BLOCK or name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th"):
                        break
                continue
            if tag == "br":
                texts.append((stack[-1] if stack else -1, " "))
                continue
            open_(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                text(html[at : end.start() if end else size])
                at = end.end() if end else size
                pop(len(stack) - 1)
        text(html[at:])

    def _settle(self) -> None:
        """What is apart by name only stays where the page's own article lies in it; articles in an article are comments."""
        elements = self.elements
        holds: set[int] = set()
        for e in elements:
            if e.tag in MAIN and not e.nested and not e.apart:
                k = e.parent
                while k >= 0 and k not in holds:
                    holds.add(k)
                    k = elements[k].parent
        for i, e in enumerate(elements):
            if e.apart in ("layout", "header") and i in holds:
                e.apart = ""
            if e.tag == "article" and e.nested:
                e.apart = "comment"
        #: whether an element or one it lies in is apart; a heading in an article's own header is not
        self.apart = np.zeros(len(elements), dtype=bool)
        article = np.zeros(len(elements), dtype=bool)
        for i, e in enumerate(elements):
            up = e.parent
            article[i] = e.tag in MAIN or up >= 0 and article[up]
            own = bool(e.apart)
            if own and e.apart == "header" and up >= 0 and article[up] and not self.apart[up]:
                self.apart[i] = True
                e.apart = "own header"
                continue
            inherited = up >= 0 and self.apart[up]
            if inherited and elements[up].apart == "own header" and not own:
                if re.fullmatch("h[1-6]", e.tag):
                    inherited = False
                else:
                    e.apart = "own header"
            self.apart[i] = own or inherited

    def within(self, roots: list[int]) -> np.ndarray:
        """Whether each element is one of ``roots`` or lies in one."""
        inside = np.zeros(len(self.elements), dtype=bool)
        inside[roots] = True
        for i, e in enumerate(self.elements):
            if e.parent >= 0 and inside[e.parent]:
                inside[i] = True
        return inside

    def blocks(self) -> Iterator[tuple[int, str]]:
        """(element of its first text, text) of each block that is not apart, white space made one space."""
        parts: list[str] = []
        first = -1
        for at, text in self.texts:
            if text is None:
                joined = " ".join("".join(parts).split())
                if joined:
                    yield first, joined
                parts, first = [], -1
            elif at < 0 or not self.apart[at]:
                if first < 0 and not text.isspace():
                    first = at if at >= 0 else -2
                parts.append(text)
        joined = " ".join("".join(parts).split())
        if joined:
            yield first, joined

    def block_element(self, at: int) -> int:
        """The element that makes a block of what ``at`` holds."""
        while at >= 0 and self.elements[at].tag not in BLOCK:
            at = self.elements[at].parent
        return at


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _text_token(role: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), role ^ 0x5BD1E995)


_OUTLINE = "host string, page long, tokens array<long>, parents array<int>, chars array<int>, kinds array<int>"
#: What ``kinds`` says of a token: a text, one that counts for the region, a container, an article or main element; the depth above that.
TEXT, COUNTS, CONTAINER, IS_MAIN, DEPTH_AT = 1, 2, 4, 8, 16


def outlines(pages: DataFrame) -> DataFrame:
    """A row of tokens in page order for each page: elements by their paths, blocks by path and text."""

    def outline(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("host", "page", "tokens", "parents", "chars", "kinds")}
        for page_id, url, html in zip(x["page_id"], x["url"], x["html"]):
            page = Page(html or "")
            by_element: dict[int, list[tuple[int, str]]] = {}
            for at, text in page.blocks():
                by_element.setdefault(page.block_element(at), []).append((at, text))
            tokens, parents, chars, kinds = [0], [-1], [0], [0]
            place: dict[int, int] = {-1: 0, -2: 0}

            def put(token: int, parent: int, n: int, kind: int) -> None:
                tokens.append(_signed(token))
                parents.append(parent)
                chars.append(n)
                kinds.append(kind)

            for i, e in enumerate(page.elements):
                if e.tag not in BLOCK:
                    place[i] = place[e.parent]
                    continue
                up = place[e.parent]
                place[i] = len(tokens)
                free = not page.apart[i]
                put(e.role, up, 0, (CONTAINER if e.tag in CONTAINERS and free else 0) | (IS_MAIN if e.tag in MAIN and free else 0) | DEPTH_AT * e.depth)
                for at, text in by_element.get(i, ()):
                    linked = at >= 0 and page.elements[at].tag == "a"
                    put(_text_token(e.role, text), place[i], len(text), TEXT | (0 if linked else COUNTS))
            out["host"].append(host_of(url))
            out["page"].append(_signed(xxhash.xxh3_64_intdigest(f"{page_id}\0{url}".encode("utf-8", "replace"))))
            for n, v in (("tokens", tokens), ("parents", parents), ("chars", chars), ("kinds", kinds)):
                out[n].append(v)
        return out

    return map_batches(pages.select("page_id", "url", "html"), outline, _OUTLINE)


_COUNTED = "host string, token long, pages long, uses long, one long, two long"


def _token_counts(outlined: DataFrame) -> DataFrame:
    """For each token of a host, its pages and uses and the sums that stand for its occurrence vector."""
    arrow = _arrow_schema(_COUNTED)
    low = (1 << 32) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(h, t, *v) for (h, t), v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for host, page, tokens in zip(*(batch.column(n).to_pylist() for n in ("host", "page", "tokens"))):
                uses: dict[int, int] = {}
                for t in tokens:
                    uses[t] = uses.get(t, 0) + 1
                seed = page & ((1 << 64) - 1)
                hashed = {c: xxhash.xxh3_64_intdigest(c.to_bytes(8, "little"), seed) for c in set(uses.values())}
                for t, c in uses.items():
                    v = held.setdefault((host, t), [0, 0, 0, 0])
                    v[0] += 1
                    v[1] += c
                    v[2] += hashed[c] & low
                    v[3] += hashed[c] >> 32
                if len(held) > HELD_TOKENS:
                    yield flushed()
        if held:
            yield flushed()

    counted = outlined.select("host", "page", "tokens").mapInArrow(count, _COUNTED)
    return counted.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "uses", "one", "two")))


def equivalence_classes(outlined: DataFrame) -> DataFrame:
    """``host, members``: tokens (token, class, once) on half of a host's pages or more, for hosts of enough pages.

    Token 0 stands for the page itself, so its class is that of tokens that
    stand once on every page (``once``).  A page holds at most 1 / SUPPORT times
    as many of these tokens as pages of its host do on average, so a host's list
    is about the size of a page.
    """
    counts = staged(_token_counts(outlined), "html-tokens")
    hosts = counts.filter(f"token = 0 AND pages >= {LEAST_PAGES}").select("host", F.col("pages").alias("all"), F.col("one").alias("all_one"), F.col("two").alias("all_two"))
    often = counts.join(hosts, "host").filter(F.col("pages") >= F.lit(SUPPORT) * F.col("all"))
    once = (F.col("pages") == F.col("all")) & (F.col("uses") == F.col("all")) & (F.col("one") == F.col("all_one")) & (F.col("two") == F.col("all_two"))
    member = F.struct("token", F.xxhash64("pages", "one", "two").alias("class"), once.alias("once"))
    return staged(often.groupBy("host").agg(F.sort_array(F.collect_list(member)).alias("members")), "html-classes")


_CHECKED = "host string, what int, key long, low long, high long, chars long, varied long, kind int"
CLASS, REGION, TOTAL = 0, 1, 2


def _checked(outlined: DataFrame, classes: DataFrame) -> DataFrame:
    """On each page: the order and the place of each class; the text that each container of the template holds.

    Combined by host and key: least and greatest order hash, or sums of characters.
    """
    arrow = _arrow_schema(_CHECKED)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[dict[int, int], dict[int, bool]]] = {}
        held: dict[tuple[str, int, int], list[int]] = {}

        def see(host: str, what: int, key: int, order: int, chars: int, varied: int, kind: int) -> None:
            v = held.get((host, what, key))
            if v is None:
                held[host, what, key] = [order, order, chars, varied, kind]
            else:
                v[0], v[1], v[2], v[3] = min(v[0], order), max(v[1], order), v[2] + chars, v[3] + varied

        def flushed() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                host = r["host"]
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = ({m["token"]: m["class"] for m in r["members"]}, {m["token"]: m["once"] for m in r["members"]})
                of, once = known[host]
                tokens, parents, chars, kinds = r["tokens"], r["parents"], r["chars"], r["kinds"]
                # orders of classes, and the token of another class before each first one
                runs: dict[int, list[int]] = {}
                before: dict[int, int] = {}
                previous = 0
                for i, t in enumerate(tokens):
                    c = of.get(t)
                    if c is not None:
                        if c not in runs:
                            runs[c] = []
                            before[c] = tokens[parents[i]] if parents[i] >= 0 else previous
                        runs[c].append(t)
                for c, run in runs.items():
                    width = len(set(run))
                    head = run[:width]
                    even = len(run) % width == 0 and run == head * (len(run) // width)
                    order = xxhash.xxh3_64_intdigest(np.array([before[c], *head], dtype=np.int64).tobytes()) if even else xxhash.xxh3_64_intdigest(b"odd", r["page"] & (2**64 - 1))
                    see(host, CLASS, c, _signed(order), int(not even), 0, 0)
                # text below each token of the page, children before parents
                all_below, varied_below = list(chars), [n if k & COUNTS and of.get(t) is None else 0 for n, k, t in zip(chars, kinds, tokens)]
                for i in range(len(tokens) - 1, 0, -1):
                    all_below[parents[i]] += all_below[i]
                    varied_below[parents[i]] += varied_below[i]
                see(host, TOTAL, 0, 0, all_below[0], varied_below[0], 0)
                for i, (t, k) in enumerate(zip(tokens, kinds)):
                    if k & CONTAINER and t in of:
                        see(host, REGION, t, of[t], all_below[i], varied_below[i], k)
                if len(held) > HELD_TOKENS:
                    yield flushed()
        if held:
            yield flushed()

    joined = outlined.join(classes, "host").select("host", "page", "tokens", "parents", "chars", "kinds", "members")
    rows = joined.mapInArrow(check, _CHECKED)
    return rows.groupBy("host", "what", "key").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("varied").alias("varied"), F.max("kind").alias("kind")
    )


def templates(outlined: DataFrame) -> DataFrame:
    """``host, region, notices``: the role of each host's region, and tokens that stand once on every page."""
    classes = equivalence_classes(outlined)
    checked = staged(_checked(outlined, classes), "html-checked")
    valid = checked.filter(f"what = {CLASS} AND low = high AND chars = 0").select("host", F.col("key").alias("class"))
    totals = checked.filter(f"what = {TOTAL}").select("host", F.col("varied").alias("total"))
    inside = checked.filter(f"what = {REGION} AND low = high").withColumn("class", F.col("low")).join(valid, ["host", "class"], "left_semi").join(totals, "host")
    fit = inside.filter((F.col("total") > 0) & (F.col("varied") >= REGION_SHARE * F.col("total")) & (2 * F.col("varied") >= F.col("chars")))
    is_main = F.col("kind").bitwiseAND(IS_MAIN) > 0
    depth = F.floor(F.col("kind") / DEPTH_AT)
    # an article or main element, the outermost; else the deepest container; the smallest role decides ties
    rank = F.struct(is_main, F.when(is_main, -depth).otherwise(depth), -F.col("key").cast("decimal(20,0)"))
    regions = fit.groupBy("host").agg(F.max_by("key", rank).alias("region"))
    notices = F.transform(F.filter("members", lambda m: m["once"]), lambda m: m["token"])
    return staged(regions.join(classes.select("host", notices.alias("notices")), "host"), "html-templates")


def page_text(html: str | None, region: int | None = None, notices: frozenset[int] = frozenset()) -> str:
    """Main text of one page: its host's region if the page has it, else its article, main or body."""
    page = Page(html or "")
    elements = page.elements
    roots = [i for i, e in enumerate(elements) if not page.apart[i] and _signed(e.role) == region] if region is not None else []
    found = bool(roots)
    for tag in ("article", "main", "body"):
        if not roots:
            roots = [i for i, e in enumerate(elements) if e.tag == tag and not page.apart[i] and not e.nested]
    inside = page.within(roots) if roots else np.ones(len(elements), dtype=bool)
    out: list[str] = []
    headed = False
    opening: list[str] = []
    for at, text in page.blocks():
        e = page.block_element(at)
        role = elements[e].role if e >= 0 else 0
        of_template = found and e >= 0 and _signed(role) in notices and _signed(_text_token(role, text)) in notices
        if (inside[e] if e >= 0 else not roots) and not of_template:
            out.append(text)
            headed = headed or e >= 0 and elements[e].tag == "h1"
        elif found and not out and e >= 0 and elements[e].tag == "h1" and not of_template:
            opening.append(text)
    return "\n".join(out if headed else opening + out)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    rows = pages.select("page_id", "url", "html")
    found = templates(staged(outlines(rows), "html-outlines"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = rows.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "region", "notices")

    def extract(x: dict[str, list]) -> dict[str, list]:
        text = [page_text(h, r, frozenset(n or ())) for h, r, n in zip(x["html"], x["region"], x["notices"])]
        return {"page_id": x["page_id"], "url": x["url"], "text": text, "n_chars": [len(t) for t in text]}

    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long"
    return map_batches(joined, extract, schema)
