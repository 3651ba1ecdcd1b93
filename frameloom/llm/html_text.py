"""Main text of web pages by template deduction.

On each host with enough different pages a template is deduced from the pages' tags, told apart by their path:

1. For each tag path (token) the vector of its counts over the host's pages is kept as a sum of hashes of (page, count).
   Tokens with equal vectors form an equivalence class; classes on nearly all pages are candidates.
2. The class that occurs once a page is the outer one. Container tokens with one and the same count above 1 on all pages
   take part in it as so many numbered roles, if the whole keeps its order. It is valid if nearly all pages have its
   tokens in one order. A class that occurs more often is valid if, on nearly all pages, its tokens alternate in one
   order and all of its occurrences lie below the same token of another class: so classes nest, slot by slot.
3. The valid classes cut each page into slots: a text run lies in the slot of the last outer token before it and of the
   innermost template token around it. A host's slots are measured over all of its pages: characters, share of link
   text, share of wording that recurs on other pages.
4. Slots decide (``decide``): wording that recurs and link lists are template, what varies is the page's own; the element
   that holds nearly all of what varies is the article, in which shared wording stays; beside it only words in elements
   such as headings and paragraphs are kept. The standard's meaning of elements counts too: article and main are articles, nav, footer, aside, forms and the like never are. Class names
   serve only for what no template can tell from an article: readers' comments, adverts, share bars.
5. The slots kept are extracted from each page, block by block.

Where no template holds (few different pages on the host, or a page that departs from it), element and class names
decide alone (``by_names``).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, texts_of, written

#: A template needs so many different pages of a host, and tokens on this share of them.
LEAST_PAGES = 5
SHARE = 0.95
#: A container token that occurs up to so many times, equally often on each page, is told apart by its number.
NUMBERED = 16
#: A slot is a link list if at least this share of its characters is link text, and template if so much of its wording
#: recurs on other pages: outside the article RECURS, inside it FIXED, and there only in elements that hold no words of their own.
LINKS, RECURS, FIXED = 0.5, 0.5, 0.9
#: The innermost outer element that holds this share of what varies is the article.
HOLDS = 0.9
#: Recurring prose that is so many times as long as all that varies is no notice: the host's pages are near copies.
COPIES = 4
#: A table of hosts with at most so many tokens and slots is broadcast, under 100 MB; beyond it pages are joined by shuffle.
BROADCAST_TOKENS = 2_000_000
SALTS = 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "noembed", "xmp", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that end an open p, as in the HTML standard.
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "select"}
#: Elements that hold words of their own, told from containers by the lowest bit of a token; the next bit marks html and body.
_TEXT = _INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption", "summary", "article", "main"}
#: Elements whose content is never article text.
_NEVER = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "menu", "dialog", "title", "noembed", "audio", "video", "datalist"}
_SIGNS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|sponsor|sponsored|promo|promoted|sidebar|side-bar|rail|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|site-header|masthead|topbar|header|notice|notices|cookie|cookies|consent|gdpr|popup|modal|overlay|alert|newsletter|subscribe|signup|login|search|searchbox|comment|comments|commentlist|reply|replies|respond|disqus|discussion|related|recommended|share|sharing|social|pagination|pager|toolbar|widget|widgets|skip-link)(?:$|[\s_-])", re.I)
#: Signs that also hold for an article element or inside one, where a header is the article's own.
_READERS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|sponsor|sponsored|promo|promoted|comment|comments|commentlist|reply|replies|respond|related|recommended)(?:$|[\s_-])", re.I)
#: In an article these class names mark containers that are no text of its own; ids only where they name comments.
_INSIDE = re.compile(_READERS.pattern.replace("|related|recommended)", "|related|recommended|disqus|share|sharing|social)"), re.I)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|disqus)(?:$|[\s_-])", re.I)
#: Elements that hold an article's own words; their names are no sign.
_OWN = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
_OWN_HEADER = re.compile(r"(?:^|(?<=\s))(?:post|entry|article|page|content)[-_]header(?=\s|$)", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    """An element: its token (path of names), its number among the page's tags, and whether it is left out by meaning or
    name (skip) or by meaning, or as a comment, advert or the like (cut)."""

    name: str
    token: int
    at: int
    skip: bool
    cut: bool
    article: bool
    main: bool


@dataclass
class Run:
    """A block of text: the tag that holds it, how many tags precede it, and how many of its characters are link text."""

    text: str
    node: int
    at: int
    link: int
    linked: bool
    skip: bool
    cut: bool
    article: bool
    main: bool
    inside: bool = False


def _token(label: str, parent: int, own: bool, root: bool) -> int:
    return (xxhash.xxh64_intdigest(label, seed=parent) >> 3 << 2) | root << 1 | own


def _made(name: str, attrs: str, parent: Node, at: int) -> Node:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
    kind, ident = found.get("class", ""), found.get("id", "")
    mark = f"{kind} {ident}".strip()
    never = name in _NEVER or (name == "header" and not (parent.article or parent.main))
    skip, cut = parent.skip or never, parent.cut or never
    if name in ("article", "main"):
        named = called = bool(_READERS.search(mark))
    elif skip and cut or name in ("html", "body"):
        named = called = False
    else:
        called = not (name in _OWN and (parent.article or parent.main)) and bool(_INSIDE.search(_HEADER.sub(" ", kind)) or _COMMENTS.search(ident))
        if name in _OWN and (parent.article or parent.main):
            named = False
        elif parent.article:
            named = called
        elif parent.main and name == "section":
            named = _SIGNS.search(_OWN_HEADER.sub(" ", kind)) or _COMMENTS.search(ident)
        else:
            named = _SIGNS.search(_HEADER.sub(" ", mark) if name in _OWN else _OWN_HEADER.sub(" ", mark))
        if attrs and (found.get("role") in _ROLES or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs) or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", ""))):
            named = called = True
    article = parent.article or name == "article" or "articleBody" in found.get("itemprop", "")
    main = parent.main or name == "main" or found.get("role") == "main"
    label = name + ("." + ".".join(sorted(_DIGITS.sub("#", mark).split())) if mark and name not in _INLINE else "")
    return Node(name, _token(label, parent.token, name in _TEXT, name in ("html", "body")), at, skip or bool(named), cut or bool(called), article, main)


def parse(page: str) -> tuple[list[int], list[int], list[Run]]:
    """Start tags as tokens, in order; the number of each one's parent (-1 for none); the text runs, block by block."""
    root = Node("", 0, -1, False, False, False, False)
    stack, tags, up, runs, words = [root], [], [], [], []

    def close_block() -> None:
        text = " ".join(html.unescape("".join(w for w, _, _ in words)).split()) if words else ""
        if text:
            top = words[0][1]
            sizes = [(len(w.strip()), a) for w, _, a in words]
            whole, linked = sum(n for n, _ in sizes), sum(n for n, a in sizes if a)
            runs.append(Run(text, top.at, len(tags), len(text) * linked // max(whole, 1), linked == whole, top.skip, top.cut, top.article, top.main))
        words.clear()

    def holder() -> Node:
        for node in reversed(stack):
            if node.name not in _INLINE or node.skip or node.cut:
                return node
        return root

    def pop_to(i: int) -> None:
        if any(n.name not in _INLINE for n in stack[i:]):
            close_block()
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m["name"]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                node = holder()
                if words and (words[-1][1].skip, words[-1][1].cut) != (node.skip, node.cut):
                    close_block()
                words.append((piece, node, any(x.name == "a" for x in stack)))
            continue
        name = name.lower()
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    pop_to(i)
                    break
                if name in _INLINE and stack[i].name not in _INLINE:
                    break
            else:
                if name not in _INLINE:
                    close_block()
            continue
        if name not in _INLINE:
            close_block()
            if name in _ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == "p":
                        pop_to(i)
                        break
                    if stack[i].name not in _INLINE:
                        break
            if name in _SIBLING:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in _SIBLING[name]:
                        pop_to(i)
                        break
                    if stack[i].name in _SCOPE:
                        break
        elif name == "br":
            words.append((" ", holder(), False))
        node = _made(name, m["attrs"] or "", stack[-1], len(tags))
        tags.append(node.token)
        up.append(stack[-1].at)
        if name in _VOID or (m["attrs"] or "").endswith("/"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    close_block()
    # A main element that encloses the article is the root: a title or lead beside the article belongs to it.
    kept = [r for r in runs if not r.cut]
    if any(r.article and r.main for r in kept) or not any(r.article for r in kept):
        for r in kept:
            r.inside = r.main
    else:
        for r in kept:
            r.inside = r.article
    return tags, up, runs


def by_names(runs: list[Run]) -> list[Run]:
    """The article's runs where no template tells: element, class and id names decide."""
    kept = [r for r in runs if not r.skip]
    inside = [r for r in kept if r.main] if any(r.article and r.main for r in kept) else [r for r in kept if r.article]
    return inside or [r for r in kept if r.main] or [r for r in kept if not r.linked]


def _mixed(a: int, b: int) -> int:
    return ((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF) >> 1


@dataclass(frozen=True)
class Classes:
    """Candidates of a host: tokens that occur once a page, containers with one count on all pages, and other classes."""

    once: frozenset[int]
    numbered: frozenset[int]
    nested: tuple[frozenset[int], ...]

    @staticmethod
    def of(tokens: list[tuple[int, int, int, int, int]]) -> Classes:
        """tokens: (token, support, total, sum of squared counts, vector), each on nearly all pages of the host."""
        by_vector: dict[tuple, list[int]] = defaultdict(list)
        for token, support, total, squares, vector in tokens:
            by_vector[support, total, squares, vector].append(token)
        once = max(((k[0], len(v), k) for k, v in by_vector.items() if k[0] == k[1]), default=None)
        if once is None:
            return Classes(frozenset(), frozenset(), ())
        outer = once[2]
        # Equal counts on all pages: the sum of squares is the least that it can be.
        same = [k for k in by_vector if k[0] == outer[0] and k[0] < k[1] <= NUMBERED * k[0] and k[1] ** 2 == k[0] * k[2]]
        numbered = frozenset(t for k in same for t in by_vector[k] if not t & 1)
        nested = tuple(frozenset(v) for k, v in by_vector.items() if k != outer)
        return Classes(frozenset(by_vector[outer]), numbered, nested)


def roles(tags: list[int], once: frozenset[int], numbered: frozenset[int]) -> tuple[list[int], list[int]]:
    """Places of the outer class's tokens on a page, and their roles in order."""
    at, found, times = [], [], Counter()
    for i, t in enumerate(tags):
        if t in numbered:
            at.append(i), found.append(_mixed(t, times[t]))
            times[t] += 1
        elif t in once:
            at.append(i), found.append(t)
    return at, found


def class_order(tags: list[int], up: list[int], one: frozenset[int], others: frozenset[int]) -> tuple[int, ...]:
    """The order in which the tokens of a class alternate on a page, after the token of another class that all of them
    lie below; () if they don't alternate or lie below different ones."""
    at = [i for i, t in enumerate(tags) if t in one]
    order = tuple(tags[i] for i in at[: len(one)])
    if len(set(order)) < len(one) or any(tags[i] != order[k % len(one)] for k, i in enumerate(at)):
        return ()
    below = set()
    for i in at:
        n = up[i]
        while n >= 0 and (tags[n] in one or tags[n] not in others):
            n = up[n]
        below.add(tags[n] if n >= 0 else 0)
    return (below.pop(), *order) if len(below) == 1 else ()


@dataclass(frozen=True)
class Template:
    """Valid classes of a host: the outer roles in their order, and the tokens of nested classes."""

    order: tuple[int, ...]
    numbered: frozenset[int]
    nested: frozenset[int]

    def slots(self, tags: list[int], up: list[int], at: list[int], node: list[int]) -> list[tuple[int, tuple[int, ...]]] | None:
        """For each run (given by the tags before it and the tag that holds it) its slot, and the outer roles around it
        but html and body, innermost last. None where the page departs from the template."""
        stops, found = roles(tags, frozenset(self.order), self.numbered)
        if tuple(found) != self.order:
            return None
        role = dict(zip(stops, found))
        out = []
        for a, n in zip(at, node):
            gap = bisect_left(stops, a)
            inner, chain = 0, []
            while n >= 0:
                if n in role or tags[n] in self.nested:
                    inner = inner or role.get(n, tags[n])
                if n in role and not tags[n] & 2:
                    chain.append(role[n])
                n = up[n]
            out.append((_mixed(found[gap - 1] if gap else 0, inner), tuple(reversed(chain))))
        return out


@dataclass(frozen=True)
class Slot:
    """What a host's pages hold in a slot, in characters: all, of links, of wording on several pages, inside an article
    or main element, in elements with words of their own."""

    slot: int
    chars: int
    link: int
    fixed: int
    inside: int
    own: int
    chain: tuple[int, ...]


def decide(slots: list[Slot]) -> frozenset[int]:
    """The slots that hold the article."""
    size = lambda some: sum(s.chars for s in some)
    region = [s for s in slots if 2 * s.inside > s.chars]
    beside: list[Slot] = []
    if not region:
        prose = [s for s in slots if s.link < LINKS * s.chars]
        varying = [s for s in prose if s.fixed < RECURS * s.chars]
        longest = max(prose, key=lambda s: (s.chars, s.slot), default=None)
        if longest is not None and longest.chars > COPIES * size(varying) and longest not in varying:
            varying.append(longest)
        held: Counter[int] = Counter()
        depth: dict[int, int] = {}
        for s in varying:
            for i, r in enumerate(s.chain):
                held[r] += s.chars
                depth[r] = max(i, depth.get(r, 0))
        homes = [r for r in held if held[r] >= HOLDS * size(varying)]
        home = max(homes, key=lambda r: (depth[r], r), default=None)
        region = [s for s in prose if home is not None and home in s.chain]
        # Beside that element, a heading or a lead is the article's; a box that varies is an advert or the like.
        beside = [s for s in varying if home is None or 2 * s.own >= s.chars]
    kept = [s for s in region if 2 * s.own >= s.chars or s.fixed < FIXED * s.chars]
    if 2 * size(kept) < size(region):
        kept = region
    return frozenset(s.slot for s in [*kept, *beside])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1)), F.lit(""))


def outlines(pages: DataFrame) -> DataFrame:
    """host, page (a hash of its html), tags, up, and for each run that isn't cut: at, node, word (a hash of its
    wording), chars, link, inside. One row for each different page of a host: what copies share is their text, no template."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, columns = [], [[] for _ in range(8)]
            for text in texts_of(part.column("html")):
                tags, up, runs = parse(text or "")
                runs = [r for r in runs if not r.cut]
                ids.append(xxhash.xxh64_intdigest(text or "") >> 1)
                found = (tags, up, [r.at for r in runs], [r.node for r in runs], [xxhash.xxh64_intdigest(r.text) >> 1 for r in runs], [len(r.text) for r in runs], [r.link for r in runs], [r.inside for r in runs])
                for column, values in zip(columns, found):
                    column.append(values)
            arrays = [pa.array(c, pa.list_(k)) for c, k in zip(columns, (pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 2, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(ids, pa.int64()), *arrays], ["host", "page", "tags", "up", "at", "node", "word", "chars", "link", "inside"])

    kind = "host string, page bigint, tags array<bigint>, up array<int>, at array<int>, node array<int>, word array<bigint>, chars array<int>, link array<int>, inside array<boolean>"
    return pages.select("host", F.col("html").cast("string").alias("html")).mapInArrow(outline, kind).dropDuplicates(["host", "page"])


def _by_key(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.lexsort(keys)
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(fresh)


def occurrence(pages: DataFrame) -> DataFrame:
    """host, token, support (pages that have it), total, squares (sum of squared counts), vector (sum of hashes of page
    and count). Token 0 stands for the page itself. pages: outlines()."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host").dictionary_encode()
            codes, ids = hosts.indices.to_numpy(), batch.column("page").to_numpy().astype(np.uint64)
            lists = batch.column("tags")
            page = np.concatenate([np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), np.arange(len(ids))])
            token = np.concatenate([lists.flatten().to_numpy(), np.zeros(len(ids), np.int64)])
            order, starts = _by_key(token, page)
            n = np.diff(np.append(starts, len(order)))
            page, token = page[order][starts], token[order][starts]
            sign = (ids[page] + np.uint64(0x9E3779B97F4A7C15) * n.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            sign = ((sign ^ (sign >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(20)).astype(np.int64)
            order, starts = _by_key(token, codes[page])
            total = lambda x: pa.array(np.add.reduceat(x[order], starts) if len(starts) else x)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([hosts.dictionary.take(pa.array(codes[page][order][starts])), pa.array(token[order][starts]), total(np.ones(len(n), np.int64)), total(n), total(n * n), total(sign)], ["host", "token", "support", "total", "squares", "vector"])

    rows = pages.select("host", "page", "tags").mapInArrow(counts, "host string, token bigint, support bigint, total bigint, squares bigint, vector bigint")
    sums = [F.sum(c).alias(c) for c in ("support", "total", "squares")]
    return rows.groupBy("host", "token").agg(*sums, F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"))


def _with_host(pages: DataFrame, per_host: DataFrame, size: str, how: str) -> DataFrame:
    """pages joined with a table of hosts, by broadcast if it is small."""
    found = per_host.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()[0]
    if found <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(per_host), "host", how)
    salted = per_host.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return pages.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, ["host", "_salt"], how).drop("_salt")


class _Hosts(dict):
    """What is made once for each host, for a bounded number of hosts at a time."""

    def made(self, host: str, make: Callable):
        if host not in self:
            if len(self) > 2_000:
                self.clear()
            self[host] = make()
        return self[host]


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """host, pages, order (outer roles), numbered (tokens told apart by number), nested (classes, each as the token that
    it lies below and its tokens in order). Only hosts with a valid outer class. pages: outlines()."""
    seen = written(occurrence(pages), "occurrence")
    often = seen.withColumn("pages", F.max(F.when(F.col("token") == 0, F.col("support"))).over(Window.partitionBy("host")))
    often = often.where((F.col("token") != 0) & (F.col("pages") >= least_pages) & (F.col("support") >= share * F.col("pages")))
    found = often.groupBy("host", "pages").agg(F.collect_list(F.struct("token", "support", "total", "squares", F.col("vector").cast("string").alias("vector"))).alias("tokens"))
    found = written(found, "classes")

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hosts()
        for batch in batches:
            times: Counter = Counter()
            tokens = batch.column("tokens")
            for i, (host, tags, up) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "tags", "up")))):
                c = known.made(host, lambda i=i: Classes.of([tuple(t.values()) for t in tokens[i].as_py()]))
                if not c.once:
                    continue
                every = c.once.union(*c.nested)
                if c.numbered:
                    times[host, 0, tuple(roles(tags, c.once, c.numbered)[1])] += 1
                    times[host, 2, tuple(sorted(c.numbered))] += 1
                times[host, 1, tuple(roles(tags, c.once, frozenset())[1])] += 1
                for one in c.nested:
                    if order := class_order(tags, up, one, every):
                        times[host, min(one) | 4, order] += 1
            keys = list(times)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.list_(pa.int64())), pa.array(list(times.values()), pa.int64())], ["host", "kind", "seq", "n"])

    rows = _with_host(pages.select("host", "tags", "up"), found.select("host", "tokens"), "size(tokens)", "inner")
    rows = rows.mapInArrow(orders, "host string, kind bigint, seq array<bigint>, n bigint")
    best = rows.groupBy("host", "kind", "seq").agg(F.sum("n").alias("n")).groupBy("host", "kind").agg(F.max(F.struct("n", "seq")).alias("best"))
    valid = best.join(found.select("host", "pages"), "host").where(F.col("best.n") >= share * F.col("pages")).select("host", "pages", "kind", F.col("best.seq").alias("seq"))
    only = lambda k: F.max(F.when(F.col("kind") == k, F.col("seq")))
    outer = valid.groupBy("host", "pages").agg(only(0).alias("with"), only(1).alias("without"), only(2).alias("numbered"), F.collect_list(F.when(F.col("kind") > 2, F.col("seq"))).alias("nested"))
    none = F.array().cast("array<bigint>")
    return outer.where("with is not null or without is not null").select("host", "pages", F.coalesce("with", "without").alias("order"), F.when(F.col("with").isNotNull(), F.col("numbered")).otherwise(none).alias("numbered"), "nested")


def _template(order: list[int], numbered: list[int], nested: list[list[int]]) -> Template:
    return Template(tuple(order), frozenset(numbered), frozenset(t for n in nested for t in n[1:]))


def measured(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host and slots: what each slot holds on all pages of the host. pages: outlines(); found: templates()."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chains = _Hosts(), set()
        for batch in batches:
            rows: list[tuple] = []
            names = ("host", "page", "tags", "up", "at", "node", "word", "chars", "link", "inside")
            order, numbered, nested = (batch.column(c) for c in ("order", "numbered", "nested"))
            for i, (host, page, tags, up, at, node, word, chars, link, inside) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                t = known.made(host, lambda i=i: _template(order[i].as_py(), numbered[i].as_py(), nested[i].as_py()))
                for (slot, chain), *run, n in zip(t.slots(tags, up, at, node) or (), word, chars, link, inside, node):
                    own = n >= 0 and tags[n] & 1
                    rows.append((i, page, slot, *run[:3], run[1] * run[3], run[1] * own, None if (host, slot) in chains else list(chain)))
                    if len(chains) < 100_000:
                        chains.add((host, slot))
            columns = list(zip(*rows)) if rows else [[]] * 9
            arrays = [batch.column("host").take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:8]), pa.array(columns[8], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "page", "slot", "word", "chars", "link", "inside", "own", "chain"])

    rows = _with_host(pages, found.select("host", "order", "numbered", "nested"), "size(order) + size(nested)", "inner")
    rows = rows.mapInArrow(cut, "host string, page bigint, slot bigint, word bigint, chars bigint, link bigint, inside bigint, own bigint, chain array<bigint>")
    sums = ("chars", "link", "inside", "own")
    words = rows.groupBy("host", "word", "slot").agg(*[F.sum(c).alias(c) for c in sums], F.max("chain").alias("chain"), F.min("page").alias("a"), F.max("page").alias("b"))
    # As many rows a word as slots that hold it.
    w = Window.partitionBy("host", "word")
    words = words.withColumn("fixed", F.when(F.min("a").over(w) < F.max("b").over(w), F.col("chars")).otherwise(F.lit(0)))
    slots = words.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in (*sums, "fixed")], F.max("chain").alias("chain"))
    return slots.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "link", "fixed", "inside", "own", "chain")).alias("slots"))


def main_text(page: str | None, template: Template | None = None, kept: frozenset[int] = frozenset()) -> str:
    """The article's text: the runs in the slots kept, or by names where the page has no template or departs from it."""
    if not page:
        return ""
    tags, up, runs = parse(page)
    mine = [r for r in runs if not r.cut]
    cut = template.slots(tags, up, [r.at for r in mine], [r.node for r in mine]) if template else None
    if cut:
        chosen = [r for r, (slot, _) in zip(mine, cut) if slot in kept]
        # Slots are a host's; on this page an article or main element may hold but a part of one.
        chosen = [r for r in chosen if r.inside] or chosen
        if chosen:
            return "\n".join(r.text for r in chosen)
    return "\n".join(r.text for r in by_names(runs))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    Null or empty html gives an empty text; a null or odd url counts as the nameless host. Character references are
    decoded; white space within a block becomes one space; a line break element is white space. Repeated rows give
    repeated results; pages of a host with the same html count once towards its template. Long pages are read whole.
    Extra columns are ignored. Empty tables give empty results.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    own = rows.withColumn("host", host_of(F.col("url")))
    outlined = written(outlines(own), "outlines")
    found = written(templates(outlined, least_pages, share), "templates")
    found = written(found.join(measured(outlined, found), "host", "left"), "slots")
    joined = _with_host(own, found.drop("pages"), "size(order) + size(nested) + coalesce(size(slots), 0)", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hosts()

        def made(row: dict) -> tuple[Template | None, frozenset[int]]:
            if row["order"] is None:
                return None, frozenset()
            return _template(row["order"], row["numbered"], row["nested"]), decide([Slot(**x | {"chain": tuple(x["chain"] or ())}) for x in row["slots"] or ()])

        for part in slices(batches):
            told = part.select(["order", "numbered", "nested", "slots"])
            hosts = part.column("host").to_pylist()
            out = [main_text(page, *known.made(host, lambda i=i, told=told: made(told.slice(i, 1).to_pylist()[0]))) for i, (host, page) in enumerate(zip(hosts, texts_of(part.column("html"))))]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return joined.select("page_id", "url", "html", "host", "order", "numbered", "nested", "slots").mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
