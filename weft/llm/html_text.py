"""Main text of web pages by wrapper induction.

Every page becomes a tree of tags in which siblings of one label (tag, class and id, and what they say of the node) are folded
into one slot. The trees of a host's pages are aligned by simple tree matching and merged into one wrapper: aligned slots
add up, and a slot whose text is the same on all pages is template, one whose text varies is content. The content root is
the article or main slot, or else the smallest slot that holds most of the varying text outside links. Tags such as nav, and
slots whose class, id or role is a word for menus, adverts, comments and the like, are template though their text varies. A
compound name such as `with-sidebar` only counts against a slot that doesn't hold most of the varying text. Extraction reads
the text below the root and leaves template slots out.

Wrappers are induced from all pages: each task merges its own pages' trees by host, then the partial wrappers are merged by
host and salt, then by host. No task gathers a host's pages. Merging doesn't depend on order. Trees may be of any depth.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Tags by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("script style noscript template iframe object embed svg canvas nav footer header aside form button select textarea input dialog menu head title audio video".split())
#: Words of classes, ids and roles that name what isn't the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner promo promotion promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar "
    "comment comments commentlist reply replies respond discussion disqus share sharing social follow related recommended recommendations newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices alert "
    "warning popup modal overlay toolbar pagination pager search searchbox widget widgets form disclaimer copyright legal skip toc hidden contentinfo complementary dialog".split()
)
CLOSES = {  # Fixed values: a start tag that ends an open element, and where the search for that stops.
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"br", "caption", "legend", "option", "optgroup", "body", "html", "tr", "td", "th", "tbody", "thead", "tfoot"}
WORDS = re.compile(r"[a-z]+")
#: How far a slot's tag and names say that it isn't the article: not at all, by a compound name, outright.
WANTED, DOUBTED, UNWANTED = range(3)

# Walks below call themselves once per level of a tree; such calls take memory, not the machine's stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


class Node:
    __slots__ = ("kids", "label", "tag")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids = tag, label, []


@lru_cache(maxsize=20_000)
def kind(tag: str, attributes: str) -> str:
    """The label of a start tag: tag, words of class and id, and at its end whether they say that it isn't the article.

    Nodes that differ in what is said of them (a hidden one and a visible one of the same names) have different labels.
    Names of over 60 characters stand as their digest.
    """
    at = {}
    for k, v in ATTRIBUTE.findall(attributes):
        at.setdefault(k.lower(), html.unescape(v.strip("\"'")))
    names = f"{at.get('class', '')} {at.get('id', '')}".lower()
    plain = " ".join(sorted({w for w in re.split(r"[\s\d_-]+", names) if w}))
    if len(plain) > 60:
        plain = xxhash.xxh64_hexdigest(plain)
    whole = {re.sub(r"\d+$", "", w).strip("_-") for w in f"{names} {at.get('role', '')}".lower().split()}
    hidden = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "")
    if tag in ("article", "main", "body", "html"):
        said = UNWANTED if hidden or whole & {"comment", "comments", "ad", "advert", "related"} else WANTED
    elif tag in NEVER or hidden or whole & NAMED:
        said = UNWANTED
    else:
        said = DOUBTED if set(WORDS.findall(f"{names} {at.get('role', '')}".lower())) & NAMED else WANTED
    role = " @main" if tag == "main" or at.get("role") == "main" or at.get("itemprop") == "articleBody" else ""
    return f"{tag} {plain}{role}".strip() + " !" * said


def said_of(label: str) -> int:
    return label.count(" !")


def parsed(source: str) -> Node:
    """A page's tree. Forgiving: implied ends, stray end tags, open tags at the end, text outside any tag."""
    root = Node("#root", "#root")
    stack, at, scan = [root], 0, TOKEN.search
    while m := scan(source, at):
        if m.start() > at:
            stack[-1].kids.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag not in VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            continue
        rest = m[3] if m[2] else m[6]
        if tag in ENDS_P or tag in CLOSES:
            ends, stop = CLOSES.get(tag, ({"p"}, BLOCK - {"p"}))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in ends or tag in ENDS_P and stack[k].tag == "p":
                    del stack[k:]
                    break
        node = Node(tag, kind(tag, rest.strip()))
        stack[-1].kids.append(node)
        if tag in VOID or rest.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
            stop = end.start() if end else len(source)
            node.kids.append(source[at:stop])
            at = source.find(">", stop) + 1 if end else stop
            if at == 0:
                at = len(source)
            continue
        stack.append(node)
    if at < len(source):
        stack[-1].kids.append(source[at:])
    return root


class Slot:
    """A slot of a folded tree or wrapper: on how many pages, its text's hash (None if it varies), its characters."""

    __slots__ = ("by", "chars", "const", "kids", "label", "links", "pages", "part")

    def __init__(self, label: str, pages: int = 1, const: int | None = 0, chars: int = 0, links: int = 0, kids: list | None = None):
        self.label, self.pages, self.const, self.chars, self.links, self.kids = label, pages, const, chars, links, kids or []
        self.part = ""  # of a decided wrapper: `root`, `drop` or nothing
        self.by: dict[str, Slot] | None = None

    def under(self, label: str) -> Slot | None:
        if self.by is None:
            self.by = {k.label: k for k in self.kids}
        return self.by.get(label)

    def flat(self) -> list[list]:
        """The slots in page order, each with its depth."""
        out, todo = [], [(0, self)]
        while todo:
            d, s = todo.pop()
            out.append([d, s.label, s.pages, s.const, s.chars, s.links])
            todo += [(d + 1, k) for k in reversed(s.kids)]
        return out

    @staticmethod
    def of(rows: list[list]) -> Slot:
        line: list[Slot] = []
        for d, *rest in rows:
            s = Slot(*rest)
            del line[d:]
            if line:
                line[-1].kids.append(s)
            line.append(s)
        return line[0]


def folded(nodes: list[Node], link: bool = False) -> Slot:
    """One slot for nodes of one label: siblings below them fold by label, in the order first seen."""
    out, texts = Slot(nodes[0].label), []
    under: dict[str, list[Node]] = {}
    for node in nodes:
        for kid in node.kids:
            if type(kid) is str:
                if not kid.isspace():
                    texts.append(kid)
            else:
                under.setdefault(kid.label, []).append(kid)
    link = link or nodes[0].tag == "a"
    n = sum(map(len, texts))
    out.chars, out.links = (0, n) if link else (n, 0)
    out.const = xxhash.xxh32_intdigest(" ".join(texts)) if texts else 0
    out.kids = [folded(ns, link) for ns in under.values()]
    return out


def matched(a: list[Slot], b: list[Slot], memo: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two child lists: the size of the largest order-keeping match and its top pairs.

    Only labels that both lists have can match. memo keeps the pairs of every two slots that were compared, by their ids.
    """
    memo = {} if memo is None else memo
    left, right = {x.label for x in a}, {y.label for y in b}
    ia, ib = [i for i, x in enumerate(a) if x.label in right], [j for j, y in enumerate(b) if y.label in left]
    own: dict[str, int] = {}
    place = {b[j].label: j for j in ib}
    for i in ia:
        y = b[place[a[i].label]]
        size, memo[id(a[i]), id(y)] = matched(a[i].kids, y.kids, memo)
        own[a[i].label] = size + 1
    if [a[i].label for i in ia] == [b[j].label for j in ib]:  # the common case needs no table
        return sum(own.values()), list(zip(ia, ib))
    w = [[0] * (len(ib) + 1) for _ in range(len(ia) + 1)]
    for i, x in enumerate(ia, 1):
        for j, y in enumerate(ib, 1):
            w[i][j] = max(w[i - 1][j], w[i][j - 1], w[i - 1][j - 1] + (own[a[x].label] if a[x].label == b[y].label else 0))
    pairs, i, j = [], len(ia), len(ib)
    while i and j:
        if w[i][j] == w[i - 1][j]:
            i -= 1
        elif w[i][j] == w[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((ia[i], ib[j]))
    return w[-1][-1], pairs[::-1]


def merged(a: Slot, b: Slot) -> Slot:
    """The wrapper of both: aligned slots add up; a slot of one side alone keeps its place."""
    memo: dict = {}
    return joined(a, b, matched(a.kids, b.kids, memo)[1], memo)


def joined(a: Slot, b: Slot, pairs: list[tuple[int, int]], memo: dict) -> Slot:
    at = {j: i for i, j in pairs}
    kids, place = list(a.kids), {x.label: i for i, x in enumerate(a.kids)}
    for j, y in enumerate(b.kids):
        i = at.get(j, place.get(y.label))  # out of order but of the same label: the same slot
        if i is None:
            kids.append(y)
        else:
            kids[i] = joined(kids[i], y, memo[id(kids[i]), id(y)], memo)
    return Slot(a.label, a.pages + b.pages, a.const if a.const == b.const else None, a.chars + b.chars, a.links + b.links, kids)


def decided(w: Slot) -> Slot:
    """The wrapper with its parts marked: the content root, and template slots below it. Nothing depends on the slots' order.

    A slot counts for nothing where its text never changes though the page's does, from two pages on.
    """
    varies: dict[int, bool] = {}
    mass: dict[int, int] = {}
    line = []  # every slot after all that are above it
    todo = [w]
    while todo:
        line.append(s := todo.pop())
        todo += s.kids
    for s in reversed(line):
        varies[id(s)] = s.const is None or any([varies[id(k)] for k in s.kids])
    for s in reversed(line):
        own = 0 if varies[id(w)] and s.const is not None else s.chars
        mass[id(s)] = 0 if said_of(s.label) == UNWANTED else own + sum([mass[id(k)] for k in s.kids])
    whole = mass[id(w)]

    def article(s: Slot) -> bool:
        return s.label.split(" ", 1)[0] in ("article", "main") or "@main" in s.label

    # doubted slots: kept where they hold most of the text and no article stands outside of them
    out: dict[int, bool] = {}
    inside: dict[int, bool] = {}  # in a doubted or unwanted slot
    for s in line:
        inside[id(s)] = inside.get(id(s), False)
        for k in s.kids:
            inside[id(k)] = inside[id(s)] or said_of(k.label) != WANTED
    open_ = sum([s.chars for s in line if not inside[id(s)] and not (varies[id(w)] and s.const is not None) and mass[id(s)]])
    elsewhere = any([article(s) and not inside[id(s)] and mass[id(s)] > 0 and mass[id(s)] >= 0.2 * open_ for s in line])
    depth, dead = {id(w): 0}, {id(w): False}
    for s in line:
        said = said_of(s.label)
        kept = said == WANTED or said == DOUBTED and whole > 0 and 2 * mass[id(s)] >= whole and (not elsewhere or any_article(s, article, mass, whole))
        out[id(s)] = not kept
        for k in s.kids:
            depth[id(k)], dead[id(k)] = depth[id(s)] + 1, dead[id(s)] or out[id(s)]
    for s in reversed(line):  # masses without what is left out
        own = 0 if varies[id(w)] and s.const is not None else s.chars
        mass[id(s)] = 0 if out[id(s)] else own + sum([mass[id(k)] for k in s.kids])
    whole = mass[id(w)]
    found = [s for s in line if article(s) and not out[id(s)] and not dead[id(s)]]
    if found and (top := max([mass[id(s)] for s in found])) >= 0.2 * whole:
        # the innermost that has nearly all: an article in a main
        root = min([s for s in found if mass[id(s)] >= 0.9 * top], key=lambda s: (-depth[id(s)], -mass[id(s)], s.label))
    else:
        root = w
        while whole and (best := [k for k in root.kids if not out[id(k)] and mass[id(k)] >= 0.8 * whole and k.label.split(" ")[0] not in ("p", "span", "b", "i", "em", "strong")]):
            root = best[0]  # two of them can't hold so much each
    root.part = "root"
    todo = list(root.kids)
    while todo:
        k = todo.pop()
        # a heading or an emphasised word may well recur in articles
        container = " " in k.label and k.label.split(" ")[0] in BLOCK or k.label in ("div", "section")
        # text that never changes is template only if the rest of the root does change
        same = container and k.pages >= 2 and varies[id(root)] and not varies[id(k)] and (k.chars or k.links or k.kids)
        if out[id(k)] or same and k.pages * 2 >= w.pages:
            k.part = "drop"
        else:
            todo += k.kids
    return w


def any_article(s: Slot, article, mass: dict[int, int], whole: int) -> bool:
    """Whether an article with a part of the text stands in a slot."""
    todo = [s]
    while todo:
        x = todo.pop()
        if article(x) and mass[id(x)] >= 0.2 * whole:
            return True
        todo += x.kids
    return False


SPACES = re.compile(r"\s+")


def text_below(tree: Node, wrapper: Slot) -> str:
    """Text of the nodes at the wrapper's root: one space for white space, blocks in page order joined by one space.

    A node whose slot the wrapper doesn't have is read by what its own label says.
    """
    parts: list[str] = []
    todo: list[tuple[Node | str, Slot | None, bool]] = [(tree, wrapper, wrapper.part == "root")]
    while todo:
        node, slot, inside = todo.pop()
        if type(node) is str:
            if inside:
                parts.append(node)
            continue
        below: list[tuple[Node | str, Slot | None, bool]] = []
        for kid in node.kids:
            if type(kid) is str:
                below.append((kid, None, inside))
                continue
            own = slot.under(kid.label) if slot is not None else None
            if not inside:
                if own is not None:
                    below.append((kid, own, own.part == "root"))
            elif own is not None and own.part != "drop" or own is None and said_of(kid.label) != UNWANTED:
                below.append((kid, own, True))
        if inside and node.tag in BLOCK:
            below = [(" ", None, True), *below, (" ", None, True)]
        todo += reversed(below)
    return SPACES.sub(" ", html.unescape("".join(parts))).strip()


def extracted(source: str, wrapper: Slot | None) -> str:
    """The main text of a page, by its host's decided wrapper, or by its own tree where the wrapper's root isn't in it."""
    tree = parsed(source)
    if wrapper is not None and (text := text_below(tree, wrapper)):
        return text
    return text_below(tree, decided(folded([tree])))


def host(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://|^//", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0].rsplit("@")[-1]


def wrappers(pages: DataFrame, salts: int = 16, most_hosts: int = 2000) -> DataFrame:
    """(host, wrapper as JSON) from all pages (url, html)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Slot] = {}

        def out() -> pa.RecordBatch:
            names = list(held)
            blobs = [json.dumps(held[h].flat(), separators=(",", ":")) for h in names]
            held.clear()
            return pa.RecordBatch.from_pydict({"host": names, "wrapper": blobs}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

        for b in batches:
            for url, source in zip(b.column(0), b.column(1)):
                if source := source.as_py():
                    h, tree = host(url.as_py()), folded([parsed(source)])
                    held[h] = merged(held[h], tree) if h in held else tree
                    if len(held) > most_hosts:
                        yield out()
        yield out()

    def together(t: pa.Table) -> pa.Table:
        blobs = sorted(t.column("wrapper").to_pylist())
        w = Slot.of(json.loads(blobs[0]))
        for x in blobs[1:]:
            w = merged(w, Slot.of(json.loads(x)))
        return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": [json.dumps(w.flat(), separators=(",", ":"))]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    schema = "host string, wrapper string"
    parts = pages.select("url", "html").mapInArrow(partial, schema)
    salted = parts.groupBy("host", F.abs(F.xxhash64("wrapper")) % salts).applyInArrow(lambda t: together(t.select(["host", "wrapper"])), schema)
    return salted.groupBy("host").applyInArrow(together, schema)


@lru_cache(maxsize=256)
def prepared(blob: str) -> Slot:
    return decided(Slot.of(json.loads(blob)))


def main_texts(pages: DataFrame, stored) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html; other columns are left out).

    A null or empty html gives the empty text, as does a page without any content slot. A null url is a host of its own.
    stored: writes the wrappers (a few KB a host) as a table, so that Spark knows their size when it joins them.
    """
    found = stored(wrappers(pages), "wrappers").withColumnRenamed("host", "__host")
    host_of = F.arrow_udf(lambda u: pa.array([host(x.as_py()) for x in u], pa.string()), "string")
    held = pages.select("page_id", "url", "html", host_of("url").alias("__host")).join(found, "__host", "left").select("page_id", "url", "html", "wrapper")

    @F.arrow_udf("string")
    def text(sources: pa.Array, blobs: pa.Array) -> pa.Array:
        out = []
        for source, blob in zip(sources, blobs):
            s, b = source.as_py(), blob.as_py()
            out.append(extracted(s, prepared(b)) if s and b else extracted(s, None) if s else "")
        return pa.array(out, pa.string())

    return held.select("page_id", "url", text("html", "wrapper").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
