"""HTML main-text extraction with a site style tree: what a site's pages share in form and words is not content.

All pages of a host are merged: a node of the site tree is a path of tags and classes. A node's importance is its
weight times the larger of its presentation entropy (how varied its children are from page to page) and its content
entropy (how varied the text of its branch is). The weight is what the pages themselves say: little for navigation,
footers, asides, forms, adverts, notices and comments and for what lies outside the article of a page that has one,
all for the article, half where nothing is said. Every branch that goes from a page goes by its node's importance.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stash, stash_texts

#: Branches of less importance are removed.
LEAST_IMPORTANCE = 0.15
#: Weights of a node: marked as no content, or outside a page's article; nothing said; in an article or main element, or holding it.
MARKED, PLAIN, CONTENT = 0.1, 0.5, 1.0
#: An entropy counts with its pages against so many of one that is 1: a node that few pages show is not judged by them.
PRIOR_PAGES = 1
#: Elements nested deeper are read as siblings, as browsers do; their text stays.
DEEPEST = 512

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"\s+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are never text of the page.
HIDDEN = RAW | frozenset("head template svg math canvas object audio video select button datalist map dialog".split())
BOILERPLATE = frozenset("nav footer aside form menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the set, unless one of the walls stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_WALLS = frozenset("article section div main aside nav footer header body html table td th li ul ol dl blockquote form".split())
#: Parts of class names, ids and roles that mark a branch as no content.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations comment comments disqus replies respond widget search pagination pager toolbar copyright hidden masthead contentinfo complementary dialog".split()
)

#: Marks that also name the wrapper of a whole layout: such an element is content if it holds the article.
LAYOUT = frozenset("sidebar header nav menu footer navigation hidden overlay modal banner search".split())


@dataclass
class Node:
    tag: str
    parent: int
    shown: str
    key: int
    dull: bool
    wraps: bool
    landmark: bool
    #: Key of the outermost marked element that a main element is or lies in, if nothing but marks speaks against it.
    doubt: int | None = None
    #: Marked by more than its class, id and role.
    firm: bool = False
    holds_landmark: bool = False
    children: list[str] = field(default_factory=list)
    words: xxhash.xxh64 | None = None


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(text)} if text else {}


def _marks(attrs: dict[str, str]) -> set[str]:
    named = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
    return {x.lower() for x in _NAME_PART.findall(named)} if named.strip() else set()


class Page:
    """The elements of a page as a tree, and its text in blocks, from a lenient reading that never fails."""

    def __init__(self, source: str | None) -> None:
        self.nodes = [Node("", -1, "", 0, False, False, False)]
        self.blocks: list[tuple[int, str]] = []
        self._open, self._text = [0], []
        self._block_at = 0
        self._read(source or "")
        self._flush()
        self._settle()
        for node in self.nodes[:0:-1]:
            if node.landmark or node.holds_landmark:
                self.nodes[node.parent].holds_landmark = True

    def _settle(self) -> None:
        """Make main elements with marks landmarks too, if one of them holds more text than all landmarks without."""
        doubtful = {k for k, node in enumerate(self.nodes) if node.doubt is not None}
        if not doubtful:
            return
        sure, held = 0, dict.fromkeys(doubtful, 0)
        for k, text in self.blocks:
            for x in self.path(k):
                node = self.nodes[x]
                if x in doubtful:
                    held[x] += len(text)
                if node.landmark:
                    sure += len(text)
                if node.landmark or node.dull:
                    break
        best = max(doubtful, key=lambda k: (held[k], -k))
        if held[best] > sure:
            for k in doubtful:
                if self.nodes[k].doubt == self.nodes[best].doubt:
                    self.nodes[k].landmark, self.nodes[k].dull = True, False

    def _flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self._text))).strip()
        if text:
            self.blocks.append((self._open[-1] if self._block_at is None else self._block_at, text))
        self._text, self._block_at = [], None

    def _say(self, text: str) -> None:
        if self._block_at is None and text.strip():
            self._block_at = self._open[-1]
        self._text.append(text)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        if len(self._open) >= DEEPEST:
            self._open.pop()
        parent = self._open[-1]
        marks = _marks(attrs)
        shown = f"{tag}.{'.'.join(sorted(attrs.get('class', '').split()))}"
        hidden = tag in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None
        main = tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody"
        above = [self.nodes[k] for k in self._open]
        by_tag = hidden or tag in BOILERPLATE or (tag == "header" and not any(x.landmark or x.doubt is not None for x in above))
        # Marks on the page itself say nothing of a part of it.
        dull = by_tag or (tag not in ("html", "body") and bool(marks & MARKS))
        wraps = dull and not hidden and tag in ("form", "div", "section", "body", "html") and (marks & MARKS) <= LAYOUT
        landmark = main and not dull and all(not x.dull or x.wraps for x in above)
        key = xxhash.xxh64_intdigest(f"{self.nodes[parent].key}/{shown}") >> 1
        node = Node(tag, parent, shown, key, dull, wraps, landmark)
        node.firm = hidden or (by_tag and tag != "form")
        if main and not landmark and not node.firm and not any(x.firm for x in above):
            node.doubt = next((x.key for x in above if x.dull and not x.wraps), key)
        self.nodes.append(node)
        self.nodes[parent].children.append(shown)
        self._open.append(len(self.nodes) - 1)

    def _close(self, tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.nodes[self._open[depth]].tag
            if tag in tags:
                del self._open[depth:]
                return
            if tag in walls:
                return

    def _read(self, source: str) -> None:
        at = 0
        while (m := _TAG.search(source, at)) is not None:
            self._say(source[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if name in BLOCK or name in HIDDEN:
                self._flush()
            if m["end"] or m["end2"]:
                if name == "br":
                    self._say(" ")
                else:
                    self._close({name}, frozenset())
                continue
            if name in ("br", "img", "wbr", "hr"):
                self._say("" if name == "wbr" else " ")
            if name in VOID:
                continue
            if name in BLOCK:
                self._close({"p"}, _WALLS)
            if name in CLOSES:
                self._close(*CLOSES[name])
            attrs_text = m["attrs"] or m["attrs2"] or ""
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                at = len(source) if end is None else max(source.find(">", end.start()) + 1, end.end())
                continue
            if not attrs_text.rstrip().endswith("/") or name in BLOCK:
                self._push(name, _attributes(attrs_text))
        # A "<" that begins no tag is text; a tag that never ends is not.
        self._say(source[at:])

    def path(self, k: int) -> list[int]:
        out = []
        while k > 0:
            out.append(k)
            k = self.nodes[k].parent
        return out

    def _content(self) -> set[int]:
        """The article and main elements that hold the page's text: the articles, if they hold half of it or more."""
        held: dict[int, int] = {}
        everywhere = in_articles = 0
        for k, text in self.blocks:
            path = self.path(k)
            if any(self.nodes[x].dull and not self.nodes[x].holds_landmark for x in path):
                continue
            marks = [x for x in path if self.nodes[x].landmark]
            everywhere += len(text) if marks else 0
            in_articles += len(text) if any(self.nodes[x].tag == "article" for x in marks) else 0
            held.update((x, 1) for x in marks)
        return {x for x in held if self.nodes[x].tag == "article"} if held and 2 * in_articles >= everywhere else set(held)

    def merged(self) -> tuple[list[tuple[int, float, int, int]], list[tuple[list[int], str]]]:
        """The page as its part of the site tree: nodes ``(node, weight, presentation, content)`` and blocks ``(path, text)``.

        Elements of one path of tags, classes and weights are one node; only nodes with text are listed. A block's
        path holds places in that list. Loose text beside the article in an element that holds it is a node too.
        """
        content = self._content()
        inside, holds = [False] * len(self.nodes), [False] * len(self.nodes)
        for k in sorted(content):
            x = self.nodes[k].parent
            while x >= 0 and not holds[x]:
                holds[x] = True
                x = self.nodes[x].parent
        key, weight = [0] * len(self.nodes), [CONTENT if holds[0] else PLAIN] * len(self.nodes)
        for k, node in enumerate(self.nodes[1:], 1):
            inside[k] = k in content or inside[node.parent]
            if node.dull and not node.holds_landmark:
                weight[k] = MARKED
            else:
                weight[k] = PLAIN if not content else CONTENT if inside[k] or holds[k] else MARKED
            key[k] = xxhash.xxh64_intdigest(f"{key[node.parent]}/{node.shown}/{weight[k]}") >> 1
        place: dict[int, int] = {}
        nodes: list[tuple[int, float]] = []
        words: list[xxhash.xxh64] = []

        def at(name: int, w: float) -> int:
            if name not in place:
                place[name] = len(nodes)
                nodes.append((name, w))
                words.append(xxhash.xxh64(seed=2))
            return place[name]

        blocks = []
        for k, text in self.blocks:
            path = list(dict.fromkeys(at(key[x], weight[x]) for x in self.path(k)[::-1]))
            if content and not inside[k]:
                path.append(at(xxhash.xxh64_intdigest(f"{key[k]}/#text") >> 1, MARKED))
            elif not path:
                path.append(at(1, PLAIN))
            for x in path:
                words[x].update(text)
            blocks.append((path, text))
        shape = [xxhash.xxh64(seed=1) for _ in nodes]
        for k, node in enumerate(self.nodes[1:], 1):
            if key[k] in place:
                runs = [c for j, c in enumerate(node.children) if not j or c != node.children[j - 1]]
                shape[place[key[k]]].update(f"{len(node.children)}:{','.join(runs)};")
        return [(n, w, shape[x].intdigest() >> 1, words[x].intdigest() >> 1) for x, (n, w) in enumerate(nodes)], blocks


def main_text(source: str | None, low: set[int] | None = None) -> str:
    """The page's blocks outside branches of ``low`` nodes, joined by a blank line; by default the page is a site of its own.

    If the site's nodes would take every block, or more than half of the text of an article or main element, the
    site has said nothing about this page, and only nodes of little weight go.
    """
    nodes, blocks = Page(source).merged()
    light = {n for n, w, _, _ in nodes if w < LEAST_IMPORTANCE}
    left = lambda gone: [t for path, t in blocks if not any(nodes[x][0] in gone for x in path)]
    kept, sure = left(light if low is None else low), left(light)
    few = any(w == CONTENT for _, w, _, _ in nodes) and 2 * sum(map(len, kept)) < sum(map(len, sure))
    return "\n\n".join(kept if kept and not few else sure)


def host_of(url: str) -> F.Column:
    """The lower-cased host of a URL column; null if it has none."""
    return F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


_PAGE = "struct<nodes: array<struct<node: bigint, weight: double, shape: bigint, words: bigint>>, blocks: array<struct<path: array<int>, text: string>>>"


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _merged(sources: pa.Array) -> pa.Array:
    pages = [Page(x.as_py()).merged() for x in sources]
    nodes = [n for ns, _ in pages for n in ns]
    blocks = [b for _, bs in pages for b in bs]
    column = lambda j, kind: pa.array([n[j] for n in nodes], kind)
    node = pa.StructArray.from_arrays([column(0, pa.int64()), column(1, pa.float64()), column(2, pa.int64()), column(3, pa.int64())], ["node", "weight", "shape", "words"])
    path = _lists([len(p) for p, _ in blocks], pa.array([x for p, _ in blocks for x in p], pa.int32()))
    block = pa.StructArray.from_arrays([path, pa.array([t for _, t in blocks], pa.string())], ["path", "text"])
    return pa.StructArray.from_arrays([_lists([len(ns) for ns, _ in pages], node), _lists([len(bs) for _, bs in pages], block)], ["nodes", "blocks"])


def parsed(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``(page_id, url, host, template, nodes, blocks)``: every page read once (see :meth:`Page.merged`), written to the shared folder.

    A page without a host is a site with its copies. Pages of a site that show the same nodes share a template.
    """
    own = F.concat(F.lit(":"), F.xxhash64(url, source).cast("string"))
    host = F.when(F.coalesce(host_of(url), F.lit("")) == "", own).otherwise(host_of(url))
    found = stash_texts(pages.select("page_id", F.col(url).alias("url"), host.alias("host"), F.arrow_udf(_merged, _PAGE)(F.col(source)).alias("page")), "pages-parsed")
    template = F.xxhash64("host", F.array_sort(F.transform("page.nodes", lambda n: n["node"])))
    return found.select("page_id", "url", "host", template.alias("template"), F.col("page.nodes").alias("nodes"), F.col("page.blocks").alias("blocks"))


def site_tree(pages: DataFrame) -> DataFrame:
    """``(host, node, pages, weight, presentation, content, importance)`` of :func:`parsed` pages: every host's merged tree.

    Entropies are of the shares of a node's signatures, to the base of its pages, so 0 to 1. Signatures are
    counted by partial aggregates before the shuffle, so a host with a third of all pages is summed in parts.
    """
    rows = pages.select("host", F.explode("nodes").alias("n")).select("host", "n.node", "n.weight", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n.{c}").alias("sig")) for k, c in enumerate(("shape", "words"))])).alias("x"))
    counts = rows.groupBy("host", "node", "weight", "x.kind", "x.sig").agg(F.count("*").alias("c"))
    sums = counts.groupBy("host", "node", "weight", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    spread = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("entropy")))
    both = sums.withColumn("entropy", spread).groupBy("host", "node", "weight").agg(F.max("m").alias("pages"), of(0).alias("presentation"), of(1).alias("content"))
    entropy = (F.greatest("presentation", "content") * F.col("pages") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    return both.select("host", "node", "pages", "weight", "presentation", "content", (F.col("weight") * entropy).alias("importance"))


def low_nodes(pages: DataFrame, tree: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``(template, low)``: for each template with any, its nodes of low importance, as many as a page has at most."""
    low = tree.where(F.col("importance") < least_importance).select("host", "node")
    shown = pages.select("template", "host", F.explode("nodes.node").alias("node")).distinct()
    return shown.join(low, ["host", "node"]).groupBy("template").agg(F.collect_set("node").alias("low"))


def page_texts(pages: DataFrame, low: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of :func:`parsed` pages without the branches of ``low(template, low)``, as :func:`main_text` has it."""
    hits = lambda flags: lambda b: ~F.exists(b["path"], lambda x: F.get(flags, x))
    size = lambda bs: F.aggregate(bs, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    gone = F.transform("nodes", lambda n: F.coalesce(F.array_contains("low", n["node"]), F.lit(False)))
    light = F.transform("nodes", lambda n: n["weight"] < LEAST_IMPORTANCE)
    flagged = pages.join(low, "template", "left").select("page_id", "url", "nodes", "blocks", gone.alias("gone"), light.alias("light"))
    both = flagged.select("page_id", "url", F.exists("nodes", lambda n: n["weight"] == CONTENT).alias("found"), F.filter("blocks", hits(F.col("gone"))).alias("kept"), F.filter("blocks", hits(F.col("light"))).alias("sure"))
    enough = (F.size("kept") > 0) & ~(F.col("found") & (2 * size(F.col("kept")) < size(F.col("sure"))))
    text = F.concat_ws("\n\n", F.when(enough, F.col("kept.text")).otherwise(F.col("sure.text")))
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def extract(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html)``.

    Null or empty html gives empty text. Each page is parsed once; its site's nodes of low importance reach it by
    its template, in a table of its own: small ones are broadcast by their size, else the join is on the template,
    which adaptive execution splits for a hot one.
    """
    read = parsed(pages)
    return page_texts(read, stash(low_nodes(read, site_tree(read), least_importance), "pages-low"))
