"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree of element nodes (a node is the path of
tags and classes that leads to it). Of every node two things are counted over all the
host's pages: which sequences of child elements it has (presentation) and which text
blocks (content). Their entropies, in the base of the number of pages, give the node's
importance: many presentations and texts of its own make a node important, the same on
every page unimportant. A node's composite importance mixes its own presentation with
its children's importance; a branch whose nodes are all below the threshold is removed
from each page. A host of one page has nothing to compare, and all of it is important.

Some markup says by itself that it is not the article: navigation, footers, scripts, form
fields, hidden elements and so on (certain), and classes and ids named after such things,
replies or cards, and forms (likely). A likely one stays if it wraps the page's article or
main element or, on a page without these, holds most of the text and few links: themes put
such names on whole pages. Of articles the page's own are those within the fewest elements
that may be replies, so a comment that is an article is no article of the page, and an
article with a name of comments stays where there is no other. Where a page has a main element its text counts, or that of the articles in
it if they are most of it; else that of its articles, if they are more than a scrap of the
page. Where the tree would leave nothing of a page (a host of copies of one page), the
page keeps what markup leaves.

Every step is linear in the length of a page, however its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle, small_batches
from .textops import bounded

#: Weight of a node's own presentation, the importance below which a branch goes, and
#: the pages a node must be on for its importance to mean anything: those of any site.
GAMMA, THRESHOLD, PAGES = 0.9, 0.2, 2
#: Elements nested deeper than this share the tree node of their ancestor at this depth;
#: their texts count as its own. Only the tree is coarser there, no text is lost.
DEPTH = 48

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
NOISE = frozenset("head title nav footer aside button select textarea input menu dialog svg canvas object audio video map datalist label".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations widget widgets toolbar pagination pager skip login copyright disclaimer".split()
)
# names that say whose an element is not: has-sidebar, no-comments
MODIFIERS = frozenset("has have no not non with without show shows hide hides enable disable".split())
REPLIES = frozenset("comment comments commentlist disqus respond reply replies".split())
# names of cards of other articles
CARDS = frozenset("related promo teaser".split())
# a start tag of the second closes an open element of the first
CLOSED_BY = {"p": BLOCK - {"head", "title", "option", "optgroup", "caption"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
# an implied end does not reach out of these
SCOPE = frozenset("html body table td th article section main div ul ol dl aside nav header footer form blockquote".split())

CLOSES: dict[str, tuple[str, ...]] = {t: tuple(k for k, v in CLOSED_BY.items() if t in v) for t in {t for v in CLOSED_BY.values() for t in v}}

_COMMENT_END = re.compile("--!?>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_VALUES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ROOT = 0
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def node_hash(parent: int, key: str) -> int:
    x = xxhash.xxh64_intdigest(f"{parent}/{key}")
    return x - (1 << 64) if x >> 63 else x


class Page:
    """One pass over a page's markup. `blocks` are (node, unimportant, zone, text, how much
    of it is in links); `nodes` maps a node to (parent, depth, child keys in order, runs
    counted once); `zones` are the elements that say what they are, as (zone around, kind),
    each after the one around it."""

    def __init__(self, source: str, cache: dict, unimportant: frozenset[int] = frozenset()):
        self.blocks: list[tuple[int, bool, int, str, int]] = []
        self.nodes: dict[int, tuple[int, int, list[str]]] = {}
        self.zones: list[tuple[int, str]] = [(0, "page")]
        self.cache, self.unimportant = cache, unimportant
        # open elements: (tag, node, zone, unimportant, place of the innermost scope);
        # where: the places of every open tag
        self.open: list[tuple[str, int, int, bool, int]] = []
        # muted: places of open elements within a line that are certain noise
        self.where: dict[str, list[int]] = {}
        self.muted: list[int] = []
        self.text: list[str] = []
        self.linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                _, node, zone, weak, _ = self.open[-1] if self.open else ("", _ROOT, 0, False, -1)
                self.blocks.append((node, weak, zone, text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def _say(self, text: str) -> None:
        if self.muted:
            return
        self.text.append(text)
        if self.where.get("a"):
            self.linked += len(text)

    def _close(self, at: int) -> None:
        for e in self.open[at:]:
            self.where[e[0]].pop()
        del self.open[at:]
        while self.muted and self.muted[-1] >= at:
            self.muted.pop()

    def _start(self, tag: str, attributes: str, closed: bool) -> None:
        at = max((self.where[k][-1] for k in CLOSES.get(tag, ()) if self.where.get(k)), default=-1)
        if at >= 0 and at >= self.open[-1][4]:
            self._flush()
            self._close(at)
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        _, parent, zone, weak, scope = self.open[-1] if self.open else ("", _ROOT, 0, False, -1)
        made = self.cache.get((parent, tag, attributes))
        if made is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            made = self._kind(parent, tag, attributes)
            if len(attributes) < 300:
                self.cache[parent, tag, attributes] = made
        key, node, kind = made
        depth = len(self.open) + 1
        if depth > DEPTH:
            node = parent
        if tag not in VOID:
            self.nodes.setdefault(node, (parent, depth, []))
        above = self.nodes.get(parent)
        if above is not None and (not above[2] or above[2][-1] != key):
            above[2].append(key)
        if tag in VOID or closed and tag not in BLOCK:
            return
        if not kind and tag == "header" and not (self.where.get("article") or self.where.get("main")):
            kind = "noise"
        if kind:
            self.zones.append((zone, kind))
            zone = len(self.zones) - 1
        if kind == "noise" and tag not in BLOCK:
            self.muted.append(len(self.open))
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node, zone, weak or node in self.unimportant, len(self.open) if tag in SCOPE else scope))

    @staticmethod
    def _kind(parent: int, tag: str, attributes: str) -> tuple[str, int, str]:
        """Key and node of an element, and what it says it is: noise for certain, likely
        noise, noise if it is made of links, replies, likely replies, an article, main, an
        article or main that may be a reply or a card, or nothing."""
        key, kind = tag, "noise" if tag in NOISE else "likely" if tag == "form" else tag if tag in ("article", "main") else ""
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = next(filter(None, values), "")
                name = name.lower()
                if name in ("class", "id"):
                    words = [[w.lower() for w in _NAME.findall(v)] for v in value.split()]
                    if name == "class":
                        key += "." + "-".join(sorted({w for v in words for w in v}))
                    words = [v for v in words if v and v[0] not in MODIFIERS]
                    if kind in ("article", "main") and any(not (REPLIES | CARDS).isdisjoint(v) for v in words):
                        kind += "?"
                    if kind or tag in ("html", "body"):
                        continue
                    for v in words:
                        if not NOISE_NAMES.isdisjoint(v):
                            said = "replies" if REPLIES.issuperset(v) else "replies?" if not REPLIES.isdisjoint(v) or not CARDS.isdisjoint((v[0], v[-1])) else "likely" if v[0] in NOISE_NAMES or v[-1] in NOISE_NAMES else "links"
                            kind = max(kind, said, key=("", "links", "likely", "replies?", "replies").index)
                elif name == "role":
                    kind = "noise" if value.lower() in NOISE_ROLES else kind
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                    kind = "noise"
        return key, node_hash(parent, key), kind

    def _end(self, tag: str) -> None:
        if not self.where.get(tag):
            return
        at = self.where[tag][-1]
        if tag in BLOCK or any(e[0] in BLOCK for e in self.open[at:]):
            self._flush()
        self._close(at)

    def _read(self, source: str) -> None:
        """One pass: each search goes on from where the last one ended. After the last '>'
        there is text alone, and once quotes have hidden every further '>' from a tag they
        count for nothing on the rest of the page."""
        at, n, last, quotes = 0, len(source), source.rfind(">"), True
        while at < n:
            i = source.find("<", at)
            if i < 0 or i > last and not source.startswith("<!--", i):
                self._say(source[at:])
                break
            if i > at:
                self._say(source[at:i])
            tag = _TAG.match(source, i)
            if source.startswith("<!--", i):
                end = _COMMENT_END.search(source, i + 4)
                at = end.end() if end else n
            elif source.startswith(("<!", "<?"), i):
                at = source.find(">", i) + 1
            elif tag is None:
                self._say("<")
                at = i + 1
            else:
                end = _VALUES.match(source, tag.end()) if quotes else None
                quotes = end is not None
                at = end.end() if end else source.find(">", tag.end()) + 1
                self._tag(tag[2].lower(), bool(tag[1]), source[tag.end() : at - 1])
                if tag[2].lower() in RAW and not tag[1]:
                    end = _END[tag[2].lower()].search(source, at)
                    at = end.end() if end else n
        self._flush()

    def _tag(self, tag: str, ends: bool, attributes: str) -> None:
        if ends:
            self._end(tag)
        elif tag not in RAW:
            self._start(tag, attributes.rstrip("/").strip() if attributes.strip() else "", attributes.endswith("/"))

    def _gone(self) -> list[bool]:
        """Which zones are no part of the article, with all that is in them."""
        n = len(self.zones)
        size, links = [0] * n, [0] * n
        for _, _, z, text, linked in self.blocks:
            size[z] += len(text)
            links[z] += linked
        kinds = [k for _, k in self.zones]
        certain = [k == "noise" for k in kinds]
        # how many zones around one, itself with them, may be replies or cards; a name of nothing else counts twice
        replies, weight = [0] * n, {"replies": 2, "replies?": 1, "article?": 1, "main?": 1}
        for z in range(1, n):
            up = self.zones[z][0]
            certain[z] |= certain[up]
            replies[z] = replies[up] + weight.get(kinds[z], 0)
        for z in range(n - 1, 0, -1):
            if not certain[z]:
                size[self.zones[z][0]] += size[z]
                links[self.zones[z][0]] += links[z]
        # the page's own articles are those within the fewest replies; inside any, the largest
        own = [z for z in range(1, n) if not certain[z] and kinds[z].rstrip("?") in ("article", "main")]
        fewest = min((replies[z] for z in own), default=0)
        own = [z for z in own if replies[z] == fewest]
        if fewest:
            own = [max(own, key=lambda z: (size[z], -z))]
        wraps = [False] * n
        for z in own:
            wraps[z] = True
        for z in range(n - 1, 0, -1):
            wraps[self.zones[z][0]] |= wraps[z]
        gone = certain
        for z in range(1, n):
            up, kind = self.zones[z]
            most = not wraps[0] and 2 * size[z] > size[0] and 2 * links[z] < size[z]
            if kind == "replies":  # no other name: all of a page, or nothing of it
                most = most and 10 * size[z] > 9 * size[0]
            here = kind in ("replies", "replies?", "likely", "article?", "main?") and not (wraps[z] or most) or kind == "links" and not wraps[z] and 2 * links[z] > size[z]
            gone[z] |= here or gone[up]
        return gone

    def main_text(self) -> str:
        """The blocks that are left, joined by line ends."""
        gone = self._gone()
        within: list[tuple[bool, bool]] = []
        for z, (up, kind) in enumerate(self.zones):
            article, main = within[up] if z else (False, False)
            within.append((article or kind.rstrip("?") == "article", main or kind.rstrip("?") == "main"))
        left = [b for b in self.blocks if not gone[b[2]]]
        length = lambda rows: sum(len(b[3]) for b in rows)
        main = [b for b in left if within[b[2]][1]]
        articles = [b for b in main or left if within[b[2]][0]]
        # a scrap of a page, or less than half of its main element, is a card among others
        if length(articles) >= (0.5 * length(main) if main else 0.1 * length(left)):
            left = articles or main or left
        else:
            left = main or left
        return "\n".join(b[3] for b in [b for b in left if not b[1]] or left)


def style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, node, parent, depth, kind, value): of each page every node's
    sequence of children (kind 0) and its different text blocks (kind 1)."""
    cache: dict = {}
    names = ["host", "node", "parent", "depth", "kind", "value"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    for b in bounded(batches, 1, 1 << 22):
        rows = []
        for host, source in zip(b.column(0).to_pylist(), b.column(1)):
            page = Page(source.as_py() or "", cache)
            content: dict[int, set[int]] = {}
            for node, _, _, text, _ in page.blocks:
                if node != _ROOT:
                    content.setdefault(node, set()).add(node_hash(1, text))
            for node, (parent, depth, children) in page.nodes.items():
                rows.append((host, node, parent, depth, 0, node_hash(2, " ".join(children))))
                rows += [(host, node, parent, depth, 1, v) for v in content.get(node, ())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, parent, depth, pages, composite, peak) of every node of every site's
    tree; peak is the largest composite importance in the node's branch."""
    rows = pages.select("host", "html").mapInArrow(style_rows, "host string, node long, parent long, depth int, kind int, value long")
    counted = rows.groupBy("host", "node", "parent", "depth", "kind", "value").agg(F.count("*").alias("c"))
    style, c = F.col("kind") == 0, F.col("c")
    own = counted.groupBy("host", "node", "parent", "depth").agg(
        F.sum(F.when(style, c)).alias("pages"),
        F.sum(F.when(style, c * F.log(c))).alias("same"),
        F.count(F.when(style, 1)).alias("styles"),
        F.avg(F.when(~style, F.log(c))).alias("shared"),
        F.count(F.when(~style, 1)).alias("texts"),
    )
    log_m = F.log(F.col("pages"))
    several = F.col("pages") > 1
    own = settle(own.select("host", "node", "parent", "depth", "pages", "styles", "texts",
        F.when(several, 1 - F.col("same") / (F.col("pages") * log_m)).otherwise(1.0).alias("presentation"),
        F.when(F.col("texts") > 0, F.when(several, F.greatest(F.lit(0.0), 1 - F.col("shared") / log_m)).otherwise(1.0)).alias("content")), "style")
    deepest = own.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    done, below = None, None
    for depth in range(deepest, 0, -1):
        level = own.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("inner", F.lit(None).cast("double")).withColumn("inner_pages", F.lit(0).cast("long")).withColumn("inner_peak", F.lit(None).cast("double"))
        else:
            level = level.join(below, ["host", "node"], "left").withColumn("inner_pages", F.coalesce("inner_pages", F.lit(0)))
        # a node's own texts weigh as a child that is on as many pages as the node
        text_pages = F.when(F.col("content").isNotNull(), F.col("pages")).otherwise(0)
        weight = F.col("inner_pages") + text_pages
        inner = F.when(weight > 0, (F.coalesce("inner", F.lit(0.0)) * F.col("inner_pages") + F.coalesce("content", F.lit(0.0)) * text_pages) / weight)
        g = F.pow(F.lit(GAMMA), F.col("styles"))
        level = level.withColumn("composite", F.when(inner.isNull(), F.col("presentation")).otherwise((1 - g) * F.col("presentation") + g * inner))
        level = level.withColumn("peak", F.greatest("composite", F.coalesce("inner_peak", "composite")))
        level = settle(level.select("host", "node", "parent", "depth", "pages", "composite", "peak"), "level")
        below = level.groupBy("host", F.col("parent").alias("node")).agg((F.sum(F.col("composite") * F.col("pages")) / F.sum("pages")).alias("inner"), F.sum("pages").alias("inner_pages"), F.max("peak").alias("inner_peak"))
        done = level if done is None else done.union(level)
    return done if done is not None else own.select("host", "node", "parent", "depth", "pages", F.lit(1.0).alias("composite"), F.lit(1.0).alias("peak"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, least_pages: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; the text is '' where none is found.

    Null and empty pages have the empty text; markup that ends early counts as far as it
    goes; pages without a host share one site; repeated rows are extracted each; an empty
    table gives no rows; other columns are ignored, whatever their names; a very long or
    deeply nested page takes time and memory in proportion to its length. Of equal pages
    of a host each is counted and each gets the same text. `least_pages` and the depth to
    which the tree tells nodes apart (DEPTH) are bounds on the tree, not on texts.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    all_weak = settle(importance(rows).where((F.col("pages") >= least_pages) & (F.col("peak") < threshold)).select("host", "node", "parent"), "weak")
    # what is in a branch that goes need not be named: a site has few such branches
    roots = all_weak.join(all_weak.select("host", F.col("node").alias("parent")), ["host", "parent"], "left_anti")
    weak = settle(roots.select("host", "node"), "weak")
    by_host = weak.groupBy("host").agg(F.collect_set("node").alias("weak"))
    joined = rows.join(F.broadcast(by_host) if weak.count() <= BROADCAST_ROWS else by_host, "host", "left").select("page_id", "url", "html", "weak")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in bounded(batches, 2, 1 << 22):
            texts = [Page(source.as_py() or "", cache, frozenset(weak or ())).main_text() for source, weak in zip(b.column(2), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {dict(pages.dtypes)[id_col]}, url string, text string, n_chars long")
