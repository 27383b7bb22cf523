"""Main text of web pages by wrapper induction.

Pages of one host share a template. Pages are brought together by host (a host
with very many pages in several groups) and every page's DOM tree is aligned with
that of the page before it by simple tree matching: the heaviest set of matched
nodes that keeps order and descent. A matched block whose text is equal on both
pages speaks for template, one whose text differs for content. The votes of all
pages add up per host and slot, a slot being the path of tags and classes to a
block; so the work grows with the pages, not with the square of a host.

A slot that was constant in at least ``MIN_VOTES`` comparisons and never varied
is template; all others are content. What the markup itself calls something else
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) is dropped, and where a page marks its article, so is what is
outside. A host whose pages are all copies of one has no varying slot: then
nothing is known about its template and the markup alone decides.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, prepare, row_uid, stored

#: Comparisons from which on a slot that never varied is template.
MIN_VOTES = 5

# Fixed values of HTML: elements without content, elements whose text is no text, blocks, and elements that are not the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas".split())
ASIDE = frozenset("nav header footer aside form button select option textarea input label dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
# What closes an open p, and what closes its like.
CLOSES_P = BLOCK - frozenset("body caption html tbody td tfoot th thead tr legend".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Words of class, id and role that name something else than the main text.
OTHER = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|menubar|"
    r"breadcrumb|breadcrumbs|header|masthead|footer|sidebar|side|aside|related|share|sharing|social|comment|comments|commentlist|reply|replies|discussion|disqus|"
    r"cookie|cookies|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|"
    r"complementary|contentinfo|dialog)(?:$|[-_\s])"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Words before another one that make it a property of the page, and elements that hold the whole page.
_HAS = re.compile(r"(?:^|\s)(?:has|have|with|no|without|is|not|show|hide)[-_]\S*")
_WHOLE = frozenset(("html", "body", "main", "article"))
#: Elements below this depth are read like all others, but are leaves of the tree that is aligned.
_DEPTH = 200


class Node:
    """An element; ``texts`` are the blocks that it holds itself."""

    __slots__ = ("children", "kind", "label", "tag", "texts")

    def __init__(self, tag: str, kind: str, label: str):
        self.tag, self.kind, self.label, self.children, self.texts = tag, kind, label, [], []


class Page:
    """The block elements of a page as a tree, and its blocks of text in page order."""

    def __init__(self, html: str):
        self.root = Node("#", "", "")
        self._open = [self.root]
        #: How many open elements there are of each tag and kind.
        self._count: Counter[str] = Counter()
        self._now: list[str] | None = None
        self._found: list[tuple[str, bool, bool, Node, list[str]]] = []
        self._parse(html)
        #: (slot, text, other, inside an article)
        self.blocks: list[tuple[str, str, bool, bool]] = []
        for slot, other, inside, node, parts in self._found:
            text = " ".join("".join(parts).split())
            if text:
                node.texts.append(text)
                self.blocks.append((slot, text, other, inside))
        self.marked = any(inside and not other for _, _, other, inside in self.blocks)

    def main(self) -> list[tuple[str, str]]:
        """``(slot, text)`` of the blocks that may be main text."""
        return [(slot, text) for slot, text, other, inside in self.blocks if not other and (inside or not self.marked)]

    def _parse(self, html: str) -> None:
        at = 0
        while m := _TOKEN.match(html, at):
            at = m.end()
            tag = m["tag"]
            if m["text"] is not None:
                self._text(m["text"])
            elif tag:
                tag = tag.lower()
                if m["end"]:
                    self._end(tag)
                    continue
                self._start(tag, m["attrs"])
                if tag in RAW:
                    # Up to its end tag an element of this kind holds no markup.
                    close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    at = close.start() if close else len(html)

    def _text(self, text: str) -> None:
        if self._now is None:
            if not text.strip():
                return
            self._now = []
            slot = "/".join(n.label for n in self._open[1:_DEPTH] if n.label)
            other, inside = self._count["#other"] > 0, self._count["#article"] > 0
            node = next(n for n in reversed(self._open[:_DEPTH]) if n.label or n is self.root)
            self._found.append((slot, other, inside, node, self._now))
        self._now.append(entities.unescape(text) if "&" in text else text)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self._close("p", BLOCK - {"p"})
        for other in LIKE.get(tag, ()):
            self._close(other, LIMIT[tag])
        block = tag in BLOCK
        if block:
            self._now = None
        if tag in VOID:
            if self._now is not None:
                self._now.append(" ")
            return
        named, hidden = [], False
        for name, *values in _NAMED.findall(attrs) if attrs else ():
            value = "".join(values).lower()
            if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
                hidden = True
            elif name.lower() in ("class", "id", "role"):
                named.append(value)
        # A word on the whole page tells what the page has, not what it is.
        words = [] if tag in _WHOLE else [_HAS.sub(" ", n) for n in named]
        other = tag in SILENT or tag in ASIDE or hidden or any(map(OTHER.search, words))
        apart = block or other
        node = Node(tag, "other" if other else "article" if tag in ("article", "main") else "", ".".join([tag, *named]) if apart else "")
        if other:
            self._now = None
        if len(self._open) < _DEPTH and apart:
            next(n for n in reversed(self._open) if n.label or n is self.root).children.append(node)
        self._open.append(node)
        self._count.update((tag, f"#{node.kind}"))

    def _drop(self, first: int, last: int | None = None) -> None:
        """Close the open elements from ``first`` on, or up to ``last``."""
        for node in self._open[first:last]:
            self._count.subtract((node.tag, f"#{node.kind}"))
        del self._open[first:last]

    def _close(self, tag: str, limit) -> None:
        """Close up to the nearest ``tag``, unless an element of ``limit`` is nearer."""
        if not self._count[tag]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                self._drop(i)
                self._now = None
                return
            if self._open[i].tag in limit:
                return

    def _end(self, tag: str) -> None:
        if not self._count[tag]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            node = self._open[i]
            if node.tag == tag:
                if node.label:
                    self._drop(i)
                    self._now = None
                else:
                    self._drop(i, i + 1)  # an inline element ends, its block goes on
                return
            if node.label and tag not in BLOCK:
                return


def skeleton(node: Node) -> list:
    """``[label, checksums of the texts, children]``: what an alignment needs of a tree."""
    return [node.label, [zlib.crc32(t.encode("utf-8", "replace")) for t in node.texts], [skeleton(c) for c in node.children]]


def match(a: list, b: list, path: str, votes: dict[str, list[int]]) -> None:
    """Simple tree matching below two matched nodes: each matched text votes equal or different."""
    for x, y in zip(a[1], b[1], strict=False):
        votes.setdefault(path, [0, 0])[x != y] += 1
    for x, y in _aligned(a[2], b[2]):
        match(x, y, f"{path}/{x[0]}" if path else x[0], votes)


def _weight(node: list) -> int:
    return 1 + sum(map(_weight, node[2]))


def _aligned(xs: list[list], ys: list[list]) -> list[tuple[list, list]]:
    """The order-keeping pairs of children with equal labels of greatest weight.

    Equal labels at both ends are paired at once; only what lies between them
    needs the table.
    """
    lo = 0
    while lo < min(len(xs), len(ys)) and xs[lo][0] == ys[lo][0]:
        lo += 1
    i, j = len(xs), len(ys)
    while i > lo and j > lo and xs[i - 1][0] == ys[j - 1][0]:
        i, j = i - 1, j - 1
    pairs = list(zip(xs[:lo], ys[:lo], strict=True))
    a, b = xs[lo:i], ys[lo:j]
    if a and b:
        wa, wb = list(map(_weight, a)), list(map(_weight, b))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for p in range(len(a) - 1, -1, -1):
            for q in range(len(b) - 1, -1, -1):
                both = best[p + 1][q + 1] + min(wa[p], wb[q]) if a[p][0] == b[q][0] else 0
                best[p][q] = max(best[p + 1][q], best[p][q + 1], both)
        p = q = 0
        while p < len(a) and q < len(b):
            if best[p][q] == best[p + 1][q]:
                p += 1
            elif best[p][q] == best[p][q + 1]:
                q += 1
            else:
                pairs.append((a[p], b[q]))
                p, q = p + 1, q + 1
    return pairs + list(zip(xs[i:], ys[j:], strict=True))


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PAGE = pa.struct([("slots", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("tree", pa.string())])


def parsed(html: Column) -> Column:
    """``struct(slots, texts, tree)``: the blocks that may be main text, and the page's skeleton as JSON."""

    @F.arrow_udf("struct<slots:array<string>,texts:array<string>,tree:string>")
    def each(pages: pa.Array) -> pa.Array:
        out = []
        for html in pages.to_pylist():
            page = Page(html or "")
            main = page.main()
            out.append({"slots": [s for s, _ in main], "texts": [t for _, t in main], "tree": json.dumps(skeleton(page.root), separators=(",", ":"))})
        return pa.array(out, _PAGE)

    return each(html)


_VOTES = "host string, slot string, same bigint, differ bigint"


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of each page against the page of its host before it, summed over a batch. Rows come ordered by host."""
    last_host, last = None, None
    for batch in batches:
        votes: dict[str, dict[str, list[int]]] = {}
        for host, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = json.loads(tree)
            if host == last_host:
                match(page, last, "", votes.setdefault(host, {}))
            last_host, last = host, page
        rows = [(host, slot, *v) for host, slots in votes.items() for slot, v in slots.items()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "slot", "same", "differ"])


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """``(page_id, url, text)`` per row of ``pages``; ``text`` is empty if there is none.

    Blocks are joined in page order by a line feed, white space within a block
    is one space. Elements of every depth and attributes of every length are read;
    only the tree that is aligned ends at depth ``_DEPTH``. NULL html counts as empty; a NULL or unreadable address is no
    host, such pages are not compared. Repeated rows get equal texts. An empty
    table gives an empty result.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), row_uid(F.col(id_col), F.col(url_col), F.col(html_col)).alias("uid"),
        host_of(F.col(url_col)).alias("host"), parsed(F.col(html_col)).alias("p"),
    )
    # Pages are parsed where they are; from here on markup is gone and only skeletons are shuffled.
    seen = stored(rows.select("page_id", "url", "uid", "host", "p.*"), "pages")
    # A host with more than one page in HOT_SHARE is one of at most HOT_SHARE hosts; it is dealt to several groups.
    sizes = stored(seen.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") * HOT_SHARE > F.lit(total)).select("host", F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, total))).cast("int").alias("groups"))
    dealt = seen.where("host <> ''").select("uid", "host", "tree").join(F.broadcast(hot), "host", "left")
    dealt = dealt.withColumn("group", F.when(F.col("groups") > 1, F.pmod("uid", "groups")).otherwise(F.lit(0)).cast("int"))
    together = dealt.repartition("host", "group").sortWithinPartitions("host", "group", "uid").select("host", "tree")
    votes = together.mapInArrow(_vote_rows, _VOTES).groupBy("host", "slot").agg(F.sum("same").alias("same"), F.sum("differ").alias("differ"))
    constant = F.when((F.col("differ") == 0) & (F.col("same") >= MIN_VOTES), F.col("slot"))
    wrappers = votes.groupBy("host").agg(F.collect_set(constant).alias("template"), F.sum("differ").alias("varying"))
    wrappers = stored(wrappers.where((F.col("varying") > 0) & (F.size("template") > 0)).select("host", "template"), "wrappers")
    met = seen.join(wrappers, "host", "left")
    known = F.coalesce("template", F.array().cast("array<string>"))
    blocks = F.filter(F.arrays_zip("slots", "texts"), lambda b: ~F.array_contains(known, b["slots"]))
    text = F.concat_ws("\n", F.transform(blocks, lambda b: b["texts"]))
    return met.select("page_id", "url", text.alias("text"))
