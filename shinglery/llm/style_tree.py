"""HTML extraction by site style trees: the pages of a host are merged into one tree of elements, the importance of
each node is computed from the entropy of its presentations and contents, and branches of low importance are
removed from every page.

A node is the path of block elements that leads to it (tag, classes and id, digits left out). Its presentations are
the sequences of child tags that pages show there, its contents the texts of the blocks there. Over the m pages
that have it, a presentation or content that k pages share has k of m; the importance of a presentation node is the
entropy of its presentations to the base m, that of contents 1 less the mean of log k / log m, and a branch takes
both: 1 - DECAY^l of the first, l presentations being known, and DECAY^l of the contents of all nodes below. Pages
whose longest block is equal count once, so that copies of a page are no template.

Markup that says what it is goes first: menus, footers, asides, forms, scripts and the like have importance 0, and
where a page marks its article (or else its main part), only that part is left. The tree removes other containers, of
importance below LOW, that SEEN pages have, unless they hold a first-order heading, and only on hosts whose pages
differ (importance of the whole above DIFFER); text blocks themselves are never removed.

Counts are distributed by (host, node, content), so that a host with a third of all pages is spread. Which branches go
is broadcast up to MOST of them, else joined to the pages by host and digest; the result is the same.

Defined cases: null html is empty; a null url, or one without a host, has no style tree; repeated rows get equal
results; texts of unclosed comments and scripts end with the page; other columns are kept, ones named like results go;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import Memory, discard, written

DECAY, LOW, SEEN, DIFFER = 0.9, 0.2, 3, 0.5
#: Nodes deeper than this are one node with the deepest; branches that are broadcast (16 bytes each, and their host).
DEPTH, MOST = 64, 100_000
#: Pages parsed at a time.
ROWS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
NEVER = frozenset("script style noscript template head title iframe noembed noframes xmp svg canvas object audio video map nav footer aside form button select textarea datalist dialog menu search".split())
#: Elements that the tree may remove.
CONTAINERS = frozenset("address center details dir div dl fieldset figure header hgroup ol section table ul".split())
KEPT_ABOVE_TEXT = frozenset("p div address".split())
CELLS, TABLE = frozenset("td th caption table".split()), frozenset("table tbody thead tfoot tr td th caption".split())
#: What a new element closes, and what it looks no further than.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th")}

#: Words of a class, id or role that name what is no article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer sidebar aside complementary"
    " contentinfo cookie cookies consent gdpr notice notices alert comment comments commentlist disqus respond replies newsletter subscribe signup login share sharing social related recommended recommendations"
    " popup modal overlay toolbar widget widgets skip masthead topbar copyright disclaimer search".split()
)
#: Those that an article element itself can bear: then it is none.
NO_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments related recommended notice".split())
HEADERS, OF_ARTICLE = frozenset("header heading head".split()), frozenset("article entry post content story".split())
STATES = frozenset("has no not with without is show hide".split())
ARTICLE = frozenset("articlebody article-body article_body".split())

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"[^\"'>]*+(?:\"[^\"]*+\"[^\"'>]*+|'[^']*+'[^\"'>]*+)*+>")
NAMED = re.compile(r"class|id|role|hidden|display|itemprop", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z_:@][\w:.@-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)"
ROOT = 1


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def named(value: str) -> bool:
    """Whether a class, id or role names what is no article: by its only, first or last word, but not as a state
    (`has-comments`) nor as the head of an article (`entry-header`)."""
    words = [w.lower() for w in WORD.findall(value)]
    if not words or (len(words) > 1 and words[0] in STATES):
        return False
    if words[-1] in HEADERS:
        return not OF_ARTICLE & {*words} and words[0] in ("site", "page", "global", "main", "top")
    return words[0] in NAMES or words[-1] in NAMES


def described(tag: str, attributes: str) -> tuple[str, bool, int]:
    """(the element's name as a node, whether its markup says that it is no article, the region that it opens: 2 for
    an article, 1 for a main part, 0)."""
    found = {}
    if attributes and NAMED.search(attributes):
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    classes = sorted({re.sub(r"[0-9]+", "", x) for x in found.get("class", "").split()})
    role, ident = found.get("role", "").strip().lower(), found.get("id", "")
    name = ".".join([tag, *classes]) + "#" + re.sub(r"[0-9]+", "", ident)
    region = 2 if tag == "article" or role == "article" or unescape(found.get("itemprop", "")).lower() in ARTICLE else 1 if tag == "main" or role == "main" else 0
    marks = [*found.get("class", "").split(), ident, role]
    if tag in ("html", "body"):
        never = False
    elif region:
        never = any(x.lower() in NO_ARTICLE for x in marks)
    else:
        never = tag in NEVER or any(map(named, marks))
    hidden = tag not in ("html", "body") and ("hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None)
    return name, never or hidden, 0 if never or hidden else region


class Names:
    """What is known of start tags, remembered in bounded memory."""

    def __init__(self):
        self.seen = Memory(lambda x: described(*x), 20_000)

    def of(self, tag: str, attributes: str) -> tuple[str, bool, int]:
        if attributes and not NAMED.search(attributes):
            attributes = ""
        if len(attributes) > 256 or len(tag) > 64:
            return described(tag, attributes)
        self.seen = self.seen.aged()
        return self.seen[tag, attributes]


class Page:
    """One pass over a page: its blocks `(text, node, region)` without those of removed branches, the paths and
    presentations of its nodes, and how many branches were removed because of `low`, the nodes of low importance."""

    def __init__(self, html: str, names: Names, low: frozenset[int] | set[int] = frozenset()):
        self.blocks: list[tuple[str, int, int]] = []
        self.paths: dict[int, list[int]] = {ROOT: [ROOT]}
        self.shown: dict[int, list[tuple[str, ...]]] = {}
        self.headed: set[int] = set()
        self.tags: dict[int, str] = {ROOT: ""}
        self.removed = 0
        self.names, self.low = names, low
        # open elements: tag, node, is it dropped, region, tags of its blocks, does it open a scope
        self.stack: list[tuple[str, int, bool, int, list[str], bool]] = [("", ROOT, False, 0, [], False)]
        self.scopes: list[dict[str, int]] = [{}]
        self.pieces: list[str] = []
        self._read(html)
        while len(self.stack) > 1:
            self._pop()
        self._flush()
        self.shown.setdefault(ROOT, []).append(tuple(self.stack[0][4]))

    def _flush(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                top = next(x for x in reversed(self.stack) if x[0] in BLOCK or not x[0])
                self.blocks.append((text, top[1], top[3]))
            self.pieces = []

    def _pop(self) -> None:
        tag, node, dropped, _, inner, scope = self.stack[-1]
        if tag in BLOCK:
            self._flush()
        if scope:
            self.scopes.pop()
        self.stack.pop()
        self.scopes[-1][tag] -= 1
        if tag in BLOCK and not dropped:
            self.shown.setdefault(node, []).append(tuple(inner))

    def _close(self, tag: str) -> None:
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK
        if not block and not self.scopes[-1].get(tag) and tag not in NEVER and not NAMED.search(attributes):
            return  # an element inside a line, of which nothing is known
        name, never, region = self.names.of(tag, attributes)
        if block:
            self._imply(tag)
            self._flush()
        elif not never and not region and not self.scopes[-1].get(tag):
            return
        _, parent, dropped, above, inner, _ = self.stack[-1]
        region = max(region, above)
        if tag == "header" and not above and not dropped:
            never = True
        node = parent
        if block and not dropped and not never:
            inner.append(tag)
            path = self.paths[parent]
            node = hashed(f"{parent}/{name}") if len(path) < DEPTH else parent
            if node in self.low:
                self.removed += 1
                never = True
            elif node not in self.paths:
                self.paths[node] = [*path, node]
                self.tags[node] = tag
            if tag == "h1" and not never:
                self.headed.add(node)
        self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        self.stack.append((tag, node, dropped or never, region, [], tag in CELLS))
        if tag in CELLS:
            self.scopes.append({})

    def _imply(self, tag: str) -> None:
        """Ends the elements that a block element ends by its start."""
        while self.stack[-1][0] and self.stack[-1][0] not in BLOCK and not (self.stack[-1][2] and self.stack[-1][0] in NEVER):
            self._pop()
        if self.stack[-1][0] in ("p", "head") and tag != "head":
            self._pop()
        if not (ends := CLOSES.get(tag)):
            return
        open_ = self.scopes[-1]
        if tag not in TABLE:
            if any(open_.get(x) for x in ends):
                at = len(self.stack) - 1
                while self.stack[at][0] in KEPT_ABOVE_TEXT or (self.stack[at][0] and self.stack[at][0] not in BLOCK):
                    at -= 1
                if self.stack[at][0] in ends:
                    while len(self.stack) > at:
                        self._pop()
            return
        while len(self.stack) > 1 and self.stack[-1][0] != "table" and (self.stack[-1][0] in ends or self.stack[-1][0] not in TABLE) and any(s.get(x) for s in self.scopes[-2:] for x in ends):
            self._pop()

    def _end(self, tag: str) -> None:
        if self.scopes[-1].get(tag) or (tag in TABLE and any(s.get(tag) for s in self.scopes)):
            self._close(tag)
        elif tag in BLOCK:
            self._flush()

    def _read(self, html: str) -> None:
        at, last = 0, html.rfind(">") + 1
        while True:
            lt = html.find("<", at)
            if lt != at and not self.stack[-1][2]:
                text = html[at:lt] if lt >= 0 else html[at:]
                self.pieces.append(unescape(text) if "&" in text else text)
            if lt < 0:
                return
            m = OPEN.match(html, lt)
            if not m:
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 4)
                    if end < 0:
                        return
                    at = end + 3
                elif html[lt + 1 : lt + 2] in ("!", "?", "/") and lt < last:
                    at = html.find(">", lt) + 1
                else:
                    if not self.stack[-1][2]:
                        self.pieces.append("<")
                    at = lt + 1
                continue
            slash, tag = m.groups()
            end = m.end()
            if end >= last:
                return  # the page ends inside a tag
            if html[end] == ">":
                at = end + 1
            else:
                rest = REST.match(html, end, last)
                at = rest.end() if rest else html.find(">", end) + 1
            tag = tag.lower()
            if slash:
                self._end(tag)
                continue
            attributes = html[end : at - 1]
            if tag == "br":
                if not self.stack[-1][2]:
                    self.pieces.append(" ")
            elif tag in RAW:
                over = RAW_END[tag].search(html, at)
                if not over:
                    return
                at = html.find(">", over.end()) + 1 or len(html)
            elif tag == "hr":
                self._imply(tag)
                self._flush()
            elif tag not in VOID:
                self._start(tag, attributes)

    def text(self) -> str:
        best = max((r for _, _, r in self.blocks), default=0)
        return "\n".join([t for t, _, r in self.blocks if r == best])


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


#: Kinds of rows of a page: a presentation of a node, a content of it.
SHOWN, CONTENT = 1, 0
ITEMS = "host string, node long, kind int, item long, page long, path array<long>, tag string, headed boolean"


def items(pages: DataFrame, html: str = "html") -> DataFrame:
    """The presentations and contents of the nodes of each page, from `(host, html)`; narrow. `page` is the
    digest of the page's longest block."""
    names = [x.split()[0] for x in ITEMS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.bool_()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names()
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                out: list[tuple] = []
                for site, text in zip(b.column(0).slice(lo, ROWS).to_pylist(), b.column(1).slice(lo, ROWS).to_pylist(), strict=True):
                    page = Page(text or "", known)
                    if not page.blocks:
                        continue
                    own = hashed(max((t for t, _, _ in page.blocks), key=len))
                    for node, seen in page.shown.items():
                        shown = hashed("|".join(sorted(",".join(x) for x in seen)))
                        out.append((site, node, SHOWN, shown, own, page.paths[node], page.tags[node], node in page.headed))
                    out += [(site, node, CONTENT, item, own, None, None, None) for node, item in {(n, hashed(t)) for t, n, _ in page.blocks}]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return pages.select("host", html).where("host <> ''").mapInArrow(listed, ITEMS)


def importance(found: DataFrame) -> DataFrame:
    """`(host, node, pages, importance, whole, tag, headed)` from `items`: a row for each node of each host's style tree;
    `whole` is the importance of the contents of the host, and a node is headed if a first-order heading is below."""
    rest = [F.first(c, ignorenulls=True).alias(c) for c in ("path", "tag", "headed")]
    once = found.groupBy("host", "node", "kind", "item", "page").agg(*rest)
    items_ = once.groupBy("host", "node", "kind", "item").agg(F.count("*").alias("k"), *rest)
    log, shown, content = F.log(F.col("k").cast("double")), F.col("kind") == SHOWN, F.col("kind") == CONTENT
    sums = {
        "pages": F.sum(F.when(shown, F.col("k"))), "styles": F.count(F.when(shown, 1)), "spread": F.sum(F.when(shown, F.col("k") * log)),
        "contents": F.count(F.when(content, 1)), "shared": F.sum(F.when(content, log)),
    }
    nodes = items_.groupBy("host", "node").agg(*[v.alias(c) for c, v in sums.items()], *rest)
    size = F.log(F.col("pages").cast("double"))
    several = F.col("pages") > 1
    entropy = F.when(several, (size - F.col("spread") / F.col("pages")) / size).otherwise(1.0)
    shared = F.when(several, F.coalesce(F.col("shared"), F.lit(0.0)) / size).otherwise(0.0)
    own = written(nodes.where("path IS NOT NULL").select("host", "node", "pages", "styles", entropy.alias("entropy"), "contents", shared.alias("shared"), "path", "tag", "headed"), "nodes")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    below = own.select("host", F.explode("path").alias("node"), none("pages", "long"), none("styles", "long"), none("entropy", "double"), "contents", "shared", none("tag", "string"), "headed")
    here = own.select("host", "node", "pages", "styles", "entropy", F.lit(0).cast("long").alias("contents"), F.lit(0.0).alias("shared"), "tag", "headed")
    tree = here.unionByName(below).groupBy("host", "node").agg(
        *[F.max(c).alias(c) for c in ("pages", "styles", "entropy", "tag", "headed")], F.sum("contents").alias("contents"), F.sum("shared").alias("shared")
    )
    contents = F.when(F.col("contents") > 0, 1 - F.col("shared") / F.col("contents")).otherwise(1.0)
    weight = F.pow(F.lit(DECAY), F.col("styles"))
    tree = written(tree.withColumn("content", contents).withColumn("importance", (1 - weight) * F.col("entropy") + weight * F.col("content")), "tree")
    whole = tree.where(F.col("node") == ROOT).select(F.col("host").alias("root_host"), F.col("content").alias("whole"))
    discard(own)
    return tree.join(whole.hint("shuffle_hash"), F.col("host") == F.col("root_host")).select("host", "node", "pages", "importance", "whole", "tag", "headed")


def low_branches(tree: DataFrame) -> DataFrame:
    """`(host, node)` of the branches that go."""
    return tree.where((F.col("importance") < LOW) & (F.col("pages") >= SEEN) & (F.col("whole") > DIFFER) & F.col("tag").isin(*sorted(CONTAINERS)) & ~F.col("headed")).select("host", "node")


RESULT = {"text": "string", "n_chars": "bigint", "n_removed": "bigint"}


def texts(pages: DataFrame, low: dict[str, set[int]] | None, html: str = "html") -> DataFrame:
    """Replaces the html by `text`, `n_chars` and `n_removed`. The branches that go come from `low` by host, or else from
    the pages' own column `low`."""
    kept = [c for c in pages.columns if c not in (html, "host", "low", *RESULT)]
    kinds = dict(pages.dtypes)
    shared = pages.sparkSession.sparkContext.broadcast(low) if low is not None else None
    source = pages.select(*[F.col(f"`{c}`") for c in kept], html, "host", *(["low"] if low is None else []))
    n = len(kept)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names()
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                sites = part.column(n + 1).to_pylist()
                gone = [set(x or ()) for x in part.column(n + 2).to_pylist()] if shared is None else [shared.value.get(x, frozenset()) for x in sites]
                found = [Page(x or "", known, g) for x, g in zip(part.column(n).to_pylist(), gone, strict=True)]
                made = [p.text() for p in found]
                cols = [pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64()), pa.array([p.removed for p in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], [*kept, *RESULT])

    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} {t}" for c, t in RESULT.items())])
    return source.mapInArrow(read, ddl)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The columns of the pages without the html, with the main text of each, its code points, and how many branches its
    host's style tree removed from it."""
    own = pages.withColumn("host", host(F.col(url)))
    gone = written(low_branches(importance(items(own, html))), "low")
    if gone.count() <= MOST:
        by: dict[str, set[int]] = {}
        for r in gone.collect():
            by.setdefault(r["host"], set()).add(r["node"])
        return texts(own, by, html)
    digest = F.unhex(F.md5(F.coalesce(F.col(html), F.lit(""))))
    sent = own.select("host", html).withColumn("digest", digest).where("host <> ''")

    def noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names()
        for b in batches:
            for i in range(b.num_rows):
                nodes = [*Page(b.column(1)[i].as_py() or "", known).paths]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(c)[i].as_py()] * len(nodes), t) for c, t in ((0, pa.string()), (2, pa.binary()))] + [pa.array(nodes, pa.int64())], ["host", "digest", "node"])

    at = sent.mapInArrow(noded, "host string, digest binary, node long").distinct()
    met = at.join(gone.select(F.col("host").alias("low_host"), F.col("node").alias("low_node")).hint("shuffle_hash"), (F.col("host") == F.col("low_host")) & (F.col("node") == F.col("low_node")))
    of_page = written(met.groupBy(F.col("host").alias("of_host"), F.col("digest").alias("of_digest")).agg(F.collect_set("node").alias("low")), "low-of-pages")
    joined = own.join(of_page.hint("shuffle_hash"), (F.col("host") == F.col("of_host")) & (digest == F.col("of_digest")), "left").drop("of_host", "of_digest")
    return texts(joined, None, html)
