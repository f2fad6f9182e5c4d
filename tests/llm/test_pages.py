"""Site style trees against a plain tree of parsed pages, and the parser on pages of every kind."""

import math
import random
import re
from collections import Counter, defaultdict
from html import escape
from html.parser import HTMLParser

import pytest

from shinglery.llm import registry, style_tree

SF = "/root/testdata/sf0.001"
NAMES = style_tree.Names()


def text_of(html):
    return style_tree.Page(html, NAMES).text()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("just text", "just text"), ("a &lt;b&gt; &amp c&nbsp;d &eacute", "a <b> & c d é"), ("5 < 6 <3 > 2", "5 < 6 <3 > 2"),
        ("<p>one <b>two</b>three<br>four<p>five\n six", "one twothree four\nfive six"), ("<ul><li>x<li>y</ul>z", "x\ny\nz"),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", "1\n2\n3\n4"), ("<p>a<!-- <p>b --> c</p>", "a c"), ("<p>a<!-- b", "a"), ("<p>a<script>b", "a"),
        ("<script>var t='</p>';</script><style>p{}</style><p>a", "a"), ("<head><title>t</title><p>a", "a"), ("<title>t&am</title>a", "a"),
        ("<div title='a>b'>c</div>", "c"), ("<p>a</p", "a"), ("<p>a<a href='x", "a"), ("<textarea>x</textarea>y", "y"), ("<p>a<input value=b>c", "ac"),
        ("<nav>n</nav><header>h</header><p>a</p><aside>s</aside><footer>f</footer><form>q<p>r</form>", "a"),
        ("<p>o</p><article><header><h1>T</h1></header><p>a</p><div class='share-buttons'>s</div><footer>f</footer></article><p>o</p>", "T\na"),
        ("<main><h1>T</h1><p>a</p></main><p>o</p>", "T\na"), ("<main>m<article>a</article></main>o", "a"), ("<article class='comment'>c</article><p>a</p>", "a"),
        ("<article>a<section id='comments'><article>c</article></section></article>", "a"), ("<div class='ad'>x<div>y</div></div>z", "z"), ("<div class='add-on'>x</div>", "x"),
        ("<body class='has-sidebar nav'><div class='has-comments'>a</div></body>", "a"), ("<div class='entry-header'>T</div><div class='site-header'>S</div>", "T"),
        ("<p>a<span class='sponsored'>b<span>c</span>d</span>e", "ae"), ("<div role='navigation'>x</div>a<div hidden>y</div><p style='display: none'>z</p>", "a"), ("<div class='cookieNotice'>x</div>a", "a"),
        ("</p></div>a</article>", "a"), ("<div><article>a</div>b</article>", "a"), ("<td>a</td></table>b", "a\nb"), ("<![CDATA[x]]>a<?php y ?>b", "ab"),
    ],
)
def test_texts(html, text):
    assert text_of(html) == text


def test_long_and_nested_pages():
    for html in ("<div>" * 50_000 + "x" + "</p>" * 50_000, "<" * 200_000, "<a '" * 50_000 + ">", "<!--" * 50_000, "<li><div>" * 20_000, "<table><td>" * 10_000 + "</div>" * 20_000, "<span class=ad>" * 20_000 + "<p>" * 9_000, "&amp" * 200_000):
        text_of(html)
    assert text_of("<article>" + "<p>wort wort</p>" * 100_000 + "</article>").count("\n") == 99_999


def test_pages_of_the_table(spark):
    """Every page of the table marks its article, which holds a heading, paragraphs, bold type and line breaks only."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " "))
        want[r.page_id] = "\n".join(t for x in re.split(r"</?(?:p|h1)>", inner) if (t := " ".join(style_tree.unescape(x).split())))
    got = {r.page_id: r for r in registry.op11_style_tree(spark, SF).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


class Tree(HTMLParser):
    """The elements of a page that closes all of them: [name, tag, children and texts]."""

    def __init__(self, html):
        super().__init__()
        self.top = ["", "", []]
        self.open = [self.top]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        one = [".".join([tag, *sorted(re.sub(r"[0-9]+", "", x) for x in a.get("class", "").split())]) + "#" + re.sub(r"[0-9]+", "", a.get("id", "")), tag, []]
        self.open[-1][2].append(one)
        self.open.append(one)

    def handle_endtag(self, tag):
        assert self.open.pop()[1] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def nodes_of(tree):
    """(path, child tags, texts) of every element."""
    out = []

    def walk(e, path):
        out.append((path, tuple(c[1] for c in e[2] if isinstance(c, list)), [" ".join(c.split()) for c in e[2] if isinstance(c, str) and c.strip()]))
        for c in e[2]:
            if isinstance(c, list):
                walk(c, (*path, c[0]))

    walk(tree.top, ())
    return out


def expected(pages):
    """The texts of pages without marked parts by recomputing every node's importance."""
    hosts = defaultdict(list)
    for k, (url, html) in pages.items():
        hosts[re.sub(r".*?//|/.*", "", url).lower()].append((k, nodes_of(Tree(html))))
    out = {}
    for own in hosts.values():
        styles, contents, headed = defaultdict(set), defaultdict(set), set()
        for _, nodes in own:
            longest = max((t for _, _, ts in nodes for t in ts), key=len)
            shown = defaultdict(list)
            for path, tags, texts in nodes:
                shown[path].append(",".join(tags))
                for t in texts:
                    contents[path, t].add(longest)
                if path and path[-1].startswith("h1"):
                    headed |= {path[:i] for i in range(len(path) + 1)}
            for path, x in shown.items():
                styles[path, "|".join(sorted(x))].add(longest)
        m = Counter()
        for (path, _), who in styles.items():
            m[path] += len(who)
        share = lambda k, n: math.log(k) / math.log(n) if n > 1 else 0.0

        def content(at, contents=contents, m=m, share=share):
            below = [share(len(who), m[path]) for (path, _), who in contents.items() if path[: len(at)] == at]
            return 1 - sum(below) / len(below) if below else 1.0

        def importance(at, styles=styles, m=m, content=content):
            mine = [len(who) for (path, _), who in styles.items() if path == at]
            spread = -sum(k / m[at] * math.log(k / m[at]) for k in mine) / math.log(m[at]) if m[at] > 1 else 1.0
            return (1 - 0.9 ** len(mine)) * spread + 0.9 ** len(mine) * content(at)

        low = {p for p in m if p and p[-1].split(".")[0].split("#")[0] in style_tree.CONTAINERS and m[p] >= 3 and p not in headed and content(()) > 0.5 and importance(p) < 0.2}
        for k, nodes in own:
            out[k] = "\n".join(t for path, _, ts in nodes for t in ts if not any(path[:i] in low for i in range(len(path) + 1)))
    return out


def site(rng, host, n, near=False):
    """Pages with a menu, a box and a foot that nothing marks; `near`: copies of one page with a changed word."""
    words = lambda k: " ".join("".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(k))
    menu = "<div class='x9 m'><ul>" + "".join(f"<li>{words(2)}</li>" for _ in range(5)) + "</ul></div>"
    box, same = f"<section class='b7'><h3>{words(3)}</h3><p>{words(9)}</p></section>", [words(12) for _ in range(8)]
    out = []
    for i in range(n):
        body = [f"{same[0]} {i}", *same[1:]] if near else [words(rng.randint(3, 30)) for _ in range(rng.randint(1, 9))]
        title = "one title" if near else words(4)
        text = "".join(f"<p>{escape(t)}</p>" for t in body)
        out.append((f"http://{host}/{i}", f"<html><body>{menu}<div class='c{i}'><div><h1>{title}</h1></div><div id='t{i}'>{text}</div></div>{box}<div><p>{words(2)} {i}</p><p>all of us</p></div></body></html>"))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_style_trees(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(style_tree, "MOST", -1)
    rng = random.Random(3)
    pages = dict(enumerate([*site(rng, "A.example.org", 12), *site(rng, "b.example.org", 6, near=True), *site(rng, "c.example.org", 1), *site(rng, "d.example.org", 2), *site(rng, "e.example.org", 40)]))
    pages |= {100 + i: p for i, p in enumerate(site(random.Random(3), "a.example.org", 3))}  # copies of pages of A
    df = spark.createDataFrame([(k, u, h, "x") for k, (u, h) in pages.items()], "page_id long, url string, html string, n_chars string").repartition(5)
    got = {r.page_id: r for r in style_tree.extract(df).collect()}
    want = expected(pages)
    assert {k: r.text for k, r in got.items()} == want
    assert all(got[k].n_removed == 2 for k in (0, 5, 100, 30)) and all(got[k].n_removed == 0 for k in (13, 18, 19, 20))
    assert got[0].text.count("all of us") == 1


def test_odd_pages(spark, tmp_path):
    rows = [(1, None, "<p>a"), (None, "no url", None), (2, "http://h/", ""), (2, "http://h/", ""), (3, "//h", "<article></article>"), (4, "ftp://u:p@H.x:80/q?x#y", "<p>é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted([(r.page_id, r.url, r.text, r.n_chars) for r in registry.op11_style_tree(spark, str(tmp_path)).collect()], key=repr)
    assert got == sorted([(1, None, "a", 1), (None, "no url", "", 0), (2, "http://h/", "", 0), (2, "http://h/", "", 0), (3, "//h", "", 0), (4, "ftp://u:p@H.x:80/q?x#y", "é", 1)], key=repr)
    hosts = {r.url: r.h for r in df.select("url", style_tree.host(df.url).alias("h")).collect()}
    assert hosts == {None: "", "no url": "", "http://h/": "h", "//h": "h", "ftp://u:p@H.x:80/q?x#y": "h.x"}
