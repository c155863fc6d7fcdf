import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import pages
from cadenza.llm.queries import QUERIES


def longest(a, b):
    """Length of a longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30), st.sampled_from([1, 40, 1 << 20]))
def test_common_subsequence(a, b, kept):
    before, pages.KEPT_BITS = pages.KEPT_BITS, kept         # 1: always by halves
    try:
        at = pages.common(a, b)
    finally:
        pages.KEPT_BITS = before
    assert at == sorted(set(at)) and len(at) == longest(a, b)
    rest = iter(b)
    assert all(any(a[i] == y for y in rest) for i in at)


def test_long_pages():
    a = [i % 1000 for i in range(40000)]
    assert len(pages.common(a, a[::2])) == 20000


@pytest.mark.parametrize("page,want", [
    ("<p>One &amp; two&nbsp;three<br>four</p><p>five", ["One & two three four", "five"]),
    ("<div>a<div>b</div>c</div><ul><li>x<li>y</ul>", ["a", "b", "c", "x", "y"]),
    ("<p><b>bold<br><p>next <i>in</i>line</p>", ["bold", "next inline"]),
    ("x<script>var t='</p>';</script><style>p{}</style><!-- c <p>no</p> -->y", ["xy"]),
    ("a &lt;b&gt; &#233; &#x4e2d; &copy &unknown; 1 < 2", ["a <b> é 中 © &unknown; 1 < 2"]),
    ("<P CLASS=x title='a>b'>T</P><img alt='no'>u", ["T", "u"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<h1>cut off</h1><p>text <a href=\"x", ["cut off", "text"]),
    ("</div></p>stray<div", ["stray"]),
    ("<script>never closed <p>x</p>", []),
    ("", []),
])
def test_lines(page, want):
    assert [t for t, _ in pages.page_lines(page)] == want


@pytest.mark.parametrize("page,want", [
    ("<nav>menu</nav><article><h1>T</h1><p>body</p><footer>by</footer></article><footer>c</footer>", "T\nbody"),
    ("<article><header><h1>T</h1></header><p>x</p></article><header>site</header><p>outside</p>", "T\nx"),
    ("<div class='side-bar ad'>buy</div><p>x</p><div id=comments><p>me too</p></div><form>q</form>", "x"),
    ("<main><p>x</p><section class=comment>me</section></main>", "x"),
    ("<article class='comment'>me</article><p>x</p>", "x"),
    ("<div role=navigation>m</div><div role=main><p>x</p></div>y", "x"),
    ("<p>text <span class=ad>buy</span> more</p>", "text\nmore"),
    ("<article>open<nav>m</nav>rest<p>x", "open\nrest\nx"),
    ("<body class=search><p>x</p></body>", "x"),
    ("<article><p>The ad and the menu are words here.</p></article>", "The ad and the menu are words here."),
])
def test_what_markup_says(page, want):
    assert pages.article(pages.page_lines(page), [0] * 9, []) == want


SITE = "<div><div>Home</div><div>News</div></div><p>Welcome to {}</p>{}<p>All rights reserved</p>"


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_difference_of_pages_without_marks(spark):
    rows = [(i, f"http://a.org/n/{i}", SITE.format("a", f"<p>story {i} begins</p><p>it goes on for {i} lines of its own words</p>"))
            for i in range(5)]
    rows += [(10, "http://b.org/n/1", SITE.format("b", "<p>only page</p>"))]
    got = texts(pages.extract(table(spark, rows)))
    for i in range(5):
        assert got[i] == f"story {i} begins\nit goes on for {i} lines of its own words"
    assert got[10].split("\n") == ["Home", "News", "Welcome to b", "only page", "All rights reserved"]


def test_copies_and_marked_articles_stay(spark):
    story = "".join(f"<p>sentence {i} of the story, which is long enough</p>" for i in range(8))
    rows = [(1, "http://a.org/1", SITE.format("a", story)), (2, "http://a.org/2?x=1", SITE.format("a", story)),
            (3, "http://a.org/2?x=2", SITE.format("a", story)), (4, "http://c.org/1", f"<article>{story}</article><p>x</p>"),
            (5, "http://c.org/2", f"<article><p>new</p>{story[:60]}</article>")]
    got = texts(pages.extract(table(spark, rows)))
    assert all("sentence 7" in got[i] for i in (1, 2, 3, 4))
    assert got[4].startswith("sentence 0") and got[4].count("\n") == 7 and got[5].startswith("new\nsentence 0")


def test_neighbours(spark):
    rows = [("h", p, [i]) for i, p in enumerate(["/a/1", "/a/2", "/b/1", "/b/10"])] + [("h", "/a/2", [0]), ("k", "", [9])]
    df = spark.createDataFrame(rows, "host string, path string, hashes array<long>")
    got = {(r.host, r.path): (r.before, r.after) for r in pages.neighbours(df).collect()}
    assert got == {("h", "/a/1"): (None, [0]), ("h", "/a/2"): ([0], [2]), ("h", "/b/1"): ([0], [3]),
                   ("h", "/b/10"): ([2], None), ("k", ""): (None, None)}


def test_urls(spark):
    df = spark.createDataFrame([("HTTP://User@Www.A.org:80/x/y/?q=1#t",), ("http://a.org/x/index.html",), ("a/b",), (None,),
                                ("https://a.org",)], "url string")
    rows = df.select(pages.url_host(df.url).alias("h"), pages.url_path(df.url).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("www.a.org", "/x/y"), ("a.org", "/x"), ("", "a/b"), ("", ""), ("a.org", "")]


def plain(rows):
    """The operator over lists: sorted paths, the plain table, another parser's
    lines for the given pages."""
    def lines_of(page):
        out = []
        for part, chrome in re.findall(r"(<nav>.*?</nav>|<div class=\"ad\">.*?</div>|<footer>.*?</footer>|<article>.*?</article>)()", page, re.S):
            kind = 2 if part.startswith("<article") else 1
            for block in re.split(r"</?(?:p|li|ul|h1|div|nav|footer|article)\b[^>]*>", part):
                text = " ".join(html.unescape(re.sub(r"<br>", " ", block).replace("<b>", "").replace("</b>", "")
                                              if "<a " not in block else re.sub(r"<[^>]*>", "", block)).split())
                if text:
                    out.append((text, kind))
        return out
    return {i: "\n".join(t for t, k in lines_of(page) if k == 2) for i, _, page in rows}


def test_query(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op11_pages"](spark, sf_small).collect()
    want = plain(rows)
    assert len(got) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.url for r in got} == {i: u for i, u, _ in rows}


def test_query_deletes_what_neighbours_share(spark, sf_small):
    """Every line that the difference deletes is in the neighbour, and the other
    way round: brute force over sorted paths."""
    rows = spark.read.parquet(f"{sf_small}/pages.parquet").collect()
    hosts = {}
    for r in rows:
        m = re.match(r"\w+://([^/]+)([^?#]*)", r.url)
        path = re.sub(r"(\.html)?/*$", "", m[2])
        hosts.setdefault(m[1], {}).setdefault(path, []).append(pages.page_lines(r.html))
    for paths in hosts.values():
        order = sorted(paths)
        for a, b in zip(order, order[1:]):
            x, y = [t for t, _ in paths[a][0]], [t for t, _ in paths[b][0]]
            at = pages.common(x, y)
            assert len(at) == longest(x, y) and all(x[i] in y for i in at)


def test_edges(spark):
    rows = [(1, "http://a.org/1", None), (1, None, "<p>x</p>"), (2, "http://a.org/1", ""), (None, "http://a.org/2", "<p>y"),
            (3, "no url", "<p>z</p>" * 3), (4, "http://a.org/9", "<p>" + "long words " * 60000 + "</p>"),
            (5, "http://a.org/8", "<div>" * 3000 + "deep"), (6, "http://a.org/7", "a\x00b \x85 c<" * 3)]
    df = table(spark, rows).selectExpr("*", "'h' AS host", "'p' AS path", "'t' AS text", "1 AS position", "2 AS hashes", "3 AS before")
    got = pages.extract(df)
    assert got.columns == ["page_id", "url", "html", "host", "path", "position", "hashes", "before", "text", "n_chars"]
    rows = sorted(got.select("page_id", "text").collect(), key=str)
    assert len(rows) == 8
    by = {(r.page_id, r.text[:5]) for r in rows}
    assert {(1, ""), (1, "x"), (2, ""), (None, "y"), (3, "z\nz\nz"), (4, "long "), (5, "deep")} <= by
    assert pages.extract(df.limit(0)).count() == 0


def test_the_difference_tells_marked_elements_apart(spark):
    teaser = "<article class='teaser'><h2>Read this as well</h2><p>every page of the site has it</p></article>"
    quoted, own = "<p>a paragraph that two articles quote</p>", "words of the story number {} " * 9 + "end"
    own = own.replace("{}", "{0}")
    rows = [(i, f"http://a.org/n/{i}", f"<main><h1>News</h1><article><h1>story {i}</h1>{quoted}<p>{own.format(i)}</p></article>"
                                       f"{teaser}</main>") for i in range(4)]
    rows.append((9, "http://b.org/1", f"<article><p>alone</p></article>{teaser}"))
    got = texts(pages.extract(table(spark, rows)))
    for i in range(4):
        assert got[i] == f"story {i}\na paragraph that two articles quote\n{own.format(i)}"
    assert got[9] == "alone\nRead this as well\nevery page of the site has it"      # nothing to compare with


def test_an_article_of_shared_lines_alone_stays():
    lines = pages.page_lines("<article><p>first half of it</p><p>other half of it</p></article><p>menu</p>")
    assert pages.article(lines, [1, 2, 3], [[1], [2]]) == "first half of it\nother half of it"
