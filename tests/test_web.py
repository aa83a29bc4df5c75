"""Pages to blocks against a parser with a stack, and rules of hosts."""
import html
import json
import re
from html.parser import HTMLParser

import pytest

from lectern.sources import web as W

PAGE_HTML = """<html><head><title>T</title></head><body>bare text<nav><p>menu</p></nav><div>inline <em>words</em><p>One<a class="x noteref" href="#n">1</a> &eacute;&#8217;&#x201c;&amp;&nope;</p>
<table><tr><th>Name</th><th>Age</th></tr><tr><td>Ana</td><td>30</td></tr><tr><td></td><td></td></tr></table><aside epub:type="footnote"><p>a note</p></aside><table><tr><td>1</td><td>2</td></tr></table>
<ul><li>item<br/>two</li></ul><p role="doc-endnote">gone</p><script>var x = "</p><p>";</script>tail</div></body></html>"""
NESTED = [
    ("<body><aside epub:type='footnote'>a<aside>inner</aside>rest of the note</aside><p>kept</p></body>", ["kept"]),
    ("<p title='x>y'>quoted</p><p data-a=\"<b>'\" title='\">'>both</p>", ["quoted", "both"]),
    ("<table><tr><td>a</td><td>b<table><tr><td>in1</td><td>in2</td></tr></table></td></tr><tr><td>c</td><td>d</td></tr></table>", ["a: in1. bin1in2: in2.", "a: c. bin1in2: d."]),
    ("<ul><li>one<ul><li>one a</li><li>one b</li></ul></li><li>two<p>par</p></li></ul>", ["oneone aone b", "twopar"]),
    ("<div>x<div>y<p>z</p>w</div>v</div>u", ["x", "y", "z", "w", "v", "u"]),
    ("<p>open<p>next<div>in a div</div><li>item<li>another", ["open", "next", "in a div", "item", "another"]),
    ("<div>press <button>no</button>here</div><p>press <button>yes</button></p>", ["press here", "press yes"]),
    ("</p></div><p>after stray ends</p></table>", ["after stray ends"]),
    ("a < b<!-- <p>no</p> --><p>c &lt; d</p>1 < 2", ["a < b", "c < d", "1 < 2"]),
    ("<li>text<table><tr><td>1</td><td>2</td></tr></table></li><table><tr><td>k<td>v<tr><td>x<td>y</table>", ["text12", "k: x. v: y."]),
    ("<svg><text>drawn</text></svg><section>s<nav><ul><li>n</li></ul></nav>t</section>", ["st"])]


@pytest.fixture(scope="module")
def framed(spark):
    return lambda pages: spark.createDataFrame(pages, "page_id long, html string")


def texts(df):
    out = {}
    for r in df.orderBy("page_id", "n").collect():
        out.setdefault(r.page_id, []).append(r.text)
        assert r.n == len(out[r.page_id]) - 1
    return out


def test_html_blocks(framed):
    got = texts(W.html_blocks(framed([(1, PAGE_HTML), (2, None), (3, "")])))
    assert got == {1: ["bare text", "inline words", "One é’“&&nope;", "Name: Ana. Age: 30.", "1, 2.", "item two", "tail"]}


def test_nested_blocks(framed):
    got = texts(W.html_blocks(framed([(i, h) for i, (h, _) in enumerate(NESTED)])))
    assert got == {i: want for i, (_, want) in enumerate(NESTED)}


def test_repeated_pages_stay_apart(framed):
    rows = [(1, "<p>a<p>b"), (1, "<p>a<p>b"), (None, "<p>c")]
    assert sorted((r.page_id or 0, r.n, r.text) for r in W.html_blocks(framed(rows)).collect()) == [(0, 0, "c"), (1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]


class Stack(HTMLParser):
    """Elements on a stack; a paragraph is closed by the next block, other elements by their end or that of an outer one."""

    def __init__(self, leaves, holders, skipped, dropped):
        super().__init__(convert_charrefs=True)
        self.leaves, self.holders, self.skipped, self.dropped = leaves, holders, skipped, dropped
        self.stack, self.out, self.now = [], [], []

    def flush(self):
        text = re.sub(" +", " ", re.sub(r"[ \t\r\n\u00a0\u2002\u2003\u2009\u202f]", " ", "".join(self.now))).strip()
        self.now = []
        if text:
            self.out.append(text)

    def inside(self, names):
        return any(t in names for t in self.stack)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        if tag in ("br", "meta", "link", "img", "hr"):
            return
        block = tag in self.leaves or tag in self.holders
        if block and self.stack and "p" in self.stack and not self.inside(self.dropped):
            while self.stack.pop() != "p":
                pass
            self.flush()
        if block and not self.inside(self.leaves) and not self.inside(self.dropped):
            self.flush()
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
            if (tag in self.leaves or tag in self.holders) and not self.inside(self.leaves):
                self.flush()

    def handle_data(self, data):
        if not self.inside(self.dropped) and (self.inside(self.leaves) or not self.inside(self.skipped)):
            self.now.append(data)


def test_blocks_of_all_pages(spark, sf):
    """Both queries over the whole table against the stack."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    leaves, holders, skipped = (set(x.split("|")) for x in (W.LEAVES, W.HOLDERS, W.SKIPPED))
    books, articles = {}, {}
    for r in pages.collect():
        p = Stack(leaves, holders, skipped, {"script", "style", "nav"})
        p.feed(r.html)
        p.flush()
        books[r.page_id] = p.out
        q = Stack({"h1", "h2", "h3", "p", "li"}, {"ul", "ol", "div", "section", "article", "main", "body", "html", "table"}, {"head"}, {"script", "style", "nav", "header", "footer", "aside"})
        inner = re.search(r"(?is)<(article|main)\b[^>]*>(.*)</\1>", r.html)
        q.feed(inner[2] if inner else r.html)
        q.flush()
        articles[r.page_id] = q.out
    assert texts(W.html_blocks(pages)) == {i: x for i, x in books.items() if x}
    got = {r.page_id: r.paragraphs for r in W.extract_articles(pages).collect()}
    assert got.keys() == articles.keys()
    assert {i: x or [] for i, x in got.items()} == articles


def test_articles(spark):
    rows = [
        (1, "http://a/1", "<title>t</title><nav><li>menu</li></nav><article><h1>Head &amp; more</h1><p>one<p>two <b>bold</b><ul><li>x<p>in x</p></li></ul></article><p>outside</p>"),
        (2, "http://a/2", "<title>only title</title><header><p>no</p></header><p title='a>b'>yes</p><aside><aside><p>n</p></aside><p>m</p></aside><h2>sub"),
        (3, "http://a/3", ""), (4, "http://a/4", None)]
    got = {r.page_id: (r.title, r.paragraphs) for r in W.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("Head & more", ["Head & more", "one", "two bold", "xin x", "in x"])
    assert got[2] == ("only title", ["yes", "sub"]) and got[3] == ("http://a/3", None) and got[4][1] is None


def test_robots(spark):
    urls = spark.createDataFrame([(1, "http://A.b/x/y"), (2, "http://a.b"), (3, "https://a.b/x"), (4, "http://down/x"), (5, "http://none/x"), (6, "http://gone/x"), (7, "http://a.b/x/yes")], "page_id long, url string")
    rules = spark.createDataFrame([("a.b", 2, "/x", False), ("a.b", 1, "/x/y", True), ("a.b", 3, "/", True), ("gone", 1, "/", False), ("a.b", 0, "/x/yes", False)], "host string, seq int, prefix string, allow boolean")
    answers = spark.createDataFrame([("a.b", 200), ("down", 503), ("gone", 404)], "host string, status int")
    allowed = W.robots_filter(urls, rules, answers)
    assert {r.page_id for r in allowed.collect()} == {1, 2, 6}
    plan = allowed._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan and "Cartesian" not in plan


def test_entities(spark):
    from lectern.functions.markup import decode_entities
    from pyspark.sql import functions as F

    samples = ["&eacute;&amp;&lt;", "&#8217;x&#x201C;", "no & reference", "&unknown; &#0;"]
    got = [r.t for r in spark.createDataFrame([(s,) for s in samples], "s string").select(decode_entities(F.col("s")).alias("t")).collect()]
    assert got == [html.unescape(s) for s in samples]


def test_read_text_corpus(spark, tmp_path):
    (tmp_path / "One book+1.txt").write_bytes(b"first\nline \xff")
    (tmp_path / "two.md").write_text("# Second", "utf-8")
    (tmp_path / "three.pdf").write_text("no", "utf-8")
    got = {(r.title, r.kind, r.text) for r in W.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {("One book+1", "file", "first\nline \ufffd"), ("two", "file", "# Second")}


def test_books_larger_than_a_task(spark, tmp_path):
    """A book that many tasks write comes back whole and in order; odd names too."""
    from lectern.sources import sinks as K

    rows = [("big: one/two +%", k, f"paragraph {k}\u2028 \"q\"") for k in range(500)] + [("small", 7, "only"), ("small", 9, "⟦image:x.png⟧")]
    paras = spark.createDataFrame(rows, "book_id string, para long, text string").repartition(7)
    ignored = spark.createDataFrame([("big: one/two +%", 3)], "book_id string, para long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # rows this few would be one task's
    try:
        K.write_texts(paras, ignored, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t").glob("book_id=big*/part-*"))) > 1
    got = {r.title: r.text for r in W.read_text_corpus(spark, f"{tmp_path}/t", folder="book_id").collect()}
    assert got == {"big: one/two +%": "\n\n".join(t for _, k, t in rows[:500] if k != 3) + "\n", "small": "only\n"}
    none = paras.select("book_id", "para").limit(0)
    sections = spark.createDataFrame([("small", 0, 8, "a"), ("small", 8, 10, "b"), ("big: one/two +%", 0, 500, "c")], "book_id string, start long, end long, title string")
    K.write_json(paras, ignored, none, paras.where("para = 7").select("book_id", "para"), sections, f"{tmp_path}/j")
    got = {r.title: json.loads(r.text) for r in W.read_text_corpus(spark, f"{tmp_path}/j", folder="book_id").collect()}
    big = got["big: one/two +%"]
    assert big["title"] == "big: one/two +%" and len(big["paragraphs"]) == 499 and "sections" not in big and big["paragraphs"][2]["text"] == rows[2][2]
    assert got["small"] == {"title": "small", "paragraphs": [{"index": 7, "text": "only", "bookmarked": False, "highlighted": True}],
                            "sections": [{"title": "a", "start": 0, "end": 8}, {"title": "b", "start": 8, "end": 10}]}


def test_parts_follow_the_pages(spark):
    """A task's share of the pages is bounded by bytes: 12 MiB are dealt into more parts than the session has."""
    import re

    from lectern.functions import markup as M

    pages = spark.range(12).selectExpr("id as page_id", "repeat('<p>x</p>', 131072) as html")
    plan = M.stream(pages, "page_id", "html")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(_row#\d+L?, (\d+)\)", plan) == ["6"]
