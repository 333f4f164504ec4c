"""Page items by balanced tags and the second crawl stage, with results worked by hand."""
from pyspark.sql import functions as F

from lectern.operators import pages as PG
from lectern.operators.markup import elements

NESTED = """<body><!-- <div class="card">no</div> --><div class="card big"><h2>Outer</h2>
<div>plain <div class="card"><h2>Inner</h2><p>in &amp; side</p><img src="/s.png" data-src="/lazy.png"></div> rest</div>
<p class="lead x">after</p><a href="b?x=1&amp;y=2">l</a></div><script>var a = '<div class="card"></div>';</script>
<div class="cards">other</div><div class="card"><h2>Last</h2>"""


def page(spark, html, url="https://s.example.org/a/p"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_nested_containers(spark):
    got = PG.extract_items(page(spark, NESTED), ("div", "card"), {
        "title": ("h2", None, False), "titles": ("h2", None, True), "lead": ("p.lead", None, False), "link": ("a", "href", False), "image": ("img", "src", False)})
    rows = [(r.item_index, r.title, r.titles, r.lead, r.link, r.image) for r in got.orderBy("item_index").collect()]
    assert rows == [
        (0, "Outer", ["Outer", "Inner"], "after", "https://s.example.org/a/b?x=1&y=2", "https://s.example.org/lazy.png"),
        (1, "Inner", ["Inner"], None, None, "https://s.example.org/lazy.png"),
        (2, "Last", ["Last"], None, None, None)]  # what is left open ends with the page
    text = PG.extract_items(page(spark, NESTED), ("div", "big"), {"all": ("div", None, False)}).first()["all"]
    assert text == "plain Inner in & side rest"


def test_next_sibling(spark):
    html = """<table><tr class="head"><td>One</td></tr> text <tr><td><a href="/1">first</a></td></tr>
    <tr class="head"><td>Two</td></tr></table><tr><td><a href="/2">not a sibling</a></td></tr><dt class="head">Three</dt><br>"""
    got = PG.extract_items(page(spark, html), ("", "head"), {"own": ("td", None, False), "link": ("+a", "href", False), "next": ("+ td", None, False)})
    assert [(r.own, r.link, r.next) for r in got.orderBy("item_index").collect()] == [
        ("One", "https://s.example.org/1", "first"), ("Two", None, None), (None, None, None)]


def test_unbalanced_pages(spark):
    assert [(e.name, e.end) for e in elements("<ul><li>a<li>b</ul></p><p>c")] == [("ul", 14), ("li", 9), ("li", 14), ("p", 27)]
    assert [(e.name, e.end) for e in elements("<p><b>one<p>two<table><tr><td><p>in<td>x<tr></table>")] == [
        ("p", 9), ("b", 9), ("p", 15), ("table", 44), ("tr", 40), ("td", 35), ("p", 35), ("td", 40), ("tr", 44)]
    assert [e.name for e in elements("<a title='x>y' b=\"<p>\">t</a><br/><!-- <i> ")] == ["a", "br"]
    rows = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<div class='card'>")], "page_id long, url string, html string")
    assert [(r.page_id, r.t) for r in PG.extract_items(rows, ("div", "card"), {"t": ("p", None, True)}).collect()] == [(3, [])]


def test_details_and_errors(spark):
    lists = page(spark, '<a href="/x">1</a><a href="/x">2</a><a href="/gone">3</a><a href="/bad">4</a><a href="/two">5</a>', "https://s.example.org/l")
    landed = spark.createDataFrame([("https://s.example.org/x", "<article><h1>X</h1></article>"), ("https://s.example.org/x", "<article><h1>X</h1></article>"),
                                    ("https://s.example.org/bad", "<artic"), ("https://s.example.org/two", "<article><h1>A</h1></article><article></article>"),
                                    ("https://s.example.org/unasked", "<article><h1>U</h1></article>")], "url string, html string")
    got = PG.crawl_details(PG.discover_links(lists), landed, ("article", None), {"title": ("h1", None, False)})
    rows = [(r.step_rank, r.detail_url[-4:], r.item_index, r.title, r.error) for r in got.orderBy("step_rank", "item_index").collect()]
    assert rows == [(1, "rg/x", 0, "X", None), (2, "gone", None, None, "not landed"), (3, "/bad", None, None, "no items"),
                    (4, "/two", 0, "A", None), (4, "/two", 1, None, None)]


def test_frontier_templates(spark):
    cfg = spark.createDataFrame([("https://s/{category}?p={page}", "c1"), ("https://s/find/{query}/{page}", None), ("https://s/l", "x")], "tpl string, category string")
    got = [r.page_url for r in PG.page_frontier(cfg, "tpl", 2, "deep learning & é").orderBy("tpl", "page_no").collect()]
    code = "deep%20learning%20%26%20%C3%A9"
    assert sorted(got) == sorted([f"https://s/c1?p={n}&q={code}" for n in (1, 2)] + [f"https://s/find/{code}/{n}" for n in (1, 2)] + [f"https://s/l?q={code}"] * 2)
    assert {r.page_url for r in PG.page_frontier(cfg, "tpl", F.lit(1)).collect()} == {"https://s/c1?p=1", "https://s/find//1", "https://s/l"}
