"""XML items and character references, with results worked by hand."""
from html import unescape

from pyspark.sql import functions as F

from lectern.functions.text import unescape_html
from lectern.sources.configured import SourceConfig
from lectern.sources.xml_items import as_text, at_path, normalize_xml, xml_items


def payloads(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page long, payload string")


def test_items_by_path_and_by_last_component(spark):
    docs = payloads(spark, "<feed><entry>1</entry><x><entry>2</entry></x></feed>",       # the root is no step of the path
                    "<r><feed><entry>3</entry><x><entry>4</entry></x></feed></r>",      # the whole path is there
                    "<a:r xmlns:a='u'><a:entry b='5'/></a:r>", "<r><entry>", "", None, "<r/>")
    got = xml_items(docs, "feed.entry").select("page", F.to_json("item").alias("j")).collect()
    assert [(r.page, r.j) for r in got] == [(0, '"1"'), (0, '"2"'), (1, '"3"'), (2, '{"@b":"5","b":"5"}')]
    assert xml_items(docs, "").count() == 0


def test_paths_on_items(spark):
    item = "<i k='0'><a><n>1</n><n>2</n></a><a><n>3</n></a><a/><one><n x='y'>4</n></one><e></e></i>"
    one = xml_items(payloads(spark, f"<r>{item}</r>"), "i")

    def at(path):
        r = one.select(at_path(F.col("item"), path).alias("p")).select(F.transform("p.found", as_text).alias("f"), "p.several").first()
        return r.f, r.several
    assert at("a.n") == (["1", "2", "3"], True) and at("a.0.n") == (["1", "2"], True) and at("a.1.n") == (["3"], False)
    assert at("a.0.n.1") == (["2"], False) and at("one.n") == (["4"], False) and at("one.n.@x") == (["y"], False) and at("one.n._text") == (["4"], False)
    assert at("k") == (["0"], False) and at("a.9.n")[0] == [] and at("none.n")[0] == [] and at("a.n.q")[0] == []


def test_normalized_rows(spark):
    xml = ("<r><i><t>One &amp;amp; two</t><who><name>A</name></who><who>B</who><who><given>C</given><family>D</family></who><d>2024-02-03x</d></i>"
           "<i><t> </t></i><i><t>Three</t><who><name>alone</name></who><c>a, b</c></i></r>")
    cfg = SourceConfig("s", {"title": "t", "authors": "who", "published_date": "d", "categories": "c"})
    rows = normalize_xml(xml_items(payloads(spark, xml), "i"), cfg).collect()
    assert [(r.title, [a.name for a in r.authors], str(r.published_date), r.categories, r.external_id[:2]) for r in rows] == [
        ("One & two", ["A", "B", "C D"], "2024-02-03", [], "s:"), ("Three", [], "None", ["a", "b"], "s:")]


def test_references_as_python_decodes_them(spark):
    texts = ["plain", "", None, "&", "&&amp;&", "a&b", "&eacute;&Eacute&#xe9;&#233;&#233", "&notit;&notin;&ampamp;&lt&gt;", "&#0;&#x110000;&#xD800;&#128;&#x9f;&#129;",
             "&nosuch;&nosuch &#;&#x;", "&NotEqualTilde;&CounterClockwiseContourIntegral;", "&amp;lt;", "&#x1F600; &hearts;x"]
    got = [r.u for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(unescape_html(F.col("t")).alias("u")).collect()]
    assert got == [None if t is None else unescape(t) for t in texts]
