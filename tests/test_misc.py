"""TF-IDF fit (T27), page consumption (S15), normaliser edge payloads, streaming = batch."""
import math
import os

import pytest
from pyspark.sql import functions as F

from lectern.functions.vectors import Tfidf
from lectern.operators import pages as PG
from lectern.sources import normalizers as N
from lectern.sources import payloads as P

SF = "/root/testdata/sf0.001"


def test_tfidf_by_hand(spark, tmp_path):
    """Three documents; "red fox" and its words are the most frequent terms, "the" is a stop word, "x" is too short."""
    df = spark.createDataFrame([(1, "The red fox. RED fox x"), (2, "red fox"), (3, "blue"), (4, None), (5, "green owls")], "id long, t string")
    Tfidf.fit(df.limit(4), F.col("t"), n=4).save(spark, str(tmp_path / "model"))
    m = Tfidf.load(spark, str(tmp_path / "model"))
    # counts: red 3, fox 3, "red fox" 3, blue 1, "fox red" 1; of 4 documents red, fox and the pair are in 2, blue in 1
    assert m.terms == ["blue", "fox", "red", "red fox"] and m.n == 4
    assert m.idf == [pytest.approx(math.log(5 / d) + 1) for d in (2, 3, 3, 3)]
    got = {r.id: r.v for r in m.vectors(df, F.col("t"), "v").collect()}
    assert got[1] == [0, *[pytest.approx(1 / math.sqrt(3))] * 3] and got[2] == got[1] and got[3] == [1, 0, 0, 0]
    assert got[4] == [0] * 4 and got[5] == [0] * 4
    none = Tfidf.fit(df.limit(0), F.col("t"), n=4)
    assert none.vectors(df, F.col("t"), "v").first().v == [0] * 4


def test_consume_pages_stops_and_caps(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 2, 5), ("s", 3, 0), ("s", 4, 7), ("t", 1, 4), ("t", 2, 4),
                                ("t", 3, 4)], "src string, page int, n int")
    out = PG.consume_pages(df, "src", "page", "n", max_pages=10, max_results=9).orderBy("src", "page").collect()
    assert [(r.src, r.page, r.take) for r in out] == [("s", 1, 5), ("s", 2, 4), ("t", 1, 4), ("t", 2, 4), ("t", 3, 1)]


def test_edge_payloads(spark):
    landed = spark.createDataFrame(
        [("x", 0, None, '{"results": [{"id": "https://openalex.org/W1", "title": "T", '
                        '"abstract_inverted_index": {"a": [0], "c": [2]}, "publication_date": "2024-02-30"}]}'),
         ("x", 1, None, "not json"),
         ("y", 0, None, '{"message": {"items": [{"DOI": "10.1/x", "title": ["A"], "author": [{"given": "Ann"}], '
                        '"published": {"date-parts": [[2020, 5]]}}]}}')],
        "source string, page long, fetched_at timestamp, payload string")
    oa = N.normalize_openalex(P.read_json_payloads(landed.filter("source = 'x'"), P.OPENALEX_SCHEMA, ["results"]))
    r = oa.collect()
    assert len(r) == 1 and r[0].abstract == "a  c" and r[0].published_date is None
    cr = N.normalize_crossref(P.read_json_payloads(landed.filter("source = 'y'"), P.CROSSREF_SCHEMA,
                                                   ["message", "items"])).collect()
    assert cr[0].authors[0].name == "Ann" and str(cr[0].published_date) == "2020-05-01"
    bad_xml = spark.createDataFrame([("z", 0, None, "<feed><entry><id>http://arxiv.org/abs/1</id><title>x</title>"
                                                    "</entry><entry><id>broken</feed>")],
                                    "source string, page long, fetched_at timestamp, payload string")
    ax = N.normalize_arxiv(P.read_xml_payloads(bad_xml, "entry", P.ARXIV_ENTRY_SCHEMA)).collect()
    assert [a.external_id for a in ax] == ["arxiv:1"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stream_library_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    s = sorted(map(tuple, q["stream_library"](spark, SF).collect()))
    b = sorted(map(tuple, q["library_state"](spark, SF).collect()))
    assert s == b
