"""Column functions against Python's own rules (urljoin, strip, md5, ...)."""
import datetime as dt
import hashlib
from urllib.parse import urljoin

from pyspark.sql import functions as F

import numpy as np
import pytest

from lectern.functions import text as X
from lectern.functions import urls as U
from lectern.functions.display import match_score, rate_band
from lectern.functions.vectors import hash_embedding
from lectern.operators import search as S
from lectern.sources.normalizers import ensure_list, from_inverted_index


def test_absolute_url_matches_urljoin(spark):
    bases = ["https://ex.org/a/b/page.html?x=1#f", "http://ex.org", "https://ex.org/dir/"]
    urls = ["/root", "//cdn.net/x.png", "rel/p", "./here", "../up", "?q=2", "#top", "https://abs.org/z", "mailto:a@b"]
    rows = [(b, u) for b in bases for u in urls]
    got = spark.createDataFrame(rows, "b string, u string").select(U.absolute_url(F.col("b"), F.col("u")).alias("r")).collect()
    for (b, u), r in zip(rows, got):
        assert r.r == urljoin(b, u), (b, u, r.r, urljoin(b, u))


def test_record_id_and_article_url(spark):
    df = spark.createDataFrame([("web", "site", "https://x.org/1", None, "10.1/a", "e1"),
                                ("web", "s", "u", "", "", "http://id.org/7"),
                                ("web", "s", "u", "https://given", "10.1/b", "e")],
                               "t string, n string, u string, url string, doi string, ext string")
    r = df.select(U.record_id(F.col("t"), F.col("n"), F.col("u")).alias("id"),
                  U.article_url(F.col("url"), F.col("doi"), F.col("ext")).alias("au")).collect()
    assert r[0].id == "web:" + hashlib.md5(b"site:https://x.org/1").hexdigest()[:16]
    assert [x.au for x in r] == ["https://doi.org/10.1/a", "http://id.org/7", "https://given"]


def test_strip_and_small_rules(spark):
    vals = ["　 x y \x1c\n", "plain", "  "]
    r = spark.createDataFrame([(v,) for v in vals], "v string").select(X.strip_ws(F.col("v")).alias("s")).collect()
    assert [x.s for x in r] == [v.strip() for v in vals]
    r = spark.createDataFrame([("a, b ,,c",), (None,)], "v string").select(ensure_list(F.col("v")).alias("l")).collect()
    assert r[0].l == ["a", "b", "c"] and r[1].l == []
    r = spark.createDataFrame([("Ada Lovelace King",), ("Plato",)], "v string").select(X.split_name(F.col("v")).alias("n")).collect()
    assert (r[0].n.first_name, r[0].n.last_name) == ("Ada", "Lovelace King") and r[1].n.last_name == ""
    r = spark.createDataFrame([(0.876,), (55.5,), (1.0,), (-3.0,), (None,)], "s double").select(
        match_score(F.col("s")).alias("m"), rate_band(F.col("s") * 100).alias("b")).collect()
    assert [x.m for x in r] == [88, 56, 100, 0, None]
    assert [x.b for x in r][:4] == ["warning", "good", "good", "poor"]


def test_inverted_index_gaps(spark):
    r = spark.createDataFrame([({"b": [1], "a": [0, 4]},), ({},)], "m map<string,array<int>>") \
        .select(from_inverted_index(F.col("m")).alias("t")).collect()
    assert r[0].t == " ".join(["a", "b", "", "", "a"]) and r[1].t == ""


def test_hash_embedding_matches_python(spark):
    def py(text, dim=384):
        h = hashlib.sha256(text.encode("utf-8")).hexdigest()
        vals = [int(h[i:i + 2], 16) / 255.0 - 0.5 for i in range(0, len(h), 2)]
        while len(vals) < dim:
            h = hashlib.sha256(h.encode("utf-8")).hexdigest()
            vals += [int(h[i:i + 2], 16) / 255.0 - 0.5 for i in range(0, len(h), 2)]
        vals = vals[:dim]
        n = sum(v ** 2 for v in vals) ** 0.5
        return [v / n for v in vals]
    texts = ["Graph. Graph. neural nets", "x"]
    r = spark.createDataFrame([(t,) for t in texts], "t string").select(hash_embedding(F.col("t")).alias("e")).collect()
    for t, row in zip(texts, r):
        assert max(abs(a - b) for a, b in zip(row.e, py(t))) < 1e-15


def test_validity_and_window_filters(spark):
    df = spark.createDataFrame([("ab", "x", dt.date(2024, 1, 5)), ("abc", "", None), (" abc ", "y", None),
                                ("long title", "z", dt.date(2023, 1, 1))],
                               "title string, external_id string, published_date date")
    assert [r.title for r in S.valid_items(df).collect()] == [" abc ", "long title"]
    kept = S.in_window(df, "2023-06-01", "2024-12-31").collect()
    assert [r.title for r in kept] == ["ab", "abc", " abc "]


def test_hash_embedding_column_is_made_from_digests(spark):
    """The chain of digests against plain Python, null text and a width that ends inside a digest; the numbers are not read from hex
    digits by regular expressions."""
    import hashlib
    from lectern.functions.vectors import with_hash_embedding
    df = spark.createDataFrame([("a",), ("",), (None,), ("žluť",)], "t string")
    out = with_hash_embedding(df, F.col("t"), "v", 40)
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    for t, v in out.collect():
        if t is None:
            assert v is None
            continue
        h = hashlib.sha256(t.encode()).hexdigest()
        x = [b / 255 - 0.5 for b in bytes.fromhex(h + hashlib.sha256(h.encode()).hexdigest())[:40]]
        norm = sum(a * a for a in x) ** 0.5
        assert v == pytest.approx([a / norm for a in x], abs=1e-12)


def test_tfidf_counts_terms_in_its_tasks(spark, monkeypatch):
    """Terms are counted before anything is exploded or shuffled, also when a task gives its counts out several times."""
    from collections import Counter
    from lectern.functions import vectors
    monkeypatch.setattr(vectors, "TERMS_HELD", 3)
    texts = ["Red fox, red hen", None, "hen; red fox fox", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    m = vectors.Tfidf.fit(df, F.col("t"), n=6, stops=["hen"])
    assert dict(zip(m.terms, m.idf)) == pytest.approx({t: np.log(5 / (1 + d)) + 1 for t, d in
                                                        (("red", 2), ("fox", 2), ("red fox", 2), ("fox fox", 1), ("fox red", 1))})
    out = m.vectors(df, F.col("t"), "v", stops=["hen"])
    assert "ArrowEvalPython" in out._jdf.queryExecution().optimizedPlan().toString()
    for t, v in out.collect():
        own = [w for w in (t or "").lower().replace(",", "").replace(";", "").split() if len(w) > 1 and w != "hen"]
        c = Counter(own + [f"{a} {b}" for a, b in zip(own, own[1:])])
        x = np.array([c[k] * w for k, w in zip(m.terms, m.idf)] + [0.0])
        assert v == pytest.approx((x / (np.linalg.norm(x) or 1)).tolist())


def test_inverted_index_groups_texts_not_words(spark):
    """One row a text, not a word, is shuffled; repeated ids make one map, as the words of both; null texts make none."""
    from lectern.sources.payloads import inverted_index
    df = spark.createDataFrame([(1, "b a  b"), (2, None), (3, ""), (4, "x y"), (4, "x z"), (None, "n")], "id long, t string")
    out = inverted_index(df, "id", "t")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.aii for r in out.collect()}
    assert got == {1: {"b": [0, 3], "a": [1], "": [2]}, 2: None, 3: {"": [0]}, 4: {"x": [0, 0], "y": [1], "z": [1]}, None: {"n": [0]}}
    back = {r.id: r.t for r in out.select("id", from_inverted_index(F.col("aii")).alias("t")).collect()}
    assert back == {1: "b a  b", 2: "", 3: "", 4: "xx yz", None: "n"}


def test_live_search_reads_its_sources_once(spark, tmp_path):
    """The matches of a live search are stored before they are numbered and joined to their numbers."""
    from lectern.plans import catalog
    catalog.load_all()
    spark.createDataFrame([(i, f"agent {i} went", "en", f"src{i % 3}", 10) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.QUERIES["live_search"](spark, str(tmp_path))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("jsontostructs", "from_json")
    assert {r.source for r in out.collect()} <= {"openalex", "crossref", "semantic_scholar"} and out.count() > 0
