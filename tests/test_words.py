"""Words, terms and organisations counted in Arrow batches, against the column expressions and plain Python."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import vectors
from lectern.functions import words as W
from lectern.operators import enrich as E

ODD = ["", " ", "a", "The cat; the CAT sat on İstanbul's ΣΟΦΟΣ x_y 12 ab1 Kelvin", "mail me@x.org now www.x.y http://z/a b", "see 10.1234/ab.c and $x^2$ or $ alone",
       "\\emph{gone} kept <b>bold</b> a < b", "日本語 text ２３ naïve cafés fiﬁx état", "MIT and Stanford; University of  Oxford Press, Acme Institute",
       "  NIH  ", "CERN CERN CERN CERN", "\x1cjoined\x85words\x0bhere again and again and again", None, "one " * 700, "😀 emoji😀word 𝒜𝒷𝒸 café"]


def texts(n=60):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "of", "the", "étude", "x1", "LONGERWORDHERE", "results", "et", "IEEE", "(note)", "a-b"]
    return ODD + [" ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 60, 300]))) for _ in range(n)]


def test_split_is_the_pattern(monkeypatch):
    monkeypatch.setattr(W, "_ASKED", np.full(0x110000, 2, np.uint8))
    own = [t.lower() for t in texts() if t is not None]
    for piece in (pa.array(own), pa.array(own).slice(3, 9), pa.array(["abc def"]), pa.array([""]), pa.array([], pa.string())):
        w = W.split(piece)
        got = [[] for _ in range(len(piece))]
        for c, d in zip(w.code, w.doc):
            got[d].append(w.words[int(c)].as_py())
        assert got == [[x for x in (t or []) if x] for t in pc.split_pattern_regex(piece, X.WORD_SPLIT).to_pylist()]


def test_pieces_hold_all_texts_in_order(monkeypatch):
    monkeypatch.setattr(W, "PIECE_BYTES", 50)
    monkeypatch.setattr(W, "PIECE_TEXTS", 3)
    a = pa.array(texts())
    parts = list(W.pieces(a))
    assert [t for p in parts for t in p.to_pylist()] == a.to_pylist() and max(map(len, parts)) == 3
    assert all(len(p) == 1 or pc.sum(pc.binary_length(p)).as_py() <= 50 for p in parts if p.null_count < len(p))


def test_profile_parts_equal_the_expressions(spark, monkeypatch):
    """Tokens (T2), organisations (T6) and keywords (T4: the n best in a stable order) of odd and long texts."""
    own = texts()
    df = spark.createDataFrame(list(enumerate(own)), "id int, t string").repartition(3)
    got = {r.id: r for r in E.with_terms(df, F.col("t"), "kw", 7).select("id", "kw", "_kw").collect()}
    tokens, terms = X.tokens(F.col("t")), X.tokens(F.col("t"), X.KEYWORD_STOPS)
    want = {r.id: r for r in df.select("id", F.size(tokens).alias("n"), X.org_entities(F.col("t")).alias("o"), terms.alias("terms")).collect()}
    for i, t in enumerate(own):
        assert got[i]._kw.tokens == want[i].n and got[i]._kw.organizations == want[i].o, t
        toks = want[i].terms if len((t or "").strip()) >= 20 else []
        total = max(len(toks), 1)
        scored = [(w, c / total * (1.0 + min(len(w) / 10.0, 1.0))) for w, c in Counter(toks).items()]
        scored += [(f"{a} {b}", c * 1.5 / total) for (a, b), c in Counter(zip(toks, toks[1:])).items()]
        best = sorted(scored, key=lambda x: -x[1])[:7]
        assert [k.keyword for k in got[i].kw] == [w for w, _ in best], t
        assert [k.score for k in got[i].kw] == [pytest.approx(r / best[0][1], abs=5.1e-5) for _, r in best]


@pytest.mark.parametrize("n, chosen", [(3, 16384), (12, 16384), (12, 2), (500, 16384)])
def test_fit_counts_the_pairs_that_can_win(spark, monkeypatch, n, chosen):
    """The n most frequent terms, ties by name, and their document frequencies; also where more words tie with the n-th than CHOSEN."""
    monkeypatch.setattr(vectors, "CHOSEN", chosen)
    own, stops = texts(), set(X.KEYWORD_STOPS)
    df = spark.createDataFrame([(t,) for t in own], "t string").repartition(4)
    tf, of = Counter(), Counter()
    for t in own:
        words = [w for w in re.split(r"[^\w]+", (t or "").lower()) if len(w) >= 2 and w not in stops]
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        tf.update(grams)
        of.update(set(grams))
    top = sorted(sorted(tf, key=lambda x: (-tf[x], x))[:n])
    m = vectors.Tfidf.fit(df, F.col("t"), n)
    assert m.terms == top and m.idf == [pytest.approx(np.log((1 + len(own)) / (1 + of[x])) + 1) for x in top]
    for r in m.vectors(df, F.col("t"), "v").collect():
        words = [w for w in re.split(r"[^\w]+", (r.t or "").lower()) if len(w) >= 2 and w not in stops]
        c = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        v = np.array([c[x] * i for x, i in zip(m.terms, m.idf)] + [0.0] * (n - len(m.terms)))
        assert np.allclose(r.v, v / (np.sqrt((v * v).sum()) or 1.0))


def test_pairs_of_other_words_are_not_counted():
    """Thousands of different pairs, of which two are of chosen words: only those leave a task."""
    w = W.split(pa.array(["big data big data"] + [f"w{i} x{i} y{i} big" for i in range(3000)]))
    t = W.term_counts(w, pa.array(["big", "data"]), True)
    assert sorted(zip(*t.to_pydict().values())) == [("big data", 2, 1), ("data big", 1, 1)]
    assert W.term_counts(w, None, True).num_rows == 9002


def test_a_rebuilt_profile_splits_a_text_once(spark):
    """Both tiers of a rebuild: no regular expression runs over texts in the JVM, word by word; one function of a batch gives tokens, keywords and organisations."""
    df = spark.createDataFrame([("a", "Acme University", "graph theory for graph people"), ("b", None, None)], "external_id string, title string, abstract string")
    model = vectors.Tfidf(["graph", "graph theory"], [1.0, 2.0], 4)
    for m in (None, model):
        out = E.enrich(df, "external_id", F.lit("article"), model=m)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan and "split(" not in plan and plan.count("[enriched(") == 1
    rows = {r.external_id: r for r in out.collect()}
    assert rows["a"].token_count == 5 + 1 and rows["a"].keywords[0].keyword == "graph" and [o.text for o in rows["a"].entities.organizations] == ["Acme University"]
    assert rows["a"].embedding == [pytest.approx(2 / 8 ** 0.5), pytest.approx(2 / 8 ** 0.5), 0, 0] and rows["b"].embedding == [0] * 4 and rows["b"].keywords == []


def test_a_streamed_batch_splits_a_text_once(spark):
    """What the sink of X2 writes is made by the same pass: one row an id, and no item that an earlier batch has."""
    from lectern.streaming import streams as S
    written = []

    class Table(S.Batches):
        def write(self, df, batch_id):
            written.append(df)
            super().write(df, batch_id)

    schema = "external_id string, title string, abstract string"
    table = Table(S.work_dir(spark, "words"), S.first_of("external_id"))
    sink = S.enrich_sink(table, spark.createDataFrame([], schema).schema, vectors.Tfidf(["graph"], [1.0], 2))
    sink(spark.createDataFrame([("a", "t", "graph words graph"), ("a", "t", "graph words graph")], schema), 0)
    sink(spark.createDataFrame([("a", "t", "other words"), ("b", "t", None)], schema), 1)
    for df in written:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan and "split(" not in plan and plan.count("[enriched(") == 1
    rows = {r.external_id: r for r in S.landed(spark, table, written[0].schema).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].token_count == 3 and rows["a"].embedding == [1, 0] and rows["b"].batch == 1
