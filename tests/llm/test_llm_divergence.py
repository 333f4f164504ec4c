"""Source divergence audit: DuckDB SQL on odd rows, a plain Python version on small cases, and exact arithmetic."""

import re

import duckdb
import pytest

from lectern.llm import divergence
from llm_cases import LONG, ODD, documents, prose
from tools.check import rows_of


def plain(rows, min_docs, top=10):
    """The audit by loops over every term and pair."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
            for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = {t for _, _, ts in own for t in ts if sum(t in x[2] for x in own) >= min_docs}
        count = lambda source: {t: sum(ts.count(t) for _, s, ts in own if source in (s, None)) for t in kept}

        def p(counts):
            return {t: 1 + 10**9 * (c + 2) // (sum(counts.values()) + 2 * len(kept)) for t, c in counts.items()}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        sources, whole = {s for _, s, _ in own}, p(count(None))
        share = {s: p(count(s)) for s in sources}
        for s in sources:
            found = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), "pair", o) for o in sources - {s}]
            terms = [(-f(share[s][t], whole[t]), t.encode(), "term", t) for t, c in count(s).items() if c and share[s][t] > whole[t]]
            for part, cut in ((sorted(found), None), (sorted(terms), top)):
                out += [(lang, s, kind, item, -v, n + 1) for n, (v, _, kind, item) in enumerate(part[:cut])]
    return sorted(out)


def audit(spark, rows, **kw):
    docs = documents(spark, [(i, *r) for i, r in enumerate(rows)])
    got = divergence.audit(docs, **kw).collect()
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in got)


def cases():
    rows = [(f"common word{i % 3} Étoile {prose(i % 7, 12)} {'x' * (i % 4)}", "en" if i % 3 else None, f"s{i % 5}") for i in range(60)]
    return rows + [("", "en", "empty"), (None, "en", None), ("only here", "de", "a"), ("A a a_a 1a", "fr", "é"), ("zz", "fr", "z"), ("b c", "fr", "z")]


@pytest.mark.parametrize("min_docs", [1, 3, 10])
def test_equals_plain(spark, min_docs):
    rows = cases()
    assert audit(spark, rows, min_docs=min_docs) == plain(rows, min_docs)


def test_many_blocks_of_terms_and_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERM_BLOCK", 5)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(divergence, "HELD", 7)
    rows = cases()
    assert audit(spark, rows, min_docs=2) == plain(rows, 2)


def test_ties_in_a_cell_are_cut_in_utf8_order(spark):
    # many terms with equal counts: one cell, of which the first ten terms are returned
    words = ["é", "Z", "￮", "\U00010400"] + [f"{c}{d}" for c in "abcde" for d in "uvxyw"]
    rows = [(" ".join(words), "en", "one")] * 10 + [("other", "en", "two")] * 10
    got = [r for r in audit(spark, rows) if r[2] == "term" and r[1] == "one"]
    assert got == [r for r in plain(rows, 10) if r[2] == "term" and r[1] == "one"]
    assert [r[3] for r in sorted(got, key=lambda r: r[5])] == sorted({w.lower() for w in words}, key=str.encode)[:10]


def test_odd_rows_equal_sql(spark):
    docs = documents(spark, ODD + [(20 + i, f"{prose(i % 3)} {LONG[:4000]}", "en", f"s{i % 4}") for i in range(24)])
    con = duckdb.connect()
    con.register("documents", docs.select("text", "lang", "source").toPandas())
    res = con.execute(divergence.SQL)
    cols = [c[0] for c in res.description]
    got = divergence.op11_divergence(docs)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(cols, res.fetchall())


def test_empty(spark):
    assert divergence.op11_divergence(documents(spark, [])).count() == 0
    # no term in ten documents: pairs with value 0, by UTF-8
    assert audit(spark, [("a", "en", "x"), ("b", "en", "y"), (None, "en", "z")]) == [
        ("en", a, "pair", b, 0, n + 1) for a in "xyz" for n, b in enumerate(c for c in "xyz" if c != a)]


def test_shares_of_huge_counts_are_exact(spark):
    count, total, kept = 987_654_321_012, 9_876_543_210_123_456, 123_456_789
    df = spark.createDataFrame([(count, total, kept)], "n long, total long, kept long")
    got = df.select(divergence.share(df.n, df.total, df.kept).alias("p")).first().p
    assert got == 1 + 10**9 * (count + 2) // (total + 2 * kept)
