"""Source divergence audit: how far the sources of a language stand apart, and by which terms.

Texts are cut into terms (runs of letters: ASCII letters and everything beyond
ASCII).  A language keeps the V terms found in at least `MIN_DOCS` of its
documents.  A group - one source of one language - and the language itself give
each kept term the smoothed share

    p = 1 + floor(SCALE * (count + 2) / (N + 2 V)),   N: its kept occurrences,

and two shares are compared by f = floor((p - q)^2 / (p + q)).  All arithmetic
is exact: decimals up to p, 64-bit integers from there on (p is at most SCALE + 1).

*Terms of a group* are ranked by count cells.  f depends on the term only
through (count in the group, count in the language), and far fewer such cells
occur than terms: f is evaluated once a cell, cells of equal f are merged, the
merged cells are ranked by cumulative multiplicity, and only the cells that
reach the wanted ranks are expanded into terms, in UTF-8 order.

*Pairs of sources* add f over all kept terms.  Terms are dealt into blocks, the
sources of a language into blocks too; a task lays the shares of one block pair
out as a small numpy matrix and returns one sum for each pair of its sources.
Every pair of sources is a row of the result, but no pair is ever made per term.

Defined results: null text, lang and source read as ''; rows are documents of
their own, also where equal or without doc_id (which is not read); a language
that keeps no term has value 0 in all its pairs and no terms; a source alone in
its language has no pairs; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import prepare, stored

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
HELD = 100_000         # distinct (group, term) counts that a task holds before it hands them on
TERM_BLOCK = 512       # terms in a block, about
SOURCE_BLOCK = 128     # sources in a block


def _read(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text").cast("binary").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a group, added up over what a task reads (handed on beyond `most`)."""
    terms = re.compile(TERM).findall
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            cols = [pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)),
                    pa.array(n, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = terms(text.lower())  # bytes.lower() maps A-Z only
            if found:
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(found)
                d.update(set(found))
                size += len(n) - before
                if size > most:
                    yield from rows()
                    held.clear()
                    size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    most = HELD
    part = _read(docs).mapInArrow(lambda batches: _counted(batches, most), "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term, as a long; exact for any counts."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    down = (total.cast("decimal(20,0)") + 2 * kept).cast("decimal(20,0)")
    return F.call_function("div", up, down) + 1


def distance(p: Column, q: Column) -> Column:
    """f of two shares; p, q >= 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, source, term, n, in_lang) of kept terms; (lang, source, total, kept) of every group; (lang, total, kept)
    of every language; stored.  total: occurrences of kept terms, kept: V."""
    counts = stored(term_counts(docs), "term-counts")
    # a term's counts in all sources of a language: at most one for each source
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"),
                                               F.collect_list(F.struct("source", "n")).alias("own")).where(F.col("docs") >= min_docs)
    terms = stored(whole.select("lang", "term", "in_lang", F.explode("own").alias("o")).select("lang", "o.source", "term", "o.n", "in_lang"), "kept-terms")
    groups = _read(docs).select("lang", "source").distinct()
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = terms.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(own, ["lang", "source"], "left").join(v, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept")]), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    return terms, groups, stored(langs, "langs")


def top_terms(terms: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group holds more of than its language, by falling f."""
    cells = terms.groupBy("lang", "source", "n", "in_lang").agg(F.count("*").alias("many"))
    cells = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).drop("total", "kept")
    cells = cells.join(langs, "lang").withColumn("q", share(F.col("in_lang"), F.col("total"), F.col("kept")))
    cells = stored(cells.where("p > q").select("lang", "source", "n", "in_lang", "many", distance(F.col("p"), F.col("q")).alias("value")), "cells")
    # a merged cell holds a term at least, so the first `top` ranks lie in the first `top` of them
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    merged = merged.withColumn("nth", F.row_number().over(falling)).where(F.col("nth") <= top)
    before = F.sum("many").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    reached = merged.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < top)
    reached = reached.select("lang", "source", "value", "before")
    wanted = cells.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "in_lang", "value", "before")
    expanded = terms.join(wanted, ["lang", "source", "n", "in_lang"])
    # a cell that reaches past the last rank is cut where it is read: the window keeps its first terms only
    utf8 = Window.partitionBy("lang", "source", "value").orderBy("term")
    expanded = expanded.withColumn("nth", F.row_number().over(utf8)).where(F.col("nth") <= top)
    expanded = expanded.withColumn("rank", (F.col("before") + F.col("nth")).cast("int")).where(F.col("rank") <= top)
    return expanded.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _block_sums(block: pd.DataFrame, width: int) -> pd.DataFrame:
    """Sums of f for each pair (a < b) of the sources of one block pair (`width` sources in a block), over the block's terms.

    Rows without a term carry a source's share of a term it lacks.
    """
    empty = block["term"].isna().to_numpy()
    base = block[empty].sort_values("at")
    at = base["at"].to_numpy()
    own = block[~empty]
    place, _ = pd.factorize(own["term"])
    n = place.max() + 1 if len(place) else 0
    p = np.repeat(base["p"].to_numpy(np.int64)[:, None], n, axis=1)
    p[np.searchsorted(at, own["at"].to_numpy()), place] = own["p"].to_numpy(np.int64)
    side = at // width
    left, right = int(block["left"].iloc[0]), int(block["right"].iloc[0])
    a, b, value = [], [], []
    for i in np.flatnonzero(side == left):
        js = np.flatnonzero((side == right) & (at > at[i]))
        if len(js) and n:
            d = p[js] - p[i]
            value.append((d * d // (p[js] + p[i])).sum(axis=1))
            a.append(np.full(len(js), at[i]))
            b.append(at[js])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": block["lang"].iloc[0], "a": join(a), "b": join(b), "value": join(value)})


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of a group's language, by falling sum of f over all kept terms."""
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sides = (F.col("at") / SOURCE_BLOCK).cast("int")
    last = F.max(sides).over(Window.partitionBy("lang"))
    blocks = F.ceil(F.greatest("kept", F.lit(1)) / TERM_BLOCK)
    index = stored(groups.withColumn("at", at).withColumn("last", last).withColumn("blocks", blocks), "sources")
    # a source of block s meets the block pairs (s, t) and (t, s), the lesser first
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.struct(F.least(sides, t).alias("left"), F.greatest(sides, t).alias("right"))))
    shared = terms.join(index, ["lang", "source"])
    shared = shared.select("lang", "at", "last", "term", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    lacking = index.where("kept > 0").select("lang", "at", "last", F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                                             share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p"))
    dealt = shared.unionByName(lacking).select("lang", "at", "block", "term", "p", meets.alias("m")).select("lang", "at", "block", "term", "p", "m.*")
    width = SOURCE_BLOCK
    sums = dealt.groupBy("lang", "block", "left", "right").applyInPandas(lambda block: _block_sums(block, width), "lang string, a int, b int, value long")
    sums = stored(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair-sums")
    both = sums.unionAll(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, other = index.select("lang", "source", F.col("at").alias("a")), index.select("lang", F.col("source").alias("item"), F.col("at").alias("b"))
    pairs = one.join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")  # the result's own rows
    pairs = pairs.withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` and part `term` of every group."""
    prepare(docs.sparkSession)
    terms, groups, langs = kept_terms(docs, min_docs)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(terms, groups).withColumn("part", F.lit("pair")).select(*cols)
    return pairs.unionAll(top_terms(terms, groups, langs, top).withColumn("part", F.lit("term")).select(*cols))


def op11_divergence(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return audit(docs)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
tokens AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= 10),
vs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT c.lang, c.source, sum(c.n)::HUGEINT AS total FROM counts c JOIN kept k USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * vs.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (vs.total + 2 * vs.v) AS q
  FROM grps g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN counts c USING (lang, source, term) LEFT JOIN totals t USING (lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM cells WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""
