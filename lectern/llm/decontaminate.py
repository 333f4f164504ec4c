"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index holds one posting (term, document, position) for every occurrence of a
test term in the training documents; it is stored once and gives the corpus
frequency of each term.  A test phrase is looked up from its rarest term: that
term's posting list, shifted by the term's offset in the phrase, gives candidate
starts; they are intersected with the shifted list of the next rarest term, and
then, in the documents that still have candidates, with the lists of all terms of
the phrase.  The texts are read once and never shuffled.

Defined results: null text has no words and is clean; an item without words has
no window, one of fewer words than `window` is a single window; rows with equal
doc_id and text are matched alike, rows with equal or null doc_id but other text
apart (a document is known by doc_id and a 64-bit hash of its text); items
without item_id hit words but are not counted or listed; an empty table on
either side gives no hits; only doc_id, text and item_id are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bitmap, collapsed, marked, prepare, small, spaces_plus_one, stored

#: ASCII but letters and digits; A-Z are lower-cased before they could separate.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
WINDOW = 10
#: Test-side tables (terms, windows, anchors) of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
DOC = ["did", "th"]


def _line(text: Column) -> Column:
    """The words of a text, lower-cased (A-Z), joined by single spaces."""
    return collapsed(text, SEPARATORS, string.ascii_uppercase, string.ascii_lowercase)


def _keyed(docs: DataFrame) -> DataFrame:
    """documents with the two key columns (null-free) that postings carry."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("did"),
                       F.xxhash64("doc_id", "text").alias("th"))


def _tokens(keyed: DataFrame) -> DataFrame:
    """One row per word: document key, pos, term (positions of a text count alike wherever it is tokenised)."""
    return keyed.select(*DOC, F.posexplode(F.split(_line(F.col("text")), " ")).alias("pos", "term"))


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, win) of distinct windows, and (wid, item_id) of the items that have them."""
    words = items.select("item_id", F.split(_line(F.col("text")), " ").alias("w")).where("w[0] <> ''")
    each = words.select("item_id", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"), "w") \
        .select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("win"))
    each = stored(each.distinct(), "item-windows")
    wins = stored(each.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return wins, each.join(small(wins, BROADCAST_ROWS), "win").select("wid", "item_id")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (did, th, pos, term) of `terms` (term, distinct) in `docs`."""
    return stored(_tokens(_keyed(docs)).join(small(terms, BROADCAST_ROWS), "term").select(*DOC, "pos", "term"), "postings")


def _anchors(wins: DataFrame, index: DataFrame) -> DataFrame:
    """Per window that can occur: the offsets and terms of its two rarest words by corpus frequency."""
    tf = stored(index.groupBy("term").agg(F.count("*").alias("tf")), "frequencies")
    ranked = wins.select("wid", F.size("win").alias("len"), F.posexplode("win").alias("off", "term")) \
        .join(small(tf, BROADCAST_ROWS), "term").groupBy("wid", "len") \
        .agg(F.array_sort(F.collect_list(F.struct("tf", "off", "term"))).alias("r")).where("size(r) = len")
    return stored(ranked.select("wid", "len", F.col("r")[0]["off"].alias("o1"), F.col("r")[0]["term"].alias("t1"),
                                F.get("r", F.lit(1))["off"].alias("o2"), F.get("r", F.lit(1))["term"].alias("t2")), "anchors")


def _in_documents(index: DataFrame, left: DataFrame) -> DataFrame:
    """The postings of the documents in `left`, and a few others that hit the same bits."""
    marks = bitmap(left.select(F.col("th").alias("h")), "bitmap")
    return marked(index, F.col("th"), marks).where("_marked").select(*DOC, "pos", "term")


def phrase_matches(wins: DataFrame, index: DataFrame) -> DataFrame:
    """Exact occurrences (did, th, start, wid, len) of the windows in the documents; stored."""
    anchors = _anchors(wins, index)
    first = index.withColumnRenamed("term", "t1").join(small(anchors, BROADCAST_ROWS), "t1") \
        .select(*DOC, (F.col("pos") - F.col("o1")).alias("start"), "wid", "len", "o2", "t2").where("start >= 0")
    first = stored(first, "candidates")
    seconds = anchors.where("t2 is not null").select(F.col("t2").alias("term")).distinct()
    second = index.join(small(stored(seconds, "seconds"), BROADCAST_ROWS), "term", "left_semi") \
        .select(*DOC, "pos", F.col("term").alias("t2"))
    both = first.where("t2 is not null").withColumn("pos", F.col("start") + F.col("o2")) \
        .join(second, [*DOC, "pos", "t2"], "left_semi").select(*DOC, "start", "wid", "len")
    single = first.where("t2 is null").select(*DOC, "start", "wid", "len")
    left = stored(both.unionAll(single).distinct(), "intersected")
    # the lists of all terms, shifted alike, in the documents that still have candidates
    wanted = left.join(small(wins, BROADCAST_ROWS), "wid") \
        .select(*DOC, "start", "wid", "len", F.posexplode("win").alias("off", "term")) \
        .withColumn("pos", F.col("start") + F.col("off"))
    found = wanted.join(_in_documents(index, left), [*DOC, "pos", "term"], "left_semi").groupBy(*DOC, "start", "wid", "len") \
        .agg(F.count("*").alias("n")).where("n = len")
    return stored(found.drop("n"), "matches")


def proximity_matches(index: DataFrame, wins: DataFrame, slop: int) -> DataFrame:
    """(did, th, wid, near) where a window's two rarest terms come within `slop` words, in either order.

    Positions are bucketed by `slop`; the second list is entered under its own and
    both neighbouring buckets, so the join is on equal keys.  near is the least distance.
    """
    anchors = _anchors(wins, index).where("t2 is not null")
    hint = small(anchors, BROADCAST_ROWS)
    a = index.withColumnRenamed("term", "t1").join(hint, "t1").select(
        *DOC, "wid", F.col("pos").alias("p1"), F.floor(F.col("pos") / slop).alias("bucket"))
    b = index.withColumnRenamed("term", "t2").join(hint, "t2").select(
        *DOC, "wid", F.col("pos").alias("p2"),
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("pos") / slop) + d)).alias("bucket"))
    gap = F.abs(F.col("p1") - F.col("p2"))
    return a.join(b, [*DOC, "wid", "bucket"]).where((gap > 0) & (gap <= slop)).groupBy(*DOC, "wid").agg(F.min(gap).alias("near"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and the row's key did, th)."""
    prepare(docs.sparkSession)
    wins, owners = windows_of(items, window)
    terms = stored(wins.select(F.explode("win").alias("term")).distinct(), "terms")
    matches = phrase_matches(wins, build_index(docs, terms))
    hit = matches.select(*DOC, F.explode(F.expr("sequence(start, start + len - 1)")).alias("pos")).distinct() \
        .groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    named = matches.select(*DOC, "wid").distinct().join(small(stored(owners, "owners"), BROADCAST_ROWS), "wid") \
        .where("item_id is not null").select(*DOC, F.col("item_id").cast("string").alias("item")).distinct() \
        .groupBy(*DOC).agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    rows = _keyed(docs).select("doc_id", *DOC, spaces_plus_one(_line(F.col("text"))).alias("n_words"))
    return rows.join(hit.join(named, DOC, "left"), DOC, "left").select(
        "doc_id", *DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean_only(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the documents in which a window of an item occurs."""
    prepare(docs.sparkSession)
    wins, _ = windows_of(items, window)
    terms = stored(wins.select(F.explode("win").alias("term")).distinct(), "terms")
    hit = stored(phrase_matches(wins, build_index(docs, terms)).select(*[F.col(k).alias(f"_{k}") for k in DOC]).distinct(), "hit")
    # only the texts of documents that may be hit go through the join
    keys = {"_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_th": F.xxhash64("doc_id", "text")}
    rows = marked(docs.withColumns(keys), F.col("_th"), bitmap(hit.select(F.col("_th").alias("h")), "hit-bitmap"))
    exact = rows.where("_marked").join(hit.hint("merge"), ["_did", "_th"], "left_anti")
    return rows.where("not _marked").select(*docs.columns).unionAll(exact.select(*docs.columns))


def op10_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's columns."""
    return report(docs, items).drop(*DOC)


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
matches AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM grams g JOIN wins v ON g.win = v.win AND g.n = v.n),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM matches) m, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
