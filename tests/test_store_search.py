"""Upsert modes, listing, interleave, dedupe, dates, pages: small hand-computed cases."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.functions import dates as D
from lectern.operators import pages as PG
from lectern.operators import search as S
from lectern.operators import store as ST


def _base(spark):
    return spark.createDataFrame([("a", "A", "x", 1), ("b", "B", "y", 2)],
                                 "external_id string, title string, abstract string, n int")


def test_upsert_not_null_truthy_replace(spark):
    batch = spark.createDataFrame(
        [("a", 1, None, "", 0), ("a", 2, "A2", None, None), ("c", 3, "C", None, 5), (None, 4, "Z", "z", 1),
         ("c", 5, None, "cc", None)],
        "external_id string, seq int, title string, abstract string, n int")
    t, c = ST.upsert(_base(spark), batch, ["external_id"], "seq", "not_null",
                     insert_defaults={"abstract": F.lit("")})
    got = {r.external_id: (r.title, r.abstract, r.n, r.op) for r in t.collect()}
    assert got["a"] == ("A2", "", 0, "updated")          # '' and 0 are values in not_null mode
    assert got["b"] == ("B", "y", 2, "unchanged")
    assert got["c"] == ("C", "cc", 5, "saved")
    assert c.collect()[0].asDict() == {"saved": 1, "updated": 3, "skipped": 1}
    t2, _ = ST.upsert(_base(spark), batch, ["external_id"], "seq", "truthy")
    got2 = {r.external_id: (r.title, r.abstract, r.n) for r in t2.collect()}
    assert got2["a"] == ("A2", "x", 1)                    # ''/0 keep the old value
    t3, _ = ST.upsert(_base(spark), batch, ["external_id"], "seq", "replace")
    got3 = {r.external_id: (r.title, r.abstract, r.n) for r in t3.collect()}
    assert got3["a"] == ("A2", None, None) and got3["c"] == (None, "cc", None)


def test_upsert_idempotent(spark):
    batch = spark.createDataFrame([("a", 1, "A9", None, None)],
                                  "external_id string, seq int, title string, abstract string, n int")
    t1, _ = ST.upsert(_base(spark), batch, ["external_id"], "seq")
    t2, _ = ST.upsert(t1.drop("op"), batch, ["external_id"], "seq")
    assert sorted(map(tuple, t1.drop("op").collect())) == sorted(map(tuple, t2.drop("op").collect()))


def test_interleave_and_dedupe(spark):
    rows = [(i, s, f"t{i % 4}") for i, s in enumerate("aaabbc")]
    df = spark.createDataFrame(rows, "pos int, src string, title string")
    il = S.interleave(df, "src", [("pos", True)]).orderBy("rn", "src_rank").collect()
    assert [r.pos for r in il] == [0, 3, 5, 1, 4, 2]   # round robin, a permutation
    d = S.dedupe_first(S.interleave(df, "src", [("pos", True)]), F.col("title"), [F.col("rn"), F.col("src")])
    got = sorted((r._k, r.pos) for r in d.collect())
    assert got == [("t0", 0), ("t1", 5), ("t2", 2), ("t3", 3)]


def test_listing_caps_and_pages(spark):
    day = dt.date(2024, 1, 1)
    arts = spark.createDataFrame(
        [(i, f"doc:{i}", f"title {i}", "x", [], day - dt.timedelta(days=i), None, "u", ["en"], [], 0, 1, "s1")
         for i in range(5)],
        "id long, external_id string, title string, abstract string, "
        "authors array<struct<name:string,orcid:string,institution:string>>, published_date date, doi string, "
        "url string, categories array<string>, keywords array<string>, citation_count int, api_source_id long, "
        "source_name string")
    scr = spark.createDataFrame(
        [(i, 10, f"doc:s{i}", f"s {i}", "y", "paper", day - dt.timedelta(days=i), None, "u", ["en"],
          dt.datetime(2024, 1, 1), "s10") for i in range(3)],
        "id long, scraper_config_id long, external_id string, title string, abstract string, content_type string, "
        "published_date date, doi string, source_url string, categories array<string>, scraped_at timestamp, "
        "source_name string")
    out = S.unified_listing(arts, scr, page=1, page_size=3, cap=2).orderBy("pos").collect()
    assert [r.external_id for r in out] == ["doc:0", "doc:s0", "doc:1"]   # articles first on equal dates
    assert out[0].total == 4 and out[0].total_pages == 2


def test_parse_dates(spark):
    cases = [("2024-03-05", dt.date(2024, 3, 5)), ("03/05/2024", dt.date(2024, 3, 5)),
             ("25/12/2023", dt.date(2023, 12, 25)), ("5 mars 2024", dt.date(2024, 3, 5)),
             ("January 7, 2021", dt.date(2021, 1, 7)), ("7 januar 2021", dt.date(2021, 1, 7)),
             ("Mon, 05 Feb 2024 10:00:00 +0000", dt.date(2024, 2, 5)), ("published in 1999", dt.date(1999, 1, 1)),
             ("3 days ago", dt.date(2024, 1, 28)), ("dün", dt.date(2024, 1, 30)), ("nonsense", None), ("", None)]
    df = spark.createDataFrame([(s,) for s, _ in cases], "s string")
    got = [r.d for r in D.with_parsed_date(df, F.col("s"), "d").collect()]
    assert got == [d for _, d in cases]


def test_page_extraction(spark):
    html = ('<html><body><div class="item card">x</div><div class="item card">y</div><div class="item card">z</div>'
            '<article><h1>T &amp; U</h1><p>first <b>para</b></p><p>second</p><img data-src="/i.png" src="s.png">'
            '<a href="/next">Next &raquo;</a></article></body></html>')
    pages = spark.createDataFrame([(1, "https://ex.org/list?page=2", html)], "page_id long, url string, html string")
    it = PG.extract_items(pages, ("article", None), {"title": ("h1", None, False), "abstract": ("p", None, False),
                                                     "img": ("img", "src", False), "links": ("a", "href", True)}).collect()
    assert it[0].title == "T & U" and it[0].abstract == "first para"
    assert it[0].img == "https://ex.org/i.png" and it[0].links == ["https://ex.org/next"]
    cc = PG.container_candidates(pages).collect()
    assert [(r.cls, r.n) for r in cc] == [("item.card", 3)]
    p = pages.select(PG.pagination(F.col("url"), F.col("html")).alias("p")).collect()[0].p
    assert p.type == "NEXT_BUTTON"


@pytest.mark.parametrize("parts", [1, 4, 16, 200])
def test_positions_do_not_depend_on_partitions(spark, parts):
    """A key with a third of the rows, null keys, tied leading values and a payload column."""
    from lectern.operators.search import position_within
    n = 100_000 if parts == 16 else 4_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(n).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else concat('k', id % 50) end as key",
                                       "(id * 7919) % 97 as day", "repeat('x', 20) as payload").repartition(7)
        got = position_within(df, "key", [("day", False), ("id", True)])
        want = df.selectExpr("id", "row_number() over (partition by key order by day desc, id) as want")
        both = got.join(want, "id")
        assert got.columns == ["id", "key", "day", "payload", "rn"] and both.count() == n and both.where("rn <> want").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
