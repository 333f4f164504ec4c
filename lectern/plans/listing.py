"""Search and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import aggregates as agg
from lectern.operators import search as S
from lectern.plans.catalog import query
from lectern.sources import tables as T


@query("article_listing", views=("content_union",), sql="""
WITH a AS (SELECT * FROM content_union WHERE type = 'article'),
     s AS (SELECT * FROM content_union WHERE type = 'scraped'),
     b AS (SELECT * FROM a UNION ALL SELECT * FROM s),
     r AS (SELECT *, row_number() OVER (ORDER BY published_date DESC NULLS LAST,
                                        CASE WHEN type = 'article' THEN 0 ELSE 1 END, id) AS pos,
                  count(*) OVER () AS total
           FROM b)
SELECT pos, id, external_id, title, published_date, type, source_name, total,
       CAST(greatest(1, ceil(total / 25.0)) AS BIGINT) AS total_pages
FROM r WHERE pos > 25 AND pos <= 50
""")
def article_listing(spark, sf_dir):
    """L1 page 2 (25 per page) of the unified listing, no filters."""
    return S.unified_listing(T.article(spark, sf_dir), T.scraped_content(spark, sf_dir),
                             page=2, page_size=25)


@query("article_search", views=("article", "scraped_content"), sql="""
WITH a0 AS (SELECT * FROM article
            WHERE (contains(lower(title), 'ent') OR contains(lower(abstract), 'ent')
                   OR list_bool_or([contains(lower(k), 'ent') for k in keywords])
                   OR list_bool_or([contains(lower(x.name), 'ent') for x in authors]))
              AND list_bool_or([contains(lower(c), 'fr') for c in categories])
              AND published_date >= DATE '2024-01-31' - 365),
     s0 AS (SELECT * FROM scraped_content
            WHERE (contains(lower(title), 'ent') OR contains(lower(abstract), 'ent'))
              AND list_bool_or([contains(lower(c), 'fr') for c in categories])
              AND published_date >= DATE '2024-01-31' - 365),
     a AS (SELECT id, external_id, title, published_date, 'article' AS type, source_name FROM a0),
     s AS (SELECT id + 1000000 AS id, external_id, title, published_date, 'scraped' AS type, source_name FROM s0),
     b AS (SELECT * FROM a UNION ALL SELECT * FROM s),
     r AS (SELECT *, row_number() OVER (ORDER BY published_date DESC NULLS LAST,
                                        CASE WHEN type = 'article' THEN 0 ELSE 1 END, id) AS pos,
                  count(*) OVER () AS total
           FROM b)
SELECT pos, CAST(id AS BIGINT) AS id, external_id, title, published_date, type, source_name, total,
       CAST(greatest(1, ceil(total / 50.0)) AS BIGINT) AS total_pages
FROM r WHERE pos <= 50
""")
def article_search(spark, sf_dir):
    """L1 with F1 search 'ent', F2 category 'fr', F4 last_year; page 1 of 50."""
    return S.unified_listing(T.article(spark, sf_dir), T.scraped_content(spark, sf_dir),
                             search="ent", categories="fr", date_range="last_year",
                             page=1, page_size=50)


@query("source_listing", views=("content_union",), sql="""
WITH a AS (SELECT * FROM content_union WHERE type = 'article'
             AND (contains(lower(source_name), '7') OR source_id = 7)),
     s AS (SELECT * FROM content_union WHERE type = 'scraped'
             AND (contains(lower(source_name), '7') OR source_id - 1000 = 7)),
     b AS (SELECT * FROM a UNION ALL SELECT * FROM s),
     r AS (SELECT *, row_number() OVER (ORDER BY published_date DESC NULLS LAST,
                                        CASE WHEN type = 'article' THEN 0 ELSE 1 END, id) AS pos,
                  count(*) OVER () AS total
           FROM b)
SELECT pos, id, external_id, title, published_date, type, source_name, total,
       CAST(greatest(1, ceil(total / 30.0)) AS BIGINT) AS total_pages
FROM r WHERE pos > 30 AND pos <= 60
""")
def source_listing(spark, sf_dir):
    """L1 with the F3 source filter '7' (name substring or id 7), page 2 of 30."""
    return S.unified_listing(T.article(spark, sf_dir), T.scraped_content(spark, sf_dir),
                             source="7", page=2, page_size=30)


@query("scraped_feed", views=("scraped_content",), sql="""
SELECT id, external_id, title, content_type, published_date, source_url,
       source_name AS scraper_name, scraped_at
FROM scraped_content
WHERE (contains(lower(title), 'le') OR contains(lower(abstract), 'le')) AND content_type = 'paper'
ORDER BY scraped_at DESC, id LIMIT 20 OFFSET 20
""")
def scraped_feed(spark, sf_dir):
    """L2 + F1 + F5: page 2 of the scraped feed for 'le' and content_type paper."""
    return S.scraped_feed(T.scraped_content(spark, sf_dir), search="le", content_type="paper",
                          page=2, per_page=20)


@query("interleave_sources", views=("content_union",), sql="""
SELECT id, source_name, row_number() OVER (PARTITION BY source_name
           ORDER BY published_date DESC NULLS LAST, id) AS rn,
       source_name AS src_rank
FROM content_union
""")
def interleave_sources(spark, sf_dir):
    """W1 over the whole content union: per-source position by recency; order key (rn, src_rank)."""
    u = T.content_union(spark, sf_dir)
    order = [("published_date", False), ("id", True)]
    return S.interleave(u, "source_name", order).select("id", "source_name", "rn", "src_rank")


@query("interleave_by_size", views=("content_union",), sql="""
WITH m AS (SELECT * FROM content_union WHERE contains(lower(title), 'tion') OR contains(lower(abstract), 'tion'))
SELECT id, source_name,
       row_number() OVER (PARTITION BY source_name ORDER BY id) AS rn,
       count(*) OVER (PARTITION BY source_name) AS src_size,
       min(id) OVER (PARTITION BY source_name) AS first_pos
FROM m
""")
def interleave_by_size(spark, sf_dir):
    """W2 over the search result 'tion' (uneven source buckets); list order = id."""
    m = T.content_union(spark, sf_dir).filter(S.text_match("tion", ["title", "abstract"]))
    return S.interleave_by_size(m, "source_name", "id").select("id", "source_name", "rn", "src_size",
                                                                "first_pos")


@query("dedupe_first", views=("content_union",), sql="""
WITH k AS (
  SELECT id, source_name, published_date,
         coalesce(nullif(doi, ''), nullif('raw:' || sha256(abstract), 'raw:'), nullif(title, '')) AS dkey,
         row_number() OVER (PARTITION BY source_name ORDER BY published_date DESC NULLS LAST, id) AS rn
  FROM content_union)
SELECT id, dkey FROM (
  SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY rn, source_name) AS r1
  FROM k WHERE dkey IS NOT NULL) WHERE r1 = 1
""")
def dedupe_first(spark, sf_dir):
    """W1 + W3 over all content: key = doi, else a content hash id (T22), else title;
    the first row per key in interleaved order survives (exact copies collapse)."""
    u = T.content_union(spark, sf_dir)
    key = F.coalesce(F.nullif(F.col("doi"), F.lit("")),
                     F.concat(F.lit("raw:"), F.sha2(F.col("abstract"), 256)),
                     F.nullif(F.col("title"), F.lit("")))
    il = S.interleave(u, "source_name", [("published_date", False), ("id", True)])
    out = S.dedupe_first(il, key, [F.col("rn"), F.col("source_name")])
    return out.select("id", F.col("_k").alias("dkey"))


@query("category_counts", views=("article",), sql="""
SELECT category, n FROM (
  SELECT c AS category, count(*) AS n FROM (SELECT unnest(categories) AS c FROM article)
  WHERE c IS NOT NULL AND c <> '' GROUP BY c)
ORDER BY n DESC, category LIMIT 50
""")
def category_counts(spark, sf_dir):
    """A1: top-50 categories of articles."""
    return agg.category_counts(T.article(spark, sf_dir), n=50)


@query("facet_counts", views=("content_union",), sql="""
SELECT type, lang, source_name, count(*) AS n
FROM (SELECT type, categories[1] AS lang, source_name FROM content_union)
GROUP BY GROUPING SETS ((type), (lang), (source_name), ())
""")
def facet_counts(spark, sf_dir):
    """Counts for every facet (type, language, source) in one grouping-sets pass."""
    u = T.content_union(spark, sf_dir).withColumn("lang", F.try_element_at("categories", F.lit(1)))
    return agg.facet_counts(u, ["type", "lang", "source_name"])


@query("date_drilldown", views=("content_union",), sql="""
SELECT CAST(date_trunc('month', published_date) AS DATE) AS period, count(*) AS n
FROM content_union WHERE published_date IS NOT NULL GROUP BY 1
""")
def date_drilldown(spark, sf_dir):
    """Month drill-down of published dates."""
    return agg.date_drilldown(T.content_union(spark, sf_dir), "published_date", "month")


@query("date_levels", views=("content_union",), sql="""
SELECT 'year' AS level, CAST(date_trunc('year', published_date) AS DATE) AS period, count(*) AS n FROM content_union WHERE published_date IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'month', CAST(date_trunc('month', published_date) AS DATE), count(*) FROM content_union WHERE published_date IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'day', published_date, count(*) FROM content_union WHERE published_date IS NOT NULL GROUP BY 2
""")
def date_levels(spark, sf_dir):
    """Year, month and day drill-down of published dates in one pass."""
    return agg.date_levels(T.content_union(spark, sf_dir), "published_date")


@query("client_filter_page", views=("content_union",), sql="""
WITH f AS (SELECT * FROM content_union
           WHERE list_bool_or([contains(lower(c), 'fr') OR contains(lower(c), 'de') for c in categories])
             AND source_name IN ('src1', 'src12', 'src5')
             AND (published_date IS NULL OR published_date >= DATE '2024-01-31' - INTERVAL 3 MONTH)),
i AS (SELECT id, source_name,
             row_number() OVER (PARTITION BY source_name ORDER BY id) AS rn,
             count(*) OVER (PARTITION BY source_name) AS src_size,
             min(id) OVER (PARTITION BY source_name) AS first_pos FROM f)
SELECT * FROM i ORDER BY rn, src_size DESC, first_pos LIMIT 20
""")
def client_filter_page(spark, sf_dir):
    """F11 + W2 + L5: client filters (any category, exact sources, 3-month cutoff with null
    dates passing), size-ordered interleave, first page of 20."""
    u = T.content_union(spark, sf_dir)
    f = S.client_filter(u, ["fr", "de"], ["src1", "src12", "src5"], "last_3_months")
    i = S.interleave_by_size(f, "source_name", "id")
    return (i.orderBy("rn", F.col("src_size").desc(), "first_pos").limit(20)
            .select("id", "source_name", "rn", "src_size", "first_pos"))
