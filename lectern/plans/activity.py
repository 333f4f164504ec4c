"""User activity, library and interaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import activity as A
from lectern.operators import aggregates as agg
from lectern.operators import recs as R
from lectern.operators import search as S
from lectern.plans.catalog import query
from lectern.session import AS_OF
from lectern.sources import tables as T


@query("library_state", views=("saved_article",), sql="SELECT user_id, external_id, saved_at FROM saved_article")
def library_state(spark, sf_dir):
    """Current library (last of save/remove_save per user and item wins)."""
    return T.saved_article(spark, sf_dir)


@query("recent_activities", views=("user_activity",), sql="""
SELECT id, user_id, activity_type, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
  FROM user_activity) WHERE rn <= 10
""")
def recent_activities(spark, sf_dir):
    """The 10 latest activities of every user."""
    return A.latest_n(T.user_activity(spark, sf_dir), "user_id", "created_at", 10).select(
        "id", "user_id", "activity_type", "rn")


@query("recent_searches", views=("user_activity",), sql="""
SELECT user_id, query, last_at, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, query) AS rn
  FROM (SELECT user_id, trim(query) AS query, max(created_at) AS last_at FROM user_activity
        WHERE activity_type = 'search' AND trim(query) <> '' GROUP BY 1, 2)) WHERE rn <= 10
""")
def recent_searches(spark, sf_dir):
    """10 newest distinct trimmed queries per user."""
    return A.recent_searches(T.user_activity(spark, sf_dir)).select("user_id", "query", "last_at", "rn")


@query("age_buckets", views=("user_activity",), sql=f"""
SELECT id, CASE WHEN s < 60 THEN 'just now'
                WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || ' min ago'
                WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || ' h ago'
                WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || ' d ago'
                ELSE strftime(created_at, '%Y-%m-%d') END AS age
FROM (SELECT id, created_at, epoch(TIMESTAMP '{AS_OF}') - floor(epoch(created_at)) AS s FROM user_activity)
""")
def age_buckets(spark, sf_dir):
    """Relative age label of every activity at as_of."""
    return T.user_activity(spark, sf_dir).select("id", A.age_bucket(F.col("created_at")).alias("age"))


@query("saved_check", views=("user_activity", "saved_article"), sql="""
SELECT DISTINCT v.user_id, v.content_id AS external_id
FROM user_activity v SEMI JOIN saved_article s ON v.user_id = s.user_id AND v.content_id = s.external_id
WHERE v.activity_type = 'view'
""")
def saved_check(spark, sf_dir):
    """Of the items each user viewed, which are in the user's library."""
    act = T.user_activity(spark, sf_dir)
    ids = (act.filter(F.col("activity_type") == "view")
           .select("user_id", F.col("content_id").alias("external_id")).distinct())
    return A.saved_subset(ids, T.saved_article(spark, sf_dir))


@query("library_page", views=("saved_article",), sql="""
SELECT user_id, external_id, pos, total, CAST(greatest(1, ceil(total / 5.0)) AS BIGINT) AS total_pages FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, external_id) AS pos,
         count(*) OVER (PARTITION BY user_id) AS total
  FROM saved_article) WHERE pos > 5 AND pos <= 10
""")
def library_page(spark, sf_dir):
    """L3: page 2 (5 per page) of every user's library."""
    return S.library_page(T.saved_article(spark, sf_dir).withColumn("title", F.lit(None).cast("string")),
                          page=2, page_size=5).select("user_id", "external_id", "pos", "total", "total_pages")


@query("popular_items", views=("saved_article", "content_union"), sql="""
SELECT external_id, title, save_count FROM (
  SELECT s.external_id, u.title, count(*) AS save_count
  FROM saved_article s LEFT JOIN content_union u ON s.external_id = u.external_id
  GROUP BY s.external_id, u.title)
ORDER BY save_count DESC, external_id LIMIT 20
""")
def popular_items(spark, sf_dir):
    """A2: the 20 most saved items, grouped by (id, title) as the reference does."""
    s = T.saved_article(spark, sf_dir)
    u = T.content_union(spark, sf_dir).select("external_id", "title")
    return agg.popular(s.join(u, "external_id", "left"), k=20, by=("external_id", "title"))


@query("interaction_matrix", views=("user_activity",), sql="""
SELECT user_id, content_id AS external_id,
       sum(CASE WHEN activity_type = 'save' THEN 3.0 ELSE 1.0 END) AS w
FROM user_activity WHERE activity_type IN ('save', 'view') AND coalesce(content_id, '') <> ''
GROUP BY 1, 2
""")
def interaction_matrix(spark, sf_dir):
    """A3: user x item interaction weights (save 3, view 1) as sparse triples."""
    return R.interaction_matrix(T.user_activity(spark, sf_dir))


@query("interaction_tiers", views=("user_activity", "user_profile"), sql="""
WITH c AS (SELECT user_id, count(*) AS n FROM user_activity
           WHERE activity_type IN ('save', 'view') GROUP BY user_id),
     u AS (SELECT user_id FROM user_profile UNION SELECT user_id FROM c)
SELECT u.user_id, coalesce(c.n, 0) AS n_interactions,
       CASE WHEN coalesce(c.n, 0) < 3 THEN 'cold' WHEN c.n < 5 THEN 'light'
            WHEN c.n > 50 THEN 'heavy' ELSE 'regular' END AS tier,
       CASE WHEN coalesce(c.n, 0) < 3 THEN NULL WHEN c.n < 5 THEN 0.9 WHEN c.n > 50 THEN 0.5 ELSE 0.65 END AS alpha,
       CASE WHEN coalesce(c.n, 0) < 3 THEN NULL WHEN c.n < 5 THEN 0.1 WHEN c.n > 50 THEN 0.5 ELSE 0.35 END AS beta
FROM u LEFT JOIN c USING (user_id)
""")
def interaction_tiers(spark, sf_dir):
    """A4: interaction count and hybrid weights for every known user."""
    return R.interaction_tiers(T.user_activity(spark, sf_dir), T.user_profile(spark, sf_dir))


@query("distinct_entities", views=("user_activity",), sql="""
SELECT count(DISTINCT user_id) AS n_users,
       count(DISTINCT CASE WHEN content_id <> '' THEN content_id END) AS n_items
FROM user_activity WHERE activity_type IN ('save', 'view')
""")
def distinct_entities(spark, sf_dir):
    """Distinct users and items among interactions."""
    return A.distinct_entities(T.user_activity(spark, sf_dir))


@query("user_summary", views=("user_profile", "saved_article"), sql="""
SELECT p.user_id, p.name, p.profession, CAST(coalesce(s.n, 0) AS BIGINT) AS saved_count
FROM user_profile p LEFT JOIN (SELECT user_id, count(*) AS n FROM saved_article GROUP BY 1) s USING (user_id)
""")
def user_summary(spark, sf_dir):
    """J11 + A16: every user with profile fields and library size."""
    p = T.user_profile(spark, sf_dir)
    users = p.select("user_id")
    return A.with_profile(users, p.select("user_id", "name", "profession"),
                          T.saved_article(spark, sf_dir)).select("user_id", "name", "profession", "saved_count")


@query("unprocessed_items", views=("content_union", "nlp_profile"), sql="""
SELECT external_id, type AS source_table FROM content_union u
WHERE NOT EXISTS (SELECT 1 FROM nlp_profile p WHERE p.external_id = u.external_id)
""")
def unprocessed_items(spark, sf_dir):
    """All content without an NLP profile (anti join; batching is the job's concern)."""
    return R.unprocessed(T.content_union(spark, sf_dir), T.nlp_profile(spark, sf_dir))


@query("hydrate", views=("saved_article", "article", "scraped_content"), sql="""
WITH sc AS (SELECT external_id, CAST(count(*) AS DOUBLE) AS score FROM saved_article GROUP BY 1),
a AS (SELECT sc.external_id, a.title, coalesce(a.abstract, '') AS abstract,
             coalesce(CAST(a.published_date AS VARCHAR), '') AS published_date,
             coalesce(a.source_name, 'Unknown') AS source, sc.score
      FROM sc JOIN article a ON sc.external_id = a.external_id),
s AS (SELECT sc.external_id, s.title, coalesce(s.abstract, ''),
             coalesce(CAST(s.published_date AS VARCHAR), ''), coalesce(s.source_name, 'Scraper'), sc.score
      FROM sc JOIN scraped_content s ON sc.external_id = s.external_id
      WHERE sc.external_id NOT IN (SELECT external_id FROM a))
SELECT * FROM a UNION ALL SELECT * FROM s
""")
def hydrate(spark, sf_dir):
    """Hydrate scored ids (save counts) from articles, then scraped content for the rest."""
    scored = (T.saved_article(spark, sf_dir).groupBy("external_id")
              .agg(F.count(F.lit(1)).cast("double").alias("score")))
    return R.hydrate(scored, T.article(spark, sf_dir), T.scraped_content(spark, sf_dir))
