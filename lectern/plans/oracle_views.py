"""DuckDB re-statements of the logical views in ``lectern.sources.tables``.

The oracle SQL of each query is ``WITH <views it needs> <query>``; the views are
written independently of the Spark code so the comparison checks both.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "content_base": r"""
  SELECT doc_id, 'doc:' || CAST(doc_id AS VARCHAR) AS external_id,
         trim(substring(text, 1, 60)) AS title, text AS abstract, lang,
         source AS source_name,
         TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) AS source_no,
         CASE WHEN doc_id % 11 = 0 THEN NULL
              ELSE CAST(DATE '2024-01-30' - CAST(doc_id * 37 % 500 AS INTEGER) AS DATE) END AS published_date,
         CASE WHEN doc_id % 3 = 0 THEN '10.5555/doc.' || CAST(doc_id AS VARCHAR) END AS doi,
         [lang, source] AS categories, n_chars
  FROM documents""",
    "article": r"""
  SELECT doc_id AS id, external_id, title, abstract,
         [{'name': 'Writer ' || CAST(doc_id % 13 AS VARCHAR), 'orcid': NULL::VARCHAR, 'institution': NULL::VARCHAR}] AS authors,
         published_date, doi, 'https://papers.example.org/' || external_id AS url,
         categories, [lang] AS keywords, CAST(n_chars % 97 AS INTEGER) AS citation_count,
         source_no AS api_source_id, source_name
  FROM content_base WHERE coalesce(source_no, 0) < 10""",
    "scraped_content": r"""
  SELECT doc_id AS id, source_no AS scraper_config_id, external_id, title, abstract,
         (['paper', 'event', 'grant', 'news'])[doc_id % 4 + 1] AS content_type,
         published_date, doi,
         'https://content.example.org/' || source_name || '/' || CAST(doc_id AS VARCHAR) AS source_url,
         categories, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 420) AS scraped_at, source_name
  FROM content_base WHERE source_no >= 10""",
    "content_union": r"""
  SELECT CAST(id AS BIGINT) AS id, external_id, title, abstract, published_date, doi, url, categories,
         citation_count, CAST(api_source_id AS BIGINT) AS source_id, source_name, 'article' AS type
  FROM article
  UNION ALL
  SELECT CAST(id + 1000000 AS BIGINT), external_id, title, abstract, published_date, doi, source_url, categories,
         0, CAST(scraper_config_id + 1000 AS BIGINT), source_name, 'scraped'
  FROM scraped_content""",
    "nlp_profile": r"""
  SELECT 'doc:' || CAST(vec_id AS VARCHAR) AS external_id, vec_id, embedding, label AS topic_id,
         'article' AS source_table
  FROM embeddings""",
    "user_profile": r"""
  SELECT c_custkey AS user_id, c_name AS name,
         CASE WHEN c_acctbal > 5000 THEN 'researcher' ELSE 'student' END AS profession,
         CASE WHEN c_custkey % 5 = 0 THEN []::VARCHAR[] ELSE [c_mktsegment] END AS interests,
         CASE WHEN c_custkey % 5 = 0 THEN []::VARCHAR[] ELSE [n_name] END AS research_areas
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "user_activity": r"""
  SELECT event_id AS id, user_id, atype AS activity_type,
         CASE WHEN atype = 'search' THEN NULL ELSE 'doc:' || CAST(k AS VARCHAR) END AS content_id,
         CASE WHEN atype = 'search' THEN
              CASE WHEN event_id % 4 = 0 THEN '  topic ' || CAST(k % 17 AS VARCHAR) || ' '
                   ELSE 'topic ' || CAST(k % 17 AS VARCHAR) END END AS query,
         ts AS created_at
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
               CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'view' WHEN 'purchase' THEN 'save'
                               WHEN 'signup' THEN 'search' WHEN 'error' THEN 'remove_save' END AS atype
        FROM events)""",
    "saved_article": r"""
  SELECT user_id, content_id AS external_id, saved_at
  FROM (SELECT user_id, content_id,
               arg_max(activity_type, struct_pack(created_at, id)) AS last_type,
               max(created_at) FILTER (WHERE activity_type = 'save') AS saved_at
        FROM user_activity
        WHERE activity_type IN ('save', 'remove_save') AND content_id IS NOT NULL
        GROUP BY user_id, content_id)
  WHERE last_type = 'save'""",
    "api_fetch_log": r"""
  SELECT event_id AS id, user_id AS api_config_id,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CAST(floor(value) AS INTEGER) AS articles_found,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value / 2) AS INTEGER) END AS articles_saved,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) - floor(value / 2) AS INTEGER) END AS articles_updated,
         CASE WHEN event_type = 'error' THEN 'error in run ' || CAST(event_id AS VARCHAR) END AS error_message,
         ts AS started_at, value AS duration_seconds
  FROM events""",
    "api_source_config": r"""
  SELECT c_custkey AS id, c_name AS name, c_acctbal >= 0 AS is_active,
         CAST((c_custkey % 4 + 1) * 6 AS INTEGER) AS fetch_interval_hours,
         30 AS rate_limit_per_minute, 500 AS rate_limit_per_hour
  FROM customer""",
    "scrape_log": r"""
  SELECT o_orderkey AS id, o_custkey AS scraper_config_id, st AS status,
         CASE WHEN st = 'failed' THEN 0 ELSE CAST(trunc(o_totalprice / 1000) AS INTEGER) END AS items_found,
         CASE WHEN st = 'failed' THEN 'timeout on order ' || CAST(o_orderkey AS VARCHAR) END AS error_message,
         o_orderdate + to_seconds(o_orderkey % 86400) AS started_at,
         o_totalprice / 10000 AS duration_seconds
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'partial' END AS st
        FROM orders)""",
    "scraper_config": r"""
  SELECT c_custkey AS id, c_name AS name, c_acctbal >= 0 AS is_active FROM customer""",
}

DEPS: dict[str, list[str]] = {
    "article": ["content_base"],
    "scraped_content": ["content_base"],
    "content_union": ["article", "scraped_content"],
    "saved_article": ["user_activity"],
}


def with_views(sql: str, *names: str) -> str:
    """Prefix `sql` with the CTEs for `names` (and their dependencies) in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
