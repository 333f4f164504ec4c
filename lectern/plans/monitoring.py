"""Run-log, health, quota and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import monitor as M
from lectern.plans.catalog import query
from lectern.session import AS_OF, SCRAPE_AS_OF
from lectern.sources import tables as T


@query("source_run_stats", views=("scrape_log",), sql="""
SELECT scraper_config_id, total_runs, successful_runs, failed_runs, total_items,
       successful_runs / total_runs * 100 AS success_rate,
       CASE WHEN successful_runs > 0 THEN total_items / successful_runs ELSE 0.0 END AS avg_items_per_run
FROM (SELECT scraper_config_id, count(*) AS total_runs,
             CAST(sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS successful_runs,
             CAST(sum(CASE WHEN status <> 'failed' THEN 0 ELSE 1 END) AS BIGINT) AS failed_runs,
             CAST(sum(CASE WHEN status <> 'failed' THEN items_found ELSE 0 END) AS BIGINT) AS total_items
      FROM scrape_log GROUP BY scraper_config_id)
""")
def source_run_stats(spark, sf_dir):
    """A8 over the whole scrape log."""
    return M.run_stats(T.scrape_log(spark, sf_dir))


@query("success_ema", views=("scrape_log",), sql="""
SELECT scraper_config_id,
       list_reduce(list_prepend(0.0::DOUBLE, list_transform(
           list_sort(list(struct_pack(t := started_at, i := id, s := CASE WHEN status <> 'failed' THEN 1.0 ELSE 0.0 END))),
           lambda x: x.s)),
         lambda r, s: CASE WHEN s = 1.0 THEN (CASE WHEN r <> 0 THEN (r * 9 + 100) / 10 ELSE 100.0 END)
                        ELSE (CASE WHEN r <> 0 THEN r * 9 / 10 ELSE 0.0 END) END) AS success_rate
FROM scrape_log GROUP BY scraper_config_id
""")
def success_ema(spark, sf_dir):
    """Success-rate moving average per scraper, in run order, whole log."""
    return M.success_ema(T.scrape_log(spark, sf_dir))


_TOTALS = """
t AS (SELECT api_config_id,
             CAST(sum(CASE WHEN status = 'success' THEN articles_saved ELSE 0 END) AS BIGINT) AS total_fetched,
             count(*) AS total_requests, max(started_at) AS last_fetch
      FROM api_fetch_log GROUP BY api_config_id),
tot AS (SELECT c.id AS api_config_id, c.name, c.is_active, c.fetch_interval_hours,
               CAST(coalesce(t.total_fetched, 0) AS BIGINT) AS total_fetched,
               CAST(coalesce(t.total_requests, 0) AS BIGINT) AS total_requests,
               t.last_fetch, t.last_fetch + to_hours(c.fetch_interval_hours) AS next_fetch
        FROM api_source_config c LEFT JOIN t ON c.id = t.api_config_id)
"""


@query("source_totals", views=("api_fetch_log", "api_source_config"), sql=f"""
WITH {_TOTALS}
SELECT api_config_id, name, total_fetched, total_requests, last_fetch, next_fetch FROM tot
""")
def source_totals(spark, sf_dir):
    """Per API source totals over its whole fetch log."""
    return M.source_totals(T.api_fetch_log(spark, sf_dir), T.api_source_config(spark, sf_dir)).select(
        "api_config_id", "name", "total_fetched", "total_requests", "last_fetch", "next_fetch")


@query("due_sources", views=("api_fetch_log", "api_source_config"), sql=f"""
WITH {_TOTALS}
SELECT api_config_id, name FROM tot
WHERE is_active AND (last_fetch IS NULL OR TIMESTAMP '{AS_OF}' >= next_fetch)
""")
def due_sources(spark, sf_dir):
    """sources due for a fetch at as_of."""
    t = M.source_totals(T.api_fetch_log(spark, sf_dir), T.api_source_config(spark, sf_dir))
    return M.due_sources(t).select("api_config_id", "name")


@query("api_health", views=("api_fetch_log", "api_source_config"), sql=f"""
WITH {_TOTALS},
r AS (SELECT *, row_number() OVER (PARTITION BY api_config_id ORDER BY started_at DESC, id DESC) AS rn
      FROM api_fetch_log
      WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND started_at <= TIMESTAMP '{AS_OF}'),
l5 AS (SELECT api_config_id, count(*) AS n_recent,
              sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS n_failed
       FROM r WHERE rn <= 5 GROUP BY api_config_id),
s AS (SELECT tot.*, coalesce(l5.n_recent, 0) AS n_recent, l5.n_failed
      FROM tot LEFT JOIN l5 USING (api_config_id) WHERE tot.is_active)
SELECT api_config_id AS source_id, name, 'no_recent_runs' AS issue, 'warning' AS severity FROM s WHERE n_recent = 0
UNION ALL
SELECT api_config_id, name, CAST(n_failed AS VARCHAR) || '_failures_in_last_5', 'critical' FROM s WHERE n_failed >= 3
UNION ALL
SELECT api_config_id, name, 'overdue', 'warning' FROM s
WHERE n_recent > 0 AND next_fetch < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOURS
""")
def api_health(spark, sf_dir):
    """A10: health issues of all active API sources at as_of."""
    return M.api_health(T.api_source_config(spark, sf_dir), T.api_fetch_log(spark, sf_dir))


@query("scraper_health", views=("scrape_log", "scraper_config"), sql=f"""
WITH st AS (
  SELECT scraper_config_id, count(*) AS total_runs,
         sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) / count(*) * 100 AS success_rate,
         max(started_at) AS last_run,
         max(CASE WHEN status = 'failed' AND coalesce(error_message, '') <> '' THEN started_at END) AS last_error_at
  FROM scrape_log GROUP BY scraper_config_id),
c AS (SELECT sc.id AS scraper_config_id, sc.name, st.* EXCLUDE (scraper_config_id)
      FROM scraper_config sc LEFT JOIN st ON sc.id = st.scraper_config_id WHERE sc.is_active)
SELECT scraper_config_id AS scraper_id, name, 'stale' AS issue FROM c
WHERE last_run < TIMESTAMP '{SCRAPE_AS_OF}' - INTERVAL 7 DAYS
UNION ALL
SELECT scraper_config_id, name, 'low_success_rate' FROM c WHERE success_rate < 50 AND total_runs >= 5
UNION ALL
SELECT scraper_config_id, name, 'recent_error' FROM c
WHERE last_error_at >= TIMESTAMP '{SCRAPE_AS_OF}' - INTERVAL 24 HOURS
""")
def scraper_health(spark, sf_dir):
    """Health issues of all active scrapers at the scrape clock."""
    return M.scraper_health(T.scraper_config(spark, sf_dir), T.scrape_log(spark, sf_dir), SCRAPE_AS_OF)


@query("batch_summary", views=("api_fetch_log",), sql="""
SELECT CAST(started_at AS DATE) AS batch,
       CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS sources_ok,
       CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS sources_failed,
       CAST(sum(CASE WHEN status = 'success' THEN articles_saved ELSE 0 END) AS BIGINT) AS total_saved
FROM api_fetch_log GROUP BY 1
""")
def batch_summary(spark, sf_dir):
    """One summary row per daily fetch batch."""
    return M.batch_summary(T.api_fetch_log(spark, sf_dir), F.to_date("started_at"))


@query("log_retention", views=("api_fetch_log",), sql=f"""
SELECT count(*) FILTER (WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS) AS kept,
       count(*) FILTER (WHERE started_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS) AS deleted
FROM api_fetch_log
""")
def log_retention(spark, sf_dir):
    """Keep 7 days of fetch log before as_of; kept and deleted counts."""
    log = T.api_fetch_log(spark, sf_dir)
    cut = F.lit(AS_OF).cast("timestamp") - F.make_interval(days=F.lit(7))
    return log.agg(F.count(F.when(F.col("started_at") >= cut, 1)).alias("kept"),
                   F.count(F.when(F.col("started_at") < cut, 1)).alias("deleted"))


@query("quota_tumbling", views=("api_fetch_log",), sql="""
SELECT api_config_id, time_bucket(INTERVAL 1 HOUR, started_at) AS window_start, count(*) AS used,
       greatest(0, 500 - count(*)) AS remaining
FROM api_fetch_log GROUP BY 1, 2
""")
def quota_tumbling(spark, sf_dir):
    """Hourly request counts per source against the hourly limit."""
    return M.quota_tumbling(T.api_fetch_log(spark, sf_dir), "api_config_id", 500, 3600)


@query("quota_session", views=("api_fetch_log",), sql="""
WITH g AS (SELECT api_config_id, started_at,
                  CASE WHEN lag(started_at) OVER w IS NULL
                         OR started_at - lag(started_at) OVER w >= INTERVAL 3600 SECONDS THEN 1 ELSE 0 END AS brk
           FROM api_fetch_log WINDOW w AS (PARTITION BY api_config_id ORDER BY started_at)),
     s AS (SELECT *, sum(brk) OVER (PARTITION BY api_config_id ORDER BY started_at
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT api_config_id, min(started_at) AS session_start, count(*) AS used,
       greatest(0, 500 - count(*)) AS remaining
FROM s GROUP BY api_config_id, sid
""")
def quota_session(spark, sf_dir):
    """Renewing-TTL counter = session window, gap 1 h, per source."""
    return M.quota_session(T.api_fetch_log(spark, sf_dir), "api_config_id", 500, 3600)


@query("quota_sliding", views=("api_fetch_log",), sql="""
SELECT id, api_config_id, count(*) OVER (PARTITION BY api_config_id ORDER BY epoch_us(started_at)
                                         RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS used,
       greatest(0, 30 - used) AS remaining
FROM api_fetch_log
""")
def quota_sliding(spark, sf_dir):
    """Sliding last-hour request log per source at every request."""
    return M.quota_sliding(T.api_fetch_log(spark, sf_dir), "api_config_id", 30, 3600).select(
        "id", "api_config_id", "used", "remaining")


@query("nlp_coverage", views=("article", "scraped_content", "nlp_profile"), sql="""
SELECT p.n AS nlp_processed, a.n + s.n AS total_content, greatest(0, a.n + s.n - p.n) AS unprocessed,
       CASE WHEN a.n + s.n > 0 THEN round(p.n / (a.n + s.n) * 100, 1) ELSE 0.0 END AS coverage
FROM (SELECT count(*) AS n FROM article) a, (SELECT count(*) AS n FROM scraped_content) s,
     (SELECT count(*) AS n FROM nlp_profile) p
""")
def nlp_coverage(spark, sf_dir):
    """NLP coverage of all content."""
    return M.nlp_coverage(T.article(spark, sf_dir), T.scraped_content(spark, sf_dir),
                          T.nlp_profile(spark, sf_dir))


@query("source_rate_bands", views=("scrape_log",), sql="""
SELECT scraper_config_id, success_rate,
       CASE WHEN success_rate >= 90 THEN 'good' WHEN success_rate >= 70 THEN 'warning' ELSE 'poor' END AS band
FROM (SELECT scraper_config_id,
             sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) / count(*) * 100 AS success_rate
      FROM scrape_log GROUP BY 1)
""")
def source_rate_bands(spark, sf_dir):
    """A8 + T34: success rate and display band of every scraper."""
    from lectern.functions.display import rate_band
    st = M.run_stats(T.scrape_log(spark, sf_dir))
    return st.select("scraper_config_id", "success_rate", rate_band(F.col("success_rate")).alias("band"))
