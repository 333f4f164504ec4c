"""Streaming queries (X1-X6): each runs its Structured Streaming job over all landed
input (availableNow) and returns the table it wrote; the oracle is the batch result."""

from __future__ import annotations

from lectern.plans import monitoring  # noqa: F401  (registers api_health, whose SQL the streamed form shares)
from lectern.plans.catalog import ORACLES, query
from lectern.session import AS_OF
from lectern.sources import payloads as P
from lectern.sources import tables as T
from lectern.streaming import streams as X


@query("stream_activity", views=("user_activity",), sql="""
SELECT id, user_id, activity_type, content_id, created_at FROM user_activity
""")
def stream_activity(spark, sf_dir):
    """Activity ingestion stream (validated, de-duplicated by event id)."""
    return X.stream_activity(spark, f"{sf_dir}/events.parquet").select(
        "id", "user_id", "activity_type", "content_id", "created_at")


@query("stream_run_health", views=("api_fetch_log",), sql="""
SELECT api_config_id, time_bucket(INTERVAL 1 HOUR, started_at) AS window_start, count(*) AS runs,
       CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed
FROM api_fetch_log GROUP BY 1, 2
""")
def stream_run_health(spark, sf_dir):
    """Hourly run / failure counts per source."""
    return X.stream_run_health(spark, f"{sf_dir}/events.parquet")


@query("stream_api_health", sql=ORACLES["api_health"])
def stream_api_health(spark, sf_dir):
    """X5 with A10: health issues of all active API sources over the streamed fetch log."""
    return X.stream_api_health(spark, f"{sf_dir}/events.parquet", T.api_source_config(spark, sf_dir), AS_OF)


@query("stream_quota", views=("api_fetch_log",), sql="""
SELECT api_config_id, time_bucket(INTERVAL 1 HOUR, started_at) AS window_start, count(*) AS used,
       greatest(0, 500 - count(*)) AS remaining
FROM api_fetch_log GROUP BY 1, 2
""")
def stream_quota(spark, sf_dir):
    """X3a as a stream: hourly request usage per source."""
    return X.stream_quota(spark, f"{sf_dir}/events.parquet")


@query("stream_library", views=("saved_article",), sql="""
SELECT user_id, external_id, saved_at FROM saved_article
""")
def stream_library(spark, sf_dir):
    """Library state from micro-batches; equals the batch W8 result."""
    return X.stream_library(spark, f"{sf_dir}/events.parquet")


@query("stream_ingest", views=("article",), sql="""
SELECT 'openalex:W' || CAST(id AS VARCHAR) AS external_id, title, doi, published_date FROM article
""")
def stream_ingest(spark, sf_dir):
    """OpenAlex pages landed as text files, ingested by a file stream."""
    landing = X.work_dir(spark, "landing")
    P.land_openalex(T.article(spark, sf_dir)).select("payload").write.mode("overwrite").text(landing)
    return X.stream_ingest(spark, landing).select("external_id", "title", "doi", "published_date")


def _enrich_sql() -> str:
    from lectern.plans.textual import _profile_sql
    docs = ("(SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS external_id, trim(substring(text, 1, 60)) AS title, text AS abstract, 'article' AS kind FROM documents)")
    return f"WITH content AS {docs}, {_profile_sql('content', 'kind').strip()[5:]}"


@query("stream_enrich", views=("content_union",), sql=_enrich_sql())
def stream_enrich(spark, sf_dir):
    """Incremental enrichment of landed content files (profiles for new items only), with the vectors of the saved
    TF-IDF model that the batch applies too."""
    from lectern.plans.textual import fitted, profile_columns
    model, path = fitted(spark, T.content_union(spark, sf_dir))
    return profile_columns(X.stream_enrich(spark, f"{sf_dir}/documents.parquet", model_path=path), model)
