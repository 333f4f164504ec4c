"""Logical tables of the content platform, derived from the driver's parquet tables.

Every view is a lazy DataFrame over the whole input table: no row is dropped,
sampled or capped here.  Attribute derivations (dates, flags, ids) are fixed
rules so that the DuckDB oracle can rebuild the same views in SQL
(``lectern.plans.oracle_views.VIEWS``).

Mapping (fixed rules):
  article          documents of sources src0..src9   (API-collected content)
  scraped_content  documents of sources src10..src19 (scraper-collected content)
  nlp_profile      embeddings, external_id 'doc:'+vec_id
  user_profile     customer join nation
  user_activity    events; view/click -> view, purchase -> save,
                   signup -> search, error -> remove_save; content 'doc:'+props.k
  saved_article    current saves (last of save/remove_save wins)
  api_fetch_log    events; source = user_id, failed when event_type = error
  api_source_config customer
  scrape_log       orders; scraper = o_custkey; F success, O failed, P partial
  scraper_config   customer
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

AUTHOR_T = "array<struct<name:string,orcid:string,institution:string>>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _source_no(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")


def _published(doc_id: Column) -> Column:
    d = F.date_sub(F.lit("2024-01-30").cast("date"), (doc_id * 37 % 500).cast("int"))
    return F.when(doc_id % 11 == 0, F.lit(None).cast("date")).otherwise(d)


def _content_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    return d.select(
        doc.alias("doc_id"),
        F.concat(F.lit("doc:"), doc.cast("string")).alias("external_id"),
        F.trim(F.substring("text", 1, 60)).alias("title"),
        F.col("text").alias("abstract"),
        F.col("lang"),
        F.col("source").alias("source_name"),
        _source_no(F.col("source")).alias("source_no"),
        _published(doc).alias("published_date"),
        F.when(doc % 3 == 0, F.concat(F.lit("10.5555/doc."), doc.cast("string"))).alias("doi"),
        F.array(F.col("lang"), F.col("source")).alias("categories"),
        F.col("n_chars"),
    )


def article(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _content_base(spark, sf_dir).filter(F.coalesce("source_no", F.lit(0)) < 10)
    return b.select(
        F.col("doc_id").alias("id"), "external_id", "title", "abstract",
        F.array(F.struct(
            F.concat(F.lit("Writer "), (F.col("doc_id") % 13).cast("string")).alias("name"),
            F.lit(None).cast("string").alias("orcid"),
            F.lit(None).cast("string").alias("institution"))).alias("authors"),
        "published_date", "doi",
        F.concat(F.lit("https://papers.example.org/"), F.col("external_id")).alias("url"),
        "categories",
        F.array(F.col("lang")).alias("keywords"),
        (F.col("n_chars") % 97).cast("int").alias("citation_count"),
        F.col("source_no").alias("api_source_id"),
        "source_name",
    )


def scraped_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _content_base(spark, sf_dir).filter(F.col("source_no") >= 10)
    ctype = F.element_at(F.array(*[F.lit(x) for x in ("paper", "event", "grant", "news")]),
                         (F.col("doc_id") % 4 + 1).cast("int"))
    return b.select(
        F.col("doc_id").alias("id"),
        F.col("source_no").alias("scraper_config_id"),
        "external_id", "title", "abstract",
        ctype.alias("content_type"),
        "published_date", "doi",
        F.concat(F.lit("https://content.example.org/"), F.col("source_name"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("source_url"),
        "categories",
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 420)
        .alias("scraped_at"),
        "source_name",
    )


def nlp_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("doc:"), F.col("vec_id").cast("string")).alias("external_id"),
        F.col("vec_id"),
        F.col("embedding"),
        F.col("label").alias("topic_id"),
        F.lit("article").alias("source_table"),
    )


def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    empty = F.col("c_custkey") % 5 == 0
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").alias("user_id"),
                    F.col("c_name").alias("name"),
                    F.when(F.col("c_acctbal") > 5000, "researcher").otherwise("student").alias("profession"),
                    F.when(empty, F.array().cast("array<string>"))
                    .otherwise(F.array(F.col("c_mktsegment"))).alias("interests"),
                    F.when(empty, F.array().cast("array<string>"))
                    .otherwise(F.array(F.col("n_name"))).alias("research_areas")))


_ACT = {"view": "view", "click": "view", "purchase": "save", "signup": "search", "error": "remove_save"}


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    atype = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in _ACT.items()])
    q = F.concat(F.lit("topic "), (k % 17).cast("string"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        atype.alias("activity_type"),
        F.when(atype == "search", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("doc:"), k.cast("string"))).alias("content_id"),
        F.when(atype == "search",
               F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("  "), q, F.lit(" "))).otherwise(q))
        .alias("query"),
        F.col("ts").alias("created_at"),
    )


def saved_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.activity import toggle_state
    return toggle_state(user_activity(spark, sf_dir), "save", "remove_save")


def api_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    found = F.floor("value").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("api_config_id"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        found.alias("articles_found"),
        F.when(failed, 0).otherwise(F.floor(F.col("value") / 2).cast("int")).alias("articles_saved"),
        F.when(failed, 0).otherwise((found - F.floor(F.col("value") / 2)).cast("int")).alias("articles_updated"),
        F.when(failed, F.concat(F.lit("error in run "), F.col("event_id").cast("string"))).alias("error_message"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("completed_at"),
        F.col("value").alias("duration_seconds"),
    )


def api_source_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        ((F.col("c_custkey") % 4 + 1) * 6).cast("int").alias("fetch_interval_hours"),
        F.lit(30).alias("rate_limit_per_minute"),
        F.lit(500).alias("rate_limit_per_hour"),
    )


def scrape_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    st = (F.when(F.col("o_orderstatus") == "F", "success")
          .when(F.col("o_orderstatus") == "O", "failed").otherwise("partial"))
    items = (F.col("o_totalprice") / 1000).cast("int")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("scraper_config_id"),
        st.alias("status"),
        F.when(st == "failed", 0).otherwise(items).alias("items_found"),
        F.when(st == "failed", F.concat(F.lit("timeout on order "), F.col("o_orderkey").cast("string")))
        .alias("error_message"),
        (F.col("o_orderdate") + F.make_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)")))
        .alias("started_at"),
        (F.col("o_totalprice") / 10000).alias("duration_seconds"),
    )


def scraper_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def content_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and scraped content in one shape."""
    from lectern.operators.search import union_content
    return union_content(article(spark, sf_dir), scraped_content(spark, sf_dir))
