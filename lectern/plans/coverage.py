"""Queries for operators that the other plans use only in part (S13, S15, S19, S21, S22, F6, F7, F12-F14,
J1, J10, T5, T7, T20, T22, T27, T31-T33, U2).  Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import dates, display, urls, vectors
from lectern.functions import text as X
from lectern.operators import enrich as E
from lectern.operators import monitor as M
from lectern.operators import pages as PG
from lectern.operators import search as S
from lectern.operators import store as ST
from lectern.plans.catalog import query
from lectern.plans.ingest import _PLAIN
from lectern.plans.textual import duck_tfidf
from lectern.session import AS_OF
from lectern.functions.text import plain_text
from lectern.sources import configured as C
from lectern.sources.xml_items import normalize_xml, xml_items
from lectern.sources import normalizers as N
from lectern.sources import tables as T


@query("valid_window", views=("content_union",), sql="""
SELECT id, external_id, published_date FROM content_union
WHERE length(trim(title)) >= 3 AND coalesce(external_id, '') <> ''
  AND (published_date IS NULL OR (published_date >= DATE '2023-03-01' AND published_date <= DATE '2023-12-31'))
""")
def valid_window(spark, sf_dir):
    """F6 + F7: valid items (title of 3+ characters, an id) of a date window; null dates pass."""
    u = S.in_window(S.valid_items(T.content_union(spark, sf_dir)), "2023-03-01", "2023-12-31")
    return u.select("id", "external_id", "published_date")


@query("profile_flags", views=("user_profile",), sql="""
WITH p AS (SELECT user_id, profession, research_areas[1] AS field_of_study,
                  list_concat(list_concat(interests, research_areas), [profession]) AS interests,
                  CASE WHEN user_id % 11 = 0 THEN true WHEN user_id % 11 = 1 THEN false END AS was FROM user_profile)
SELECT user_id, (coalesce(profession, '') <> '' AND coalesce(field_of_study, '') <> '' AND len(interests) >= 3)
       OR coalesce(was, false) AS is_profile_complete, user_id % 7 <> 0 AS is_active FROM p
""")
def profile_flags(spark, sf_dir):
    """F12 + F13: completeness of every profile (a set flag stays set), then a bulk flag over a selection."""
    p = T.user_profile(spark, sf_dir).select(
        "user_id", "profession", F.try_element_at("research_areas", F.lit(1)).alias("field_of_study"),
        F.concat("interests", "research_areas", F.array("profession")).alias("interests"),
        F.when(F.col("user_id") % 11 == 0, True).when(F.col("user_id") % 11 == 1, False).alias("is_profile_complete"),
        F.lit(True).alias("is_active"))
    p = S.set_flag(S.profile_complete(p), F.col("user_id") % 7 == 0, "is_active", False)
    return p.select("user_id", "is_profile_complete", "is_active")


@query("display_rules", views=("content_union",), sql="""
WITH d AS (SELECT u.id, u.title, CASE WHEN u.id % 5 = 0 THEN NULL WHEN u.id % 2 = 0 THEN (u.id % 1013) / 1000.0::DOUBLE
                                      ELSE (u.id % 2027) / 10.0::DOUBLE END AS score FROM content_union u)
SELECT id, CASE WHEN length(title) > 20 THEN substring(title, 1, 20) || '...' ELSE title END AS short_title,
       CAST(CASE WHEN score IS NOT NULL THEN greatest(0, least(100, floor(CASE WHEN score <= 1 THEN score * 100 ELSE score END + 0.5))) END AS INTEGER) AS match,
       CASE WHEN position(' ' IN title) > 0 THEN substring(title, 1, position(' ' IN title) - 1) ELSE title END AS first_name,
       CASE WHEN position(' ' IN title) > 0 THEN substring(title, position(' ' IN title) + 1) ELSE '' END AS last_name FROM d
""")
def display_rules(spark, sf_dir):
    """Shortened titles, match scores (fractions and percentages) and first-space splits."""
    u = T.content_union(spark, sf_dir).withColumn("score", F.when(F.col("id") % 5 == 0, F.lit(None).cast("double"))
                                                  .when(F.col("id") % 2 == 0, (F.col("id") % 1013) / F.lit(1000.0))
                                                  .otherwise((F.col("id") % 2027) / F.lit(10.0)))
    return u.select("id", S.shorten(F.col("title"), 20).alias("short_title"), display.match_score(F.col("score")).alias("match"),
                    X.split_name(F.col("title")).alias("n")).select("id", "short_title", "match", "n.*")


@query("truthy_upsert", views=("content_union",), sql="""
SELECT external_id, CASE WHEN id % 3 = 0 THEN title ELSE 'new ' || title END AS title,
       CASE WHEN id % 4 = 0 THEN citation_count ELSE citation_count + 1 END AS citation_count,
       CASE WHEN id % 5 = 0 THEN categories ELSE ['x'] END AS categories, 'updated' AS op
FROM content_union WHERE id % 6 <> 0
UNION ALL SELECT external_id, title, citation_count, categories, 'unchanged' FROM content_union WHERE id % 6 = 0
""")
def truthy_upsert(spark, sf_dir):
    """An update whose empty strings, zeros and empty lists keep the old values; rows without a key are skipped."""
    base = T.content_union(spark, sf_dir)
    cols = ["external_id", "title", "citation_count", "categories"]
    b = base.select(
        F.when(F.col("id") % 6 == 0, F.lit("")).otherwise(F.col("external_id")).alias("external_id"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("new "), "title")).alias("title"),
        F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("citation_count") + 1).alias("citation_count"),
        F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("categories"),
        F.lit(1).alias("seq"))
    table, _ = ST.upsert(base.select(*cols), b, ["external_id"], "seq", "truthy")
    return table


@query("run_logs", views=("api_fetch_log",), sql="""
WITH c AS (SELECT api_config_id, sum(articles_saved)::BIGINT AS articles_saved, sum(articles_updated)::BIGINT AS articles_updated,
                  sum(CASE WHEN status = 'failed' THEN articles_found ELSE 0 END)::BIGINT AS articles_skipped FROM api_fetch_log GROUP BY 1)
SELECT api_config_id, articles_saved, articles_updated, articles_skipped, articles_saved + articles_updated + articles_skipped AS articles_found,
       CASE WHEN articles_skipped > articles_saved THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN articles_skipped > articles_saved THEN 'skipped ' || CAST(articles_skipped AS VARCHAR) END AS error_message FROM c
""")
def run_logs(spark, sf_dir):
    """One run-log row per source from its counts; a run that skips more than it saves is an error."""
    log = T.api_fetch_log(spark, sf_dir).select(
        "api_config_id", F.col("articles_saved").alias("saved"), F.col("articles_updated").alias("updated"),
        F.when(F.col("status") == "failed", F.col("articles_found")).otherwise(0).alias("skipped"))
    error = F.when(F.col("articles_skipped") > F.col("articles_saved"), F.concat(F.lit("skipped "), F.col("articles_skipped").cast("string")))
    return M.run_log(log, "api_config_id", F.lit(AS_OF).cast("timestamp"), error).drop("started_at")


@query("log_retained", views=("api_fetch_log",), sql=f"""
SELECT id, started_at, started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAYS AS kept FROM api_fetch_log
""")
def log_retained(spark, sf_dir):
    """Every run of the log, kept or deleted by a retention of 10 days."""
    kept, gone = M.retain(T.api_fetch_log(spark, sf_dir), AS_OF, 10)
    return kept.select("id", "started_at", F.lit(True).alias("kept")).unionByName(gone.select("id", "started_at", F.lit(False).alias("kept")))


@query("faceted_browse", views=("content_union",), sql="""
WITH f AS (SELECT type, categories[1] AS lang, source_name FROM content_union
           WHERE type = 'article' AND (contains(lower(title), 'tion') OR contains(lower(abstract), 'tion')))
SELECT lang, source_name, count(*) AS n FROM f GROUP BY GROUPING SETS ((lang), (source_name), ())
""")
def faceted_browse(spark, sf_dir):
    """filter on one facet, search, and the facet counts of what is left, together."""
    u = T.content_union(spark, sf_dir).withColumn("lang", F.try_element_at("categories", F.lit(1)))
    return S.faceted_browse(u, {"type": ["article"]}, "tion", ["title", "abstract"], ["lang", "source_name"])


@query("with_source", views=("article", "scraped_content", "api_source_config", "scraper_config"), sql="""
SELECT a.external_id, 'article' AS type, c.name AS source_config, c.is_active FROM article a LEFT JOIN api_source_config c ON c.id = a.api_source_id
UNION ALL
SELECT s.external_id, 'scraped', c.name, c.is_active FROM scraped_content s LEFT JOIN scraper_config c ON c.id = s.scraper_config_id
""")
def with_source(spark, sf_dir):
    """Every article with its API source, every scraped item with its scraper (left joins)."""
    a = S.with_source(T.article(spark, sf_dir), T.api_source_config(spark, sf_dir), "api_source_id")
    s = S.with_source(T.scraped_content(spark, sf_dir), T.scraper_config(spark, sf_dir), "scraper_config_id")
    pick = lambda df, kind: df.select("external_id", F.lit(kind).alias("type"), "source_config", "is_active")
    return pick(a, "article").unionByName(pick(s, "scraped"))


@query("interest_overlap", views=("user_profile", "user_activity", "content_union"), sql="""
WITH t AS (SELECT DISTINCT a.user_id, unnest(c.categories) AS tag FROM user_activity a JOIN content_union c ON c.external_id = a.content_id
           WHERE a.activity_type = 'save'),
m AS (SELECT DISTINCT t.user_id, c.id, c.external_id, c.published_date FROM t
      JOIN (SELECT id, external_id, published_date, unnest(categories) AS tag FROM content_union) c USING (tag))
SELECT user_id, external_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published_date DESC NULLS LAST, id) AS rank FROM m) WHERE rank <= 20
""")
def interest_overlap(spark, sf_dir):
    """The 20 newest items whose tags overlap the tags a user has saved (a top-k report)."""
    u = T.content_union(spark, sf_dir)
    saved = T.user_activity(spark, sf_dir).filter(F.col("activity_type") == "save").select("user_id", F.col("content_id").alias("external_id"))
    tags = saved.distinct().join(u.select("external_id", F.explode("categories").alias("tag")), "external_id").select("user_id", "tag").distinct()
    return S.interest_overlap(u, tags, 20)


@query("keyword_merge", views=("content_union",), sql="""
WITH w AS (SELECT id, unnest(string_split(title, ' ')) AS w, generate_subscripts(string_split(title, ' '), 1) AS pos FROM content_union),
a AS (SELECT id, lower(w) AS k, max(1.0::DOUBLE / pos) AS s FROM w GROUP BY 1, 2),
b AS (SELECT id, lower(w) AS k, max(length(w) / 20.0::DOUBLE) AS s FROM w WHERE length(w) > 4 GROUP BY 1, 2),
m AS (SELECT id, k, coalesce(a.s * 0.6::DOUBLE, 0) + coalesce(b.s * 0.4::DOUBLE, 0) AS s FROM a FULL JOIN b USING (id, k))
SELECT id, rank, k AS keyword, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, k) AS rank FROM m) WHERE rank <= 10
""")
def keyword_merge(spark, sf_dir):
    """T5: two scored word lists of each title (by place, by length), merged 0.6 / 0.4 by lower-cased word."""
    w = T.content_union(spark, sf_dir).select("id", F.posexplode(F.split("title", " ")).alias("pos", "w"))
    low = F.lower("w").alias("keyword")
    a = w.groupBy("id", low).agg(F.max(F.lit(1.0) / (F.col("pos") + 1)).alias("score"))
    b = w.filter(F.length("w") > 4).groupBy("id", low).agg(F.max(F.length("w") / F.lit(20.0)).alias("score"))
    return E.merge_keyword_scores(a, b, "id", 0.6, 0.4, 10)


@query("entity_dedupe", views=("content_union",), sql="""
WITH w AS (SELECT id, unnest(string_split(title, ' ')) AS t, generate_subscripts(string_split(title, ' '), 1) - 1 AS pos FROM content_union),
l AS (SELECT *, (['PERSON', 'ORG', 'GPE', 'LOC', 'DATE'])[length(t) % 5 + 1] AS label FROM w WHERE t <> '')
SELECT id, pos, t AS text, label, CASE label WHEN 'PERSON' THEN 'persons' WHEN 'ORG' THEN 'organizations'
       WHEN 'GPE' THEN 'locations' WHEN 'LOC' THEN 'locations' ELSE 'misc' END AS category
FROM (SELECT *, row_number() OVER (PARTITION BY id, label, lower(t) ORDER BY pos) AS r FROM l) WHERE r = 1
""")
def entity_dedupe(spark, sf_dir):
    """Labelled mentions (title words, labelled by length), one per label and lower-cased text, in categories."""
    labels = F.array(*[F.lit(x) for x in ("PERSON", "ORG", "GPE", "LOC", "DATE")])
    w = T.content_union(spark, sf_dir).select("id", F.posexplode(F.split("title", " ")).alias("pos", "text")).filter(F.col("text") != "")
    return E.entity_groups(w.withColumn("label", F.get(labels, F.length("text") % 5)), "id")


@query("date_ranges", views=("content_union",), sql="""
SELECT id, published_date AS start_date, CASE WHEN id % 4 <> 1 THEN CAST(published_date + CAST(id % 90 AS INTEGER) AS DATE) END AS end_date,
       published_date IS NOT NULL AS start_valid, id % 4 <> 1 AND published_date IS NOT NULL AS end_valid FROM content_union
""")
def date_ranges(spark, sf_dir):
    """Start and end parsed from ISO and day-first texts, a fourth of the ends being no date."""
    end = F.date_add("published_date", (F.col("id") % 90).cast("int"))
    text = F.when(F.col("id") % 4 == 1, "soon").when(F.col("id") % 4 == 2, F.date_format(end, "dd MMMM yyyy")).otherwise(F.date_format(end, "yyyy-MM-dd"))
    u = T.content_union(spark, sf_dir).select("id", F.date_format("published_date", "yyyy-MM-dd").alias("a"), text.alias("b"))
    u = dates.with_parsed_date(dates.with_parsed_date(u, F.col("a"), "start_date"), F.col("b"), "end_date")
    return u.select("id", "start_date", "end_date", F.col("start_date").isNotNull().alias("start_valid"), F.col("end_date").isNotNull().alias("end_valid"))


@query("raw_ids", views=("content_union",), sql="""
SELECT id, source_name || ':' || sha256(abstract) AS raw_id FROM content_union
""")
def raw_ids(spark, sf_dir):
    """The stable fallback id of every item's raw payload."""
    return T.content_union(spark, sf_dir).select("id", urls.raw_id(F.col("source_name"), F.col("abstract")).alias("raw_id"))


@query("tfidf_vectors", views=("content_union",), sql=f"""
WITH {duck_tfidf("content_union", "id", "coalesce(abstract, '')")}
SELECT id, term, round(weight, 6) AS weight FROM tfidf
""")
def tfidf_vectors(spark, sf_dir):
    """TF-IDF vectors of all content, fitted on it: the weight of every term of every item."""
    u = T.content_union(spark, sf_dir).select("id", "abstract")
    model = vectors.Tfidf.fit(u, F.col("abstract"))
    v = model.vectors(u, F.col("abstract"), "v").select("id", F.posexplode("v").alias("k", "w")).where("w <> 0")
    terms = F.array(*[F.lit(t) for t in model.terms])
    return v.select("id", F.element_at(terms, F.col("k") + 1).alias("term"), F.round("w", 6).alias("weight"))


@query("keyword_union", views=("content_union",), sql="""
SELECT id, list_sort(list_distinct(list_concat(categories, string_split(title, ' ')))) AS keywords FROM content_union
""")
def keyword_union(spark, sf_dir):
    """The sorted union of an item's categories and its title words."""
    return T.content_union(spark, sf_dir).select("id", S.merge_keywords(F.col("categories"), F.split("title", " ")).alias("keywords"))


@query("consume_pages", sql="""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS site, page_id % 5 AS n_items FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank,
             coalesce(max(CASE WHEN n_items = 0 THEN 1 ELSE 0 END) OVER o, 0) AS ended FROM p
      WINDOW o AS (PARTITION BY site ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, coalesce(sum(n_items) OVER (PARTITION BY site ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
      FROM r WHERE ended = 0 AND n_items > 0 AND rank <= 6)
SELECT site, page_id, n_items, least(n_items, 8 - had)::BIGINT AS take FROM k WHERE had < 8
""")
def consume_pages(spark, sf_dir):
    """The pages of every site in order, until the first empty page, six pages or eight items (the crawl's stop rules)."""
    p = T.pages(spark, sf_dir).select("page_id", F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1).alias("site"),
                                      (F.col("page_id") % 5).alias("n_items"))
    return PG.consume_pages(p, "site", "page_id", "n_items", 6, 8).select("site", "page_id", "n_items", F.col("take").cast("bigint").alias("take"))


@query("alias_items", views=("content_union",), sql="""
SELECT title, abstract, published_date, 'https://site.example.org/items/' || CAST(id AS VARCHAR) AS url,
       CASE WHEN id % 3 = 0 THEN 'https://site.example.org/pdf/' || CAST(id AS VARCHAR) || '.pdf' END AS pdf_url, categories,
       CASE WHEN id % 4 = 0 THEN 'scr:' || substring(md5(title || ':' || 'https://site.example.org/items/' || CAST(id AS VARCHAR)), 1, 16)
            ELSE external_id END AS external_id
FROM content_union WHERE trim(title) <> ''
""")
def alias_items(spark, sf_dir):
    """Scraped items whose fields come under one of several names, relative links, some without an id."""
    u = T.content_union(spark, sf_dir)
    odd = F.col("id") % 2 == 1
    only = lambda c, when: F.when(when, c).otherwise(F.lit(None).cast("string"))
    day = F.date_format("published_date", "yyyy-MM-dd")
    link = F.concat(F.lit("/items/"), F.col("id").cast("string"))
    raw = u.select(
        F.when(odd, F.col("title")).otherwise(F.lit("")).alias("title"), only(F.col("title"), ~odd).alias("name"),
        only(F.col("abstract"), F.col("id") % 3 == 0).alias("abstract"), only(F.col("abstract"), F.col("id") % 3 == 1).alias("description"),
        only(F.col("abstract"), F.col("id") % 3 == 2).alias("summary"),
        only(day, odd).alias("published_date"), only(day, ~odd).alias("date"), only(link, odd).alias("url"), only(link, ~odd).alias("link"),
        only(F.concat(F.lit("../pdf/"), F.col("id").cast("string"), F.lit(".pdf")), F.col("id") % 3 == 0).alias("pdf"),
        F.col("categories").alias("tags"), only(F.col("external_id"), F.col("id") % 4 != 0).alias("external_id"))
    out = N.normalize_items(raw, F.lit("https://site.example.org/list/page1"), "scr")
    return out.select("title", "abstract", "published_date", "url", "pdf_url", "categories", "external_id")


_ALPHA = C.SourceConfig("alpha", {"external_id": "ident", "title": "meta.title", "abstract": "meta.abs", "authors": "people", "published_date": "when",
                                  "categories": "tags", "keywords": "n", "citation_count": "n", "url": "links.1.href", "journal": "missing.path"}, "string")
_BETA = C.SourceConfig("beta", {"external_id": "ident", "title": "meta.title", "abstract": "meta.abs", "authors": "people", "published_date": "when",
                                "categories": "tags", "citation_count": "n", "url": "links.0.href"}, "array")
_GAMMA = C.SourceConfig("gamma", {"external_id": "ident", "title": "meta.title", "abstract": "meta.abs", "authors": "people", "published_date": "when",
                                  "categories": "tags.t", "keywords": "links.href", "citation_count": "n", "url": "links.5.href"}, "object_array", "full")


def _payloads(u, cfg, people, when, tags, n):
    """JSON items of one configured source; every ninth is cut off and cannot be parsed."""
    s = F.struct(F.when(F.col("id") % 4 != 0, F.col("external_id")).alias("ident"),
                 F.struct(F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.col("doi").alias("abs")).alias("meta"),
                 people.alias("people"), when.alias("when"), tags.alias("tags"), n.alias("n"),
                 F.array(F.struct(F.lit("/a").alias("href")), F.struct(F.lit("/b").alias("href"))).alias("links"))
    rows = u.select("id", s.alias("s"))
    kind = rows.schema["s"].dataType
    text = F.when(F.col("id") % 9 == 0, F.substring(F.to_json("s"), 1, 20)).otherwise(F.to_json("s"))
    return C.normalize_configured(rows.select(F.from_json(text, kind).alias("item")), cfg)


@query("configured_sources", views=("content_union",), sql=f"""
WITH t AS (SELECT *, {_PLAIN} AS plain, id % 3 AS k, CASE WHEN id % 4 <> 0 THEN external_id END AS own FROM content_union WHERE id % 9 <> 0)
SELECT coalesce(own, (['alpha:', 'beta:', 'gamma:'])[k + 1]) AS external_id, plain AS title, coalesce(doi, '') AS abstract,
       (['Ann Lee|Bob Ray', 'Ann Lee|Bob Ray', 'Full|Ann Lee|Bob Ray'])[k + 1] AS authors,
       CASE WHEN k = 0 THEN published_date WHEN k = 1 AND id % 5 = 0 THEN NULL WHEN k = 1 THEN published_date
            WHEN published_date IS NOT NULL THEN make_date(year(published_date), month(published_date), 1) END AS published_date,
       CASE k WHEN 0 THEN '/b' WHEN 1 THEN '/a' END AS url, (['x|y|z', 'x|y', 'a|b|c'])[k + 1] AS categories,
       CASE k WHEN 0 THEN CAST(citation_count AS VARCHAR) WHEN 1 THEN '' ELSE '/a|/b' END AS keywords,
       CASE WHEN k = 1 THEN 0 ELSE citation_count END AS citation_count, (['alpha', 'beta', 'gamma'])[k + 1] AS source
FROM t WHERE plain <> ''
""")
def configured_sources(spark, sf_dir):
    """S4 + T13 + T15-T17: three configured sources whose payloads differ in form (author string, list and objects;
    date strings, lists and date-parts; tags as string, list and nested lists; wrong types, missing fields and items that
    cannot be parsed)."""
    u = T.content_union(spark, sf_dir)
    of = lambda k: u.filter(F.col("id") % 3 == k)
    d = F.col("published_date")
    day = F.when(F.col("id") % 2 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(d, "d/M/yyyy"))
    parts = F.when(F.col("id") % 5 == 0, F.array(F.lit(1800), F.lit(1), F.lit(1))).when(d.isNotNull(), F.array(F.year(d), F.month(d), F.day(d)))
    alpha = _payloads(of(0), _ALPHA, F.lit("Ann Lee, Bob Ray, ,"), day, F.lit("x, y,,z"), F.col("citation_count"))
    beta = _payloads(of(1), _BETA, F.array(F.lit("Ann Lee"), F.lit("Bob Ray")), parts, F.array(F.lit("x"), F.lit("y")), F.lit("many"))
    person = "array<struct<full:string,given:string,family:string,display_name:string>>"
    people = F.from_json(F.lit('[{"full":"Full"},{"full":"","given":"Ann","family":"Lee"},{"display_name":"Bob Ray"},{}]'), person)
    months = F.struct(F.when(d.isNotNull(), F.array(F.array(F.year(d), F.month(d)))).alias("date-parts"))
    tags = F.array(F.struct(F.array(F.lit("a"), F.lit("b")).alias("t")), F.struct(F.array(F.lit("c")).alias("t")))
    gamma = _payloads(of(2), _GAMMA, people, months, tags, F.col("citation_count"))
    out = alpha.unionByName(beta).unionByName(gamma)
    made = F.col("external_id").rlike("^(alpha|beta|gamma):[0-9a-f]{64}$") & (F.col("raw_data.source") == F.col("source"))
    join = lambda c: F.array_join(c, "|")
    return out.select(F.when(made, F.regexp_replace("external_id", ":.*$", ":")).otherwise(F.col("external_id")).alias("external_id"), "title", "abstract",
                      join(F.transform("authors", lambda a: a["name"])).alias("authors"), "published_date", "url",
                      join(F.col("categories")).alias("categories"), join(F.col("keywords")).alias("keywords"), "citation_count", "source")


_ATOM = C.SourceConfig("atom", {"external_id": "@id", "title": "title", "abstract": "summary", "authors": "author", "published_date": "published",
                                "categories": "category.term", "url": "link.0.@href", "pdf_url": "link.1.href", "journal": "ref.name._text", "citation_count": "n"})
_SOLR = C.SourceConfig("solr", {"external_id": "key", "title": "head.title._text", "abstract": "head.abs", "authors": "by", "published_date": "head.day",
                                "categories": "tag", "keywords": "head.title.@lang", "url": "link.@href", "citation_count": "n"}, "string", date_format="dd.MM.yyyy")


@query("xml_sources", views=("article",), sql=r"""
WITH t AS (SELECT *, trim(regexp_replace(regexp_replace(title, '[&<>]', '', 'g'), '[\r\n]+', ' ', 'g')) AS plain FROM article
           WHERE regexp_replace(title, '[&<> ]', '', 'g') <> '')
SELECT 'a' || CAST(id AS VARCHAR) AS external_id, plain AS title, coalesce(doi, '') AS abstract,
       CASE WHEN id % 3 = 0 THEN '' ELSE 'Ann|Bo Ek' END AS authors, published_date,
       CASE WHEN id % 2 = 0 THEN 'x|y' ELSE 'x' END AS categories, '' AS keywords, '/h' || CAST(id AS VARCHAR) AS url,
       CASE WHEN id % 2 = 0 THEN '/p' END AS pdf_url, 'J & K' AS journal, citation_count, 'atom' AS source
FROM t WHERE id % 40 <> 7
UNION ALL
SELECT 's' || CAST(id AS VARCHAR), plain, coalesce(doi, ''), 'Ann|Bo Ek', published_date, CASE WHEN id % 2 = 0 THEN 'x|y' ELSE 'x' END, 'en',
       '/h' || CAST(id AS VARCHAR), NULL, NULL, citation_count, 'solr' FROM t WHERE id % 40 <> 7
""")
def xml_sources(spark, sf_dir):
    """Two feed shapes of every article.  One names its items by a path whose first step is the root, so that they
    are found by its last component, with namespaces, fields that come once or more often and values in attributes; the
    other has the whole path and items of the same name elsewhere.  Every fortieth item comes alone in a payload that is cut off."""
    art = T.article(spark, sf_dir)
    art = art.select("id", F.regexp_replace("title", "[&<>]", "").alias("t"), F.coalesce("doi", F.lit("")).alias("d"), "published_date", "citation_count").where("trim(t) <> ''")
    s = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    num, twice = F.col("id").cast("string"), F.col("id") % 2 == 0
    day = lambda f: F.coalesce(F.date_format("published_date", f), F.lit(""))
    atom = s('<feed xmlns="http://a" xmlns:x="http://b"><meta><title>no item</title></meta><x:entry id="a', num, '"><title>', F.col("t"), "</title><summary>", F.col("d"), "</summary>",
             F.when(F.col("id") % 3 == 0, F.lit("<author>Solo</author>")).otherwise(F.lit("<author><name>Ann</name></author><x:author><given>Bo</given><family>Ek</family></x:author>")),
             "<published>", day("yyyy-MM-dd'T'HH:mm:ss'Z'"), '</published><category term="x"/>', F.when(twice, F.lit('<category x:term="y"/>')).otherwise(F.lit("")),
             '<link href="/h', num, '"/><link href="', F.when(twice, F.lit("/p")).otherwise(F.lit("")), '"/>', '<ref><name k="1">J &amp; K</name></ref><n>',
             F.col("citation_count").cast("string"), "</n></x:entry></feed>")
    solr = s('<r><header><doc><key>decoy</key><head><title lang="xx">decoy</title></head></doc></header><result><doc><key>s', num, '</key><head><title lang="en">', F.col("t"),
             "</title><abs>", F.col("d"), "</abs><day>", day("dd.MM.yyyy"), "</day></head><by>Ann, Bo Ek</by><tag>x</tag>", F.when(twice, F.lit("<tag>y</tag>")).otherwise(F.lit("")),
             '<link href="/h', num, '"/><n>', F.col("citation_count").cast("string"), "</n></doc></result></r>")
    cut = lambda x: F.when(F.col("id") % 40 == 7, F.substring(x, 1, 200)).otherwise(x).alias("payload")
    a = normalize_xml(xml_items(art.select(cut(atom)), "feed.entry"), _ATOM)
    b = normalize_xml(xml_items(art.select(cut(solr)), "result.doc"), _SOLR)
    joined = lambda c: F.array_join(F.col(c), "|").alias(c)
    return a.unionAll(b).select("external_id", "title", "abstract", F.array_join("authors.name", "|").alias("authors"), "published_date", joined("categories"),
                                joined("keywords"), "url", F.nullif("pdf_url", F.lit("")).alias("pdf_url"), "journal", "citation_count", "source")


@query("entity_text", views=("content_union",), sql="""
SELECT external_id, 'é é é < &lt; ♥ ¬it; &bogus; & b € ' || chr(65533) || ' ≂̸ © x 😀 ' || CAST(id AS VARCHAR) AS plain FROM content_union
""")
def entity_text(spark, sf_dir):
    """Every kind of character reference in markup: named, decimal, hexadecimal, without a semicolon, of two
    characters, doubly escaped, unknown."""
    raw = F.concat(F.lit("<b>&eacute;</b>&#233;<i> &#xE9;</i> &lt; &amp;lt; &hearts; &notit; &bogus; & b &#128; &#0; &nesim; &copy x &#x1F600;\r\n"), F.col("id").cast("string"))
    return T.content_union(spark, sf_dir).select("external_id", F.regexp_replace(plain_text(raw), " +", " ").alias("plain"))
