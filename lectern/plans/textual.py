"""Text queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.vectors import Tfidf, embedding_text
from lectern.operators import enrich as E
from lectern.operators import search as S
from lectern.operators.store import read_table, write_table
from lectern.plans.catalog import ORACLES, query
from lectern.session import ensure_checkpoint_dir
from lectern.sources import tables as T


def _q(s: str) -> str:
    return s.replace("'", "''")


def duck_clean(expr: str) -> str:
    t = f"coalesce({expr}, '')"
    t = f"regexp_replace({t}, '{_q('http' + X.NON_WS + '+|www[.]' + X.NON_WS + '+')}', '', 'g')"
    t = f"regexp_replace({t}, '{_q(X.NON_WS + '+@' + X.NON_WS + '+')}', '', 'g')"
    t = f"regexp_replace({t}, '{_q('10[.]\\p{Nd}{4,}/' + X.NON_WS + '+')}', '', 'g')"
    t = f"regexp_replace({t}, '[$][^$]+[$]', ' ', 'g')"
    t = f"regexp_replace({t}, '{_q(r'\\[a-zA-Z]+\{[^}]*\}')}', '', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    t = f"regexp_replace({t}, '{_q(X.WS + '+')}', ' ', 'g')"
    return f"trim({t})"


def duck_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{_q('^' + X.WS + '+|' + X.WS + '+$')}', '', 'g')"


def duck_words(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({expr}), '{X.WORD_SPLIT}'), "
            f"lambda x: regexp_full_match(x, '[a-z]{{3,}}'))")


def duck_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def duck_tokens(expr: str, stops: list[str]) -> str:
    return f"list_filter({duck_words(duck_clean(expr))}, lambda x: NOT list_contains({duck_list(stops)}, x))"


DOC_FULL_TEXT = "CASE WHEN coalesce(abstract, '') <> '' THEN title || '. ' || abstract ELSE title END"


@query("clean_text", sql=f"""
SELECT doc_id, {duck_clean('text')} AS cleaned FROM documents
""")
def clean_text(spark, sf_dir):
    """T1 over every document's whole text."""
    d = T.read(spark, sf_dir, "documents")
    return d.select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("tokens", sql=f"""
SELECT doc_id, len(t) AS token_count, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {duck_tokens('text', X.TOKEN_STOPS)} AS t FROM documents)
""")
def tokens(spark, sf_dir):
    """T2 over every document: stop-word-free ASCII tokens and their count."""
    d = T.read(spark, sf_dir, "documents")
    t = X.tokens(F.col("text"))
    return d.select("doc_id", F.size(t).alias("token_count"), F.array_join(t, " ").alias("tokens"))


@query("sentences", sql=f"""
SELECT doc_id, len(s) AS n_sentences, array_to_string(s, ' | ') AS sentences
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({duck_clean('text')}, '[.!?]+'),
                                                lambda x: {duck_strip('x')}), lambda x: x <> '') AS s
      FROM documents)
""")
def sentences(spark, sf_dir):
    """T3 over every document."""
    d = T.read(spark, sf_dir, "documents")
    s = X.sentences(F.col("text"))
    return d.select("doc_id", F.size(s).alias("n_sentences"), F.array_join(s, " | ").alias("sentences"))


@query("keywords", views=("content_union",), sql=f"""
WITH b AS (SELECT external_id, {duck_tokens(DOC_FULL_TEXT, X.KEYWORD_STOPS)} AS toks FROM content_union
           WHERE length({duck_strip(DOC_FULL_TEXT)}) >= 20),
b2 AS (SELECT external_id, toks, greatest(len(toks), 1) AS total FROM b),
u AS (SELECT external_id, term, 0 AS kind, min(pos) AS first_pos,
             count(*) / any_value(total) * (1.0 + least(length(term) / 10.0, 1.0)) AS raw
      FROM (SELECT external_id, total, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM b2)
      GROUP BY external_id, term),
g AS (SELECT external_id, total, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) AS bg
      FROM b2 WHERE len(toks) >= 2),
bi AS (SELECT external_id, term, 1 AS kind, min(pos) AS first_pos, count(*) * 1.5 / any_value(total) AS raw
       FROM (SELECT external_id, total, unnest(bg) AS term, generate_subscripts(bg, 1) - 1 AS pos FROM g)
       GROUP BY external_id, term),
r AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY raw DESC, kind, first_pos) AS rank
      FROM (SELECT * FROM u UNION ALL SELECT * FROM bi))
SELECT external_id, rank, term AS keyword,
       round(raw / max(raw) OVER (PARTITION BY external_id), 4) AS score
FROM r WHERE rank <= 10
""")
def keywords(spark, sf_dir):
    """T4 over all content ("title. abstract"): top-10 keywords per item."""
    u = T.content_union(spark, sf_dir).withColumn("_text", E.full_text(F.col("title"), F.col("abstract")))
    return E.keywords(u, "external_id", "_text", 10)


def _duck_orgs(expr: str) -> str:
    parts = [f"regexp_extract_all({expr}, '{_q(X.unicode_ws(p))}')" for p in X.ORG_PATTERNS]
    return f"list_transform(list_concat({', '.join(parts)}), lambda m: {duck_strip('m')})"


@query("org_entities", sql=f"""
SELECT doc_id, len(o) AS n_orgs, array_to_string(o, '|') AS organizations
FROM (SELECT doc_id, CASE WHEN length({duck_strip("coalesce(text, '')")}) < 10 THEN []::VARCHAR[]
                          ELSE {_duck_orgs('text')} END AS o FROM documents)
""")
def org_entities(spark, sf_dir):
    """T6 over every document: organisation mentions in findall order."""
    d = T.read(spark, sf_dir, "documents")
    o = X.org_entities(F.col("text"))
    return d.select("doc_id", F.size(o).alias("n_orgs"), F.array_join(o, "|").alias("organizations"))


_KWX = X._KW.replace("'", "''")
_KWS = X.unicode_ws(r"(?i)\s*keywords?\s*:\s*.+?(?:\.|$)").replace("'", "''")


@query("live_clean", views=("content_union",), sql=f"""
WITH c AS (
  SELECT id, trim(coalesce(title, '')) AS title,
         CASE WHEN coalesce(url, '') <> '' THEN url
              WHEN coalesce(doi, '') <> '' THEN 'https://doi.org/' || replace(replace(doi, 'https://doi.org/', ''), 'http://doi.org/', '')
              WHEN starts_with(coalesce(external_id, ''), 'http') THEN external_id ELSE '' END AS url,
         {duck_strip(f"regexp_replace(coalesce(abstract, ''), '{_KWS}', '', 'g')")} AS ab,
         CASE WHEN regexp_matches(coalesce(abstract, ''), '{_KWX}')
              THEN list_filter(list_transform(string_split(regexp_extract(coalesce(abstract, ''), '{_KWX}', 1), ','),
                                              lambda x: {duck_strip('x')}), lambda x: x <> '')
              ELSE []::VARCHAR[] END AS kws,
         published_date
  FROM content_union)
SELECT id, title, url, ab AS abstract,
       CASE WHEN length(ab) > 1500 THEN regexp_replace(substring(ab, 1, 1500), ' [^ ]*$', '') || '...' ELSE ab END
         AS preview,
       len(kws) AS n_inline_keywords
FROM c WHERE title <> '' AND (published_date IS NULL OR published_date <= DATE '2024-01-31') AND url <> ''
""")
def live_clean(spark, sf_dir):
    """F8 + T8-T10 over all content as live-search results: drop empty titles, future
    dates and URL-less rows; split inline keywords; the whole abstract and its T8 preview."""
    u = T.content_union(spark, sf_dir).withColumn("keywords", F.array().cast("array<string>")) \
        .withColumn("authors", F.array().cast("array<struct<name:string>>"))
    from lectern.functions.text import inline_keywords, truncate_words
    out = S.clean_live(u.withColumn("n_inline_keywords",
                                    F.size(inline_keywords(F.coalesce(F.col("abstract"), F.lit(""))))))
    return out.select("id", "title", "url", "abstract", truncate_words(F.col("abstract"), 1500).alias("preview"),
                      "n_inline_keywords")


def duck_tfidf(source: str, key: str, text: str, n: int = 384) -> str:
    """CTEs that end in `tfidf` (key, term, weight): T27 fitted on `source` and applied to it."""
    stops = "[" + ", ".join(f"'{_q(w)}'" for w in X.KEYWORD_STOPS) + "]"
    return f"""
tf_uni AS (SELECT {key}, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'),
                                     lambda w: length(w) >= 2 AND NOT list_contains({stops}, w)) AS uni FROM {source}),
tf_grams AS (SELECT {key}, list_concat(uni, list_transform(range(1, len(uni)), lambda i: uni[i] || ' ' || uni[i + 1])) AS g FROM tf_uni),
tf_each AS (SELECT {key}, unnest(g) AS term FROM tf_grams),
tf AS (SELECT {key}, term, count(*) AS c FROM tf_each GROUP BY ALL),
tf_vocab AS (SELECT term, sum(c) AS total, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term
             ORDER BY total DESC, term LIMIT {n}),
tf_raw AS (SELECT {key}, term, c * idf AS w FROM tf JOIN tf_vocab USING (term)),
tfidf AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM tf_raw)"""


_EMBED_TEXT = duck_strip("coalesce(title, '') || '. ' || coalesce(title, '') || '. ' || coalesce(abstract, '')")


def _profile_sql(source: str, table: str) -> str:
    """Profiles of `source` (external_id, title, abstract) in all their parts."""
    kw = ORACLES["keywords"]
    return f"""
WITH {duck_tfidf(source, "external_id", _EMBED_TEXT)},
vec AS (SELECT external_id, string_agg(term || ':' || CAST(CAST(round(weight * 10000) AS BIGINT) AS VARCHAR), '|' ORDER BY term) AS v FROM tfidf GROUP BY 1),
kw AS (SELECT external_id, string_agg(keyword || ':' || CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR), '|' ORDER BY rank) AS keywords FROM ({kw}) GROUP BY 1)
SELECT c.external_id, {table} AS source_table, len({duck_tokens(DOC_FULL_TEXT, X.TOKEN_STOPS)}) AS token_count, 'en' AS language, 'tfidf-384' AS embedding_model,
       coalesce(kw.keywords, '') AS keywords,
       CASE WHEN length({duck_strip(DOC_FULL_TEXT)}) < 10 THEN '' ELSE array_to_string({_duck_orgs(DOC_FULL_TEXT)}, '|') END AS organizations, coalesce(vec.v, '') AS vector
FROM {source} c LEFT JOIN kw USING (external_id) LEFT JOIN vec USING (external_id)
"""


def profile_columns(profiles, model):
    """All parts of a profile as comparable columns."""
    scaled = lambda x: F.round(x * 10000).cast("bigint").cast("string")
    terms = F.array(*[F.lit(t) for t in model.terms])
    weights = F.slice("embedding", 1, len(model.terms))
    vector = F.filter(F.zip_with(terms, weights, lambda t, w: F.when(w != 0, F.concat(t, F.lit(":"), scaled(w)))), lambda x: x.isNotNull())
    return profiles.select(
        "external_id", "source_table", "token_count", "language", "embedding_model",
        F.array_join(F.transform("keywords", lambda k: F.concat(k["keyword"], F.lit(":"), scaled(k["score"]))), "|").alias("keywords"),
        F.array_join(F.transform("entities.organizations", lambda e: e["text"]), "|").alias("organizations"), F.array_join(vector, "|").alias("vector"))


def fitted(spark, content):
    """The TF-IDF model of all content, saved and loaded again: (model, its path)."""
    path = f"{ensure_checkpoint_dir(spark)}/tfidf-{uuid.uuid4().hex}"
    Tfidf.fit(content, embedding_text(F.col("title"), F.col("abstract"))).save(spark, path)
    return Tfidf.load(spark, path), path


@query("enrich_profiles", views=("content_union",), sql=_profile_sql("content_union", "type"))
def enrich_profiles(spark, sf_dir):
    """M10 + M1 for all content: token count, keywords, entities and the TF-IDF tier's vector, all compared."""
    u = T.content_union(spark, sf_dir)
    model, _ = fitted(spark, u)
    return profile_columns(E.enrich(u, "external_id", F.col("type"), model=model), model)


@query("profile_rebuild", views=("content_union",), sql=_profile_sql("content_union", "type") + " WHERE abstract IS NOT NULL")
def profile_rebuild(spark, sf_dir):
    """A profile table made without a model (hash vectors), then rebuilt whole by the fitted model and switched to;
    a rebuild that was written after that but never switched to is not seen."""
    u = T.content_union(spark, sf_dir).where("abstract is not null")
    path = f"{ensure_checkpoint_dir(spark)}/profiles-{uuid.uuid4().hex}"
    write_table(E.enrich(u, "external_id", F.col("type")), path)
    model, _ = fitted(spark, T.content_union(spark, sf_dir))
    write_table(E.enrich(u, "external_id", F.col("type"), model=model), path)
    read_table(spark, path).limit(1).write.parquet(f"{path}/v3-never-switched-to")
    return profile_columns(read_table(spark, path), model)


# ---------------------------------------------------------------- dates and ids

from lectern.functions import dates as D  # noqa: E402
from lectern.functions.urls import record_id  # noqa: E402
from lectern.session import AS_OF  # noqa: E402

# month names of the generated test strings (language facts, in calendar order)
_MONTHS = {
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre",
           "novembre", "décembre"],
    "de": ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober",
           "november", "dezember"],
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre",
           "noviembre", "diciembre"],
}


def _spark_date_text():
    d = F.col("published_date")
    mon = F.month(d)
    foreign = F.coalesce(*[F.when(F.col("lang") == lang, F.element_at(F.array(*[F.lit(m) for m in names]), mon))
                           for lang, names in _MONTHS.items()], F.date_format(d, "MMMM"))
    k = F.col("doc_id") % 10
    days = F.datediff(F.to_date(F.lit(AS_OF)), d)
    return (F.when(d.isNull(), F.lit(""))
            .when(k == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 1, F.date_format(d, "MM/dd/yyyy"))
            .when(k == 2, F.date_format(d, "dd.MM.yyyy"))
            .when(k == 3, F.date_format(d, "MMMM d, yyyy"))
            .when(k == 4, F.concat_ws(" ", F.dayofmonth(d).cast("string"), foreign, F.year(d).cast("string")))
            .when(k == 5, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k == 6, F.date_format(d, "yyyy/MM/dd"))
            .when(k == 7, F.concat(F.lit("published "), F.year(d).cast("string")))
            .when(k == 8, F.concat(days.cast("string"), F.lit(" days ago")))
            .otherwise(F.date_format(d, "MMM d yyyy")))


def _duck_date_text() -> str:
    foreign = "CASE lang " + " ".join(
        f"WHEN '{lang}' THEN ({'[' + ', '.join(repr(m) for m in names) + ']'})[month(published_date)]"
        for lang, names in _MONTHS.items()) + " ELSE strftime(published_date, '%B') END"
    return f"""CASE WHEN published_date IS NULL THEN ''
  WHEN doc_id % 10 = 0 THEN strftime(published_date, '%Y-%m-%d')
  WHEN doc_id % 10 = 1 THEN strftime(published_date, '%m/%d/%Y')
  WHEN doc_id % 10 = 2 THEN strftime(published_date, '%d.%m.%Y')
  WHEN doc_id % 10 = 3 THEN strftime(published_date, '%B %-d, %Y')
  WHEN doc_id % 10 = 4 THEN CAST(day(published_date) AS VARCHAR) || ' ' || {foreign} || ' ' || CAST(year(published_date) AS VARCHAR)
  WHEN doc_id % 10 = 5 THEN strftime(published_date, '%Y-%m-%dT%H:%M:%SZ')
  WHEN doc_id % 10 = 6 THEN strftime(published_date, '%Y/%m/%d')
  WHEN doc_id % 10 = 7 THEN 'published ' || CAST(year(published_date) AS VARCHAR)
  WHEN doc_id % 10 = 8 THEN CAST(DATE '{AS_OF[:10]}' - published_date AS VARCHAR) || ' days ago'
  ELSE strftime(published_date, '%b %-d %Y') END"""


@query("parse_dates", views=("content_base",), sql=f"""
SELECT doc_id, {_duck_date_text()} AS date_text,
       CASE WHEN doc_id % 10 = 7 THEN make_date(year(published_date), 1, 1) ELSE published_date END AS parsed
FROM content_base
""")
def parse_dates(spark, sf_dir):
    """Every content date rendered in ten styles (ISO, US, European, English and
    foreign month names, RFC-like, year-only, 'N days ago') and parsed back."""
    d = T.read(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("date"))
        .otherwise(F.date_sub(F.lit("2024-01-30").cast("date"), (F.col("doc_id") * 37 % 500).cast("int")))
        .alias("published_date"))
    t = d.select("doc_id", _spark_date_text().alias("date_text"))
    return D.with_parsed_date(t, F.col("date_text"), "parsed")


@query("relative_dates", sql=f"""
WITH e AS (SELECT event_id, CAST(DATE '{AS_OF[:10]}' - CAST(ts AS DATE) AS BIGINT) AS d FROM events)
SELECT event_id,
       CASE event_id % 8 WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' WHEN 2 THEN CAST(d AS VARCHAR) || ' days ago'
            WHEN 3 THEN CAST(d // 7 AS VARCHAR) || ' weeks ago' WHEN 4 THEN 'bugün' WHEN 5 THEN 'dün'
            WHEN 6 THEN CAST(d AS VARCHAR) || ' gün ago' ELSE CAST(d // 30 AS VARCHAR) || ' months ago' END AS date_text,
       CAST(DATE '{AS_OF[:10]}' - CAST(CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN d
            WHEN 3 THEN (d // 7) * 7 WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN d ELSE (d // 30) * 30 END AS INTEGER)
            AS DATE) AS parsed
FROM e
""")
def relative_dates(spark, sf_dir):
    """T19 over every event: relative phrases (en/tr) resolved against as_of."""
    e = T.read(spark, sf_dir, "events")
    d = F.datediff(F.to_date(F.lit(AS_OF)), F.to_date("ts")).cast("bigint")
    k = F.col("event_id") % 8
    txt = (F.when(k == 0, "today").when(k == 1, "yesterday")
           .when(k == 2, F.concat(d.cast("string"), F.lit(" days ago")))
           .when(k == 3, F.concat(F.floor(d / 7).cast("string"), F.lit(" weeks ago")))
           .when(k == 4, "bugün").when(k == 5, "dün")
           .when(k == 6, F.concat(d.cast("string"), F.lit(" gün ago")))
           .otherwise(F.concat(F.floor(d / 30).cast("string"), F.lit(" months ago"))))
    t = e.select("event_id", txt.alias("date_text"))
    return D.with_parsed_date(t, F.col("date_text"), "parsed")


@query("record_ids", sql="""
SELECT page_id, 'web:' || substring(md5(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) || ':' || url), 1, 16)
         AS external_id
FROM pages
""")
def record_ids(spark, sf_dir):
    """Stable record id of every page (source type 'web', name = host)."""
    p = T.pages(spark, sf_dir)
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)
    return p.select("page_id", record_id(F.lit("web"), host, F.col("url")).alias("external_id"))
