"""Ingestion queries: landed payloads -> normalised articles -> upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import store as ST
from lectern.plans.catalog import query
from lectern.session import stored
from lectern.sources import normalizers as N
from lectern.sources import payloads as P
from lectern.sources import tables as T


@query("openalex_normalize", views=("article",), sql="""
SELECT 'openalex:W' || CAST(id AS VARCHAR) AS external_id, title, abstract, doi, published_date,
       source_name AS journal, CAST(id % 90 + 1 AS VARCHAR) || '-' || CAST(id % 90 + 9 AS VARCHAR) AS pages,
       array_to_string(categories, '|') AS categories, citation_count, authors[1].name AS first_author
FROM article
""")
def openalex_normalize(spark, sf_dir):
    """S1 + S6 + T14: OpenAlex pages landed from every article, parsed and normalised
    (abstracts rebuilt from the inverted index)."""
    landed = P.land_openalex(T.article(spark, sf_dir))
    items = P.read_json_payloads(landed, P.OPENALEX_SCHEMA, ["results"])
    a = N.normalize_openalex(items)
    return a.select("external_id", "title", "abstract", "doi", "published_date", "journal", "pages",
                    F.array_join("categories", "|").alias("categories"), "citation_count",
                    F.try_element_at("authors", F.lit(1))["name"].alias("first_author"))


@query("crossref_normalize", views=("article",), sql="""
SELECT 'crossref:' || coalesce(doi, '10.9999/x.' || CAST(id AS VARCHAR)) AS external_id, title, abstract,
       CASE WHEN id % 3 = 0 THEN CAST(date_trunc('month', published_date) AS DATE) ELSE published_date END
         AS published_date,
       source_name AS journal, array_to_string(categories, '|') AS categories, authors[1].name AS first_author
FROM article
""")
def crossref_normalize(spark, sf_dir):
    """S1 + S7: CrossRef pages (date-parts with and without day) parsed and normalised."""
    landed = P.land_crossref(T.article(spark, sf_dir))
    items = P.read_json_payloads(landed, P.CROSSREF_SCHEMA, ["message", "items"])
    a = N.normalize_crossref(items)
    return a.select("external_id", "title", "abstract", "published_date", "journal",
                    F.array_join("categories", "|").alias("categories"),
                    F.try_element_at("authors", F.lit(1))["name"].alias("first_author"))


@query("arxiv_normalize", views=("article",), sql="""
SELECT 'arxiv:' || CAST(id AS VARCHAR) || 'v1' AS external_id, published_date,
       'http://arxiv.org/pdf/' || CAST(id AS VARCHAR) || 'v1' AS pdf_url,
       array_to_string(categories, '|') AS categories, len(authors) AS n_authors
FROM article
""")
def arxiv_normalize(spark, sf_dir):
    """S2 + S5: namespaced Atom feed pages parsed with from_xml and normalised."""
    landed = P.land_arxiv(T.article(spark, sf_dir))
    items = P.read_xml_payloads(landed, "entry", P.ARXIV_ENTRY_SCHEMA)
    a = N.normalize_arxiv(items)
    return a.select("external_id", "published_date", "pdf_url",
                    F.array_join("categories", "|").alias("categories"), F.size("authors").alias("n_authors"))


_PLAIN = ("trim(regexp_replace(replace(replace(replace(replace(replace(replace("
          "regexp_replace(title, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
          "'&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\r\\n]+', ' ', 'g'))")


@query("generic_normalize", views=("article",), sql=f"""
SELECT 'https://openalex.org/W' || CAST(id AS VARCHAR) AS external_id, {_PLAIN} AS title,
       published_date, CASE WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi END AS doi, source
FROM (SELECT *, 'generic' AS source FROM article) WHERE {_PLAIN} <> ''
""")
def generic_normalize(spark, sf_dir):
    """S4 + R3 + T13: a configured source (dot-path field mapping) over the OpenAlex pages."""
    landed = P.land_openalex(T.article(spark, sf_dir))
    items = P.read_json_payloads(landed, P.OPENALEX_SCHEMA, ["results"])
    mapping = {"external_id": "id", "title": "title", "published_date": "publication_date", "doi": "doi",
               "url": "id"}
    return N.normalize(items, mapping, "generic").select("external_id", "title", "published_date", "doi",
                                                         "source")


def _batch(spark, sf_dir):
    """An incoming batch over all content: every item once, items with id % 7 = 0 twice
    (a later revision); titles revised for id % 5 = 0; articles send no abstract."""
    u = T.content_union(spark, sf_dir)
    b = u.withColumn("seq", F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 7 == 0, 2).otherwise(1))))
    title = (F.when(F.col("seq") == 2, F.concat(F.col("title"), F.lit(" [rev 2]")))
             .when(F.col("id") % 5 == 0, F.concat(F.col("title"), F.lit(" [rev 1]"))))
    return b.select("external_id", "seq", title.alias("title"),
                    F.when(F.col("type") == "scraped", F.col("abstract")).alias("abstract"),
                    "doi", "published_date")


_UPSERT_SQL = """
WITH b AS (
  SELECT external_id, seq,
         CASE WHEN seq = 2 THEN title || ' [rev 2]' WHEN id % 5 = 0 THEN title || ' [rev 1]' END AS title,
         CASE WHEN type = 'scraped' THEN abstract END AS abstract, doi, published_date
  FROM content_union, unnest(range(1, CASE WHEN id % 7 = 0 THEN 3 ELSE 2 END)) AS t(seq)),
r AS (SELECT external_id, count(*) AS n_rows,
             arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title,
             arg_max(abstract, seq) FILTER (WHERE abstract IS NOT NULL) AS abstract,
             arg_max(doi, seq) FILTER (WHERE doi IS NOT NULL) AS doi,
             arg_max(published_date, seq) FILTER (WHERE published_date IS NOT NULL) AS published_date
      FROM b GROUP BY external_id),
m AS (SELECT coalesce(o.external_id, r.external_id) AS external_id,
             coalesce(r.title, o.title) AS title,
             CASE WHEN o.external_id IS NULL THEN coalesce(r.abstract, '') ELSE coalesce(r.abstract, o.abstract) END
               AS abstract,
             coalesce(r.doi, o.doi) AS doi, coalesce(r.published_date, o.published_date) AS published_date,
             CASE WHEN o.external_id IS NULL THEN 'saved' WHEN r.external_id IS NOT NULL THEN 'updated'
                  ELSE 'unchanged' END AS op, coalesce(r.n_rows, 0) AS n_rows
      FROM (SELECT external_id, title, abstract, doi, published_date FROM article) o
      FULL JOIN r ON o.external_id = r.external_id)
"""


@query("upsert_articles", views=("article", "content_union"), sql=_UPSERT_SQL + """
SELECT external_id, title, abstract, doi, published_date, op FROM m
""")
def upsert_articles(spark, sf_dir):
    """Merge a batch over all content into the article table (not-null fields win,
    later rows win, new rows get abstract '')."""
    base = T.article(spark, sf_dir).select("external_id", "title", "abstract", "doi", "published_date")
    table, _ = ST.upsert(base, _batch(spark, sf_dir), ["external_id"], "seq", "not_null",
                         insert_defaults={"abstract": F.lit("")})
    return table


@query("upsert_counts", views=("article", "content_union"), sql=_UPSERT_SQL + """
SELECT CAST(sum(CASE WHEN op = 'saved' THEN 1 ELSE 0 END) AS BIGINT) AS saved,
       CAST(sum(CASE WHEN op = 'saved' THEN n_rows - 1 ELSE n_rows END) AS BIGINT) AS updated,
       (SELECT count(*) FROM content_union WHERE id % 13 = 0) AS skipped
FROM m
""")
def upsert_counts(spark, sf_dir):
    """Saved / updated / skipped counts of the same merge and of rows without a key (the run-log numbers)."""
    base = T.article(spark, sf_dir).select("external_id", "title", "abstract", "doi", "published_date")
    batch = _batch(spark, sf_dir)
    none = T.content_union(spark, sf_dir).filter(F.col("id") % 13 == 0)
    keyless = none.select(*[(F.when(F.col("id") % 2 == 0, F.lit("")) if c == "external_id" else F.lit(None)).cast(t).alias(c) for c, t in batch.dtypes])
    _, counts = ST.upsert(base, batch.unionByName(keyless), ["external_id"], "seq", "not_null",
                          insert_defaults={"abstract": F.lit("")})
    return counts


@query("semantic_scholar_normalize", views=("article",), sql="""
SELECT 's2:p' || CAST(id AS VARCHAR) AS external_id, title, abstract,
       CASE WHEN id % 4 <> 0 THEN published_date WHEN published_date IS NOT NULL
            THEN make_date(year(published_date), 1, 1) END AS published_date,
       url || '.pdf' AS pdf_url, citation_count, array_to_string(categories, '|') AS categories
FROM article
""")
def semantic_scholar_normalize(spark, sf_dir):
    """S1 + S8: Semantic Scholar pages (date or year only) parsed and normalised."""
    landed = P.land_semantic_scholar(T.article(spark, sf_dir))
    items = P.read_json_payloads(landed, P.SEMANTIC_SCHOLAR_SCHEMA, ["data"])
    a = N.normalize_semantic_scholar(items)
    return a.select("external_id", "title", "abstract", "published_date", "pdf_url", "citation_count",
                    F.array_join("categories", "|").alias("categories"))


def _normalized_sources(spark, sf_dir):
    """The same articles as three API sources would answer (OpenAlex, CrossRef, Semantic Scholar)."""
    arts = T.article(spark, sf_dir)
    cols = ["external_id", "title", "abstract", "authors", "published_date", "doi", "url", "keywords", "source"]
    oa = N.normalize_openalex(P.read_json_payloads(P.land_openalex(arts), P.OPENALEX_SCHEMA, ["results"]))
    cr = N.normalize_crossref(P.read_json_payloads(P.land_crossref(arts), P.CROSSREF_SCHEMA, ["message", "items"]))
    s2 = N.normalize_semantic_scholar(
        P.read_json_payloads(P.land_semantic_scholar(arts), P.SEMANTIC_SCHOLAR_SCHEMA, ["data"]))
    # behind a generator an abstract is rebuilt once, however often it is used
    oa = oa.select(*[c for c in cols if c != "abstract"], F.explode(F.array("abstract")).alias("abstract"))
    return oa.select(*cols).unionByName(cr.select(*cols)).unionByName(s2.select(*cols))


#: what interleaving and de-duplication look at
_ORDERED = ["external_id", "title", "published_date", "doi", "source"]


_LIVE_SRC = """
src AS (
  SELECT 'openalex:W' || CAST(id AS VARCHAR) AS external_id, title, abstract, authors, published_date, doi,
         'openalex' AS source FROM article
  UNION ALL
  SELECT 'crossref:' || coalesce(doi, '10.9999/x.' || CAST(id AS VARCHAR)), title, abstract, authors,
         CASE WHEN id % 3 = 0 THEN CAST(date_trunc('month', published_date) AS DATE) ELSE published_date END,
         coalesce(doi, '10.9999/x.' || CAST(id AS VARCHAR)), 'crossref' FROM article
  UNION ALL
  SELECT 's2:p' || CAST(id AS VARCHAR), title, abstract, authors,
         CASE WHEN id % 4 <> 0 THEN published_date WHEN published_date IS NOT NULL
              THEN make_date(year(published_date), 1, 1) END, NULL, 'semantic_scholar' FROM article)
"""


@query("live_search", views=("article",), sql=f"""
WITH {_LIVE_SRC},
m AS (SELECT * FROM src
      WHERE contains(lower(title), 'ent') OR contains(lower(abstract), 'ent')
         OR contains(lower(array_to_string([a.name for a in authors], ' ')), 'ent')),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_date DESC NULLS LAST, external_id) AS rn,
             coalesce(nullif(doi, ''), nullif(external_id, ''), nullif(trim(title), '')) AS dkey
      FROM m WHERE trim(title) <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY rn, source) AS r1 FROM c WHERE dkey IS NOT NULL)
SELECT external_id, source, rn, dkey FROM d WHERE r1 = 1
""")
def live_search(spark, sf_dir):
    """One query ('ent', F9) over the results of three sources: clean (F8/T8-T10),
    round-robin interleave (W1, sources in name order), de-duplicate by doi, id, title (W3).
    The order keys (rn, source) are the result order; the API's max_results is a limit on it."""
    from lectern.operators import search as S
    m = _normalized_sources(spark, sf_dir).filter(S.matches_query("ent"))
    c = stored(S.clean_live(m).select(*_ORDERED), "live")  # read twice: parsed once
    il = S.interleave(c, "source", [("published_date", False), ("external_id", True)])
    d = S.dedupe_first(il, S.dedupe_key(), [F.col("rn"), F.col("src_rank")])
    return d.select("external_id", "source", "rn", F.col("_k").alias("dkey"))


@query("live_response", views=("article",), sql=f"""
WITH {_LIVE_SRC},
hit AS (SELECT * FROM src
        WHERE contains(lower(title), 'ent') OR contains(lower(abstract), 'ent')
           OR contains(lower(array_to_string([a.name for a in authors], ' ')), 'ent')),
own AS (SELECT external_id, title, doi, published_date FROM article
        WHERE trim(title) <> '' AND (contains(lower(title), 'ent') OR contains(lower(abstract), 'ent')
           OR contains(lower(array_to_string([a.name for a in authors], ' ')), 'ent'))
        ORDER BY published_date DESC NULLS LAST, external_id LIMIT 40),
lists AS (SELECT external_id, title, doi, published_date, source, '1' || source AS src_rank FROM hit WHERE source <> 'semantic_scholar' AND trim(title) <> ''
          UNION ALL SELECT external_id, title, doi, published_date, 'stored', '0' FROM own),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_date DESC NULLS LAST, external_id) AS rn,
             coalesce(nullif(doi, ''), nullif(external_id, ''), nullif(trim(title), '')) AS dkey FROM lists),
d AS (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY rn, src_rank) AS r1 FROM c WHERE dkey IS NOT NULL),
f AS (SELECT external_id, source, row_number() OVER (ORDER BY rn, src_rank) AS pos FROM d WHERE r1 = 1)
SELECT 'article' AS part, CAST(pos AS INTEGER) AS pos, external_id, source, NULL AS note, NULL::BIGINT AS total FROM f WHERE pos <= 50
UNION ALL SELECT 'late', NULL, NULL, 'semantic_scholar', NULL, NULL
UNION ALL SELECT 'failed', NULL, NULL, 'doaj', 'HTTP 503', NULL
UNION ALL SELECT 'summary', NULL, NULL, NULL, 'partial', count(*) FROM f
""")
def live_response(spark, sf_dir):
    """M12 as answered: a search for 'ent' over own content and four sources, one of which failed and one of which is
    late (its results come, but too late); own matches first, 50 results, and the report."""
    from lectern.operators import search as S
    cols = ["external_id", "title", "abstract", "authors", "published_date", "doi", "url", "keywords", "source"]
    found = stored(S.clean_live(_normalized_sources(spark, sf_dir).filter(S.matches_query("ent"))).select(*_ORDERED), "live")
    own = T.article(spark, sf_dir).withColumn("source", F.lit(S.STORED)).withColumn("keywords", F.array().cast("array<string>"))
    own = stored(S.clean_live(own.select(*cols).filter(S.matches_query("ent"))).select(*_ORDERED), "own")
    outcomes = spark.createDataFrame([("openalex", 3.0, None), ("crossref", 45.0, ""), ("semantic_scholar", 45.5, None), ("doaj", 1.0, "HTTP 503")],
                                     "source string, seconds double, error string")
    return S.live_response(found, outcomes, own, [("published_date", False), ("external_id", True)], 50)


@query("normalizer_registry", views=("article",), sql="""
SELECT 'openalex' AS source, 'openalex:W' || CAST(id AS VARCHAR) AS external_id, title FROM article
UNION ALL SELECT 'crossref', 'crossref:' || coalesce(doi, '10.9999/x.' || CAST(id AS VARCHAR)), title FROM article
UNION ALL SELECT 'semantic_scholar', 's2:p' || CAST(id AS VARCHAR), title FROM article
UNION ALL SELECT 'core', 'core:c' || CAST(id AS VARCHAR), title FROM article
""")
def normalizer_registry(spark, sf_dir):
    """Payloads of four sources, each normalised by what is registered under its source's name."""
    arts = T.article(spark, sf_dir)
    landed = {"openalex": (P.land_openalex, P.OPENALEX_SCHEMA, ["results"]), "crossref": (P.land_crossref, P.CROSSREF_SCHEMA, ["message", "items"]),
              "semantic_scholar": (P.land_semantic_scholar, P.SEMANTIC_SCHOLAR_SCHEMA, ["data"]), "core": (P.land_core, P.CORE_SCHEMA, ["results"])}
    parts = []
    for name, (land, schema, path) in landed.items():
        rows = N.normalizer(name)(P.read_json_payloads(land(arts), schema, path))
        parts.append(rows.select(F.lit(name).alias("source"), "external_id", "title"))
    return reduce(DataFrame.unionAll, parts)


@query("source_run", views=("article",), sql="""
WITH items AS (SELECT 'openalex:W' || CAST(id AS VARCHAR) AS external_id, source_name AS source, published_date,
                      published_date IS NULL AND id % 2 = 0 AS keyless FROM article),
base AS (SELECT external_id FROM items WHERE published_date < DATE '2023-07-01'),
r AS (SELECT i.source, i.keyless, b.external_id IS NULL AS is_new FROM items i LEFT JOIN base b USING (external_id)),
c AS (SELECT source, CAST(sum(CASE WHEN is_new AND NOT keyless THEN 1 ELSE 0 END) AS BIGINT) AS articles_saved,
             CAST(sum(CASE WHEN NOT is_new THEN 1 ELSE 0 END) AS BIGINT) AS articles_updated,
             CAST(sum(CASE WHEN keyless THEN 1 ELSE 0 END) AS BIGINT) AS articles_skipped FROM r GROUP BY source)
SELECT source, articles_saved + articles_updated + articles_skipped AS articles_found, articles_saved, articles_updated, articles_skipped,
       CASE WHEN articles_skipped * 20 > articles_saved THEN 'failed' ELSE 'success' END AS status FROM c
""")
def source_run(spark, sf_dir):
    """M13 + S21: one fetch run per source over landed OpenAlex pages: parse, normalise,
    upsert into the article store (items published before 2023-07 were fetched by an
    earlier run; undated items with an even id come without a key and are skipped), and
    one run-log row per source.  A run that skips over a twentieth of what it saves has failed."""
    from lectern.operators import monitor as M
    landed = P.land_openalex(T.article(spark, sf_dir))
    items = P.read_json_payloads(landed, P.OPENALEX_SCHEMA, ["results"])
    arts = N.normalize_openalex(items.select(F.col("source").alias("landing_source"), "item"),
                                keep=("landing_source",))
    cols = ["external_id", "title", "published_date", "doi"]
    base = arts.filter(F.col("published_date") < F.lit("2023-07-01").cast("date")).select(*cols)
    even = F.regexp_extract("external_id", r"(\d+)$", 1).cast("long") % 2 == 0
    keyless = F.col("published_date").isNull() & even
    batch = arts.select(F.when(keyless, F.lit("")).otherwise(F.col("external_id")).alias("external_id"), *cols[1:],
                        "landing_source").withColumn("seq", F.lit(1))
    table, _ = ST.upsert(base, batch.drop("landing_source"), ["external_id"], "seq", "not_null")
    per_item = batch.select("external_id", F.col("landing_source").alias("source")).join(table.select("external_id", "op"), "external_id", "left")
    flag = lambda c: c.cast("int")
    per_item = per_item.select("source", flag(F.coalesce(F.col("op") == "saved", F.lit(False))).alias("saved"),
                               flag(F.coalesce(F.col("op") == "updated", F.lit(False))).alias("updated"), flag(F.col("external_id") == "").alias("skipped"))
    error = F.when(F.col("articles_skipped") * 20 > F.col("articles_saved"), F.lit("too many items without a key"))
    return M.run_log(per_item, "source", F.lit(None).cast("timestamp"), error).select(
        "source", "articles_found", "articles_saved", "articles_updated", "articles_skipped", "status")


@query("core_normalize", views=("article",), sql="""
SELECT 'core:c' || CAST(id AS VARCHAR) AS external_id, title, published_date, doi,
       CASE WHEN id % 2 = 0 THEN url || '.pdf' ELSE url END AS url, source_name AS journal,
       authors[1].name AS first_author
FROM article
""")
def core_normalize(spark, sf_dir):
    """S1 + S10: CORE pages parsed and normalised."""
    items = P.read_json_payloads(P.land_core(T.article(spark, sf_dir)), P.CORE_SCHEMA, ["results"])
    a = N.normalize_core(items)
    return a.select("external_id", "title", "published_date", "doi", "url", "journal",
                    F.try_element_at("authors", F.lit(1))["name"].alias("first_author"))


@query("doaj_normalize", views=("article",), sql="""
SELECT 'doaj:d' || CAST(id AS VARCHAR) AS external_id, title, abstract,
       CASE WHEN published_date IS NOT NULL THEN make_date(year(published_date), 1, 1) END AS published_date,
       doi, url, source_name AS journal, array_to_string(categories, '|') AS categories
FROM article
""")
def doaj_normalize(spark, sf_dir):
    """S1 + S11: DOAJ pages (bibjson, year only) parsed and normalised."""
    items = P.read_json_payloads(P.land_doaj(T.article(spark, sf_dir)), P.DOAJ_SCHEMA, ["results"])
    a = N.normalize_doaj(items)
    return a.select("external_id", "title", "abstract", "published_date", "doi", "url", "journal",
                    F.array_join("categories", "|").alias("categories"))


@query("pubmed_normalize", views=("article",), sql="""
SELECT 'pubmed:' || CAST(id AS VARCHAR) AS external_id,
       CASE WHEN id % 2 = 0 AND published_date IS NOT NULL THEN make_date(year(published_date), 1, day(published_date))
            ELSE published_date END AS published_date,
       doi, source_name AS journal, len(authors) AS n_authors, authors[1].name AS first_author
FROM article
""")
def pubmed_normalize(spark, sf_dir):
    """S2 + S9: PubMed XML pages parsed with from_xml and normalised (named months -> 1)."""
    items = P.read_xml_payloads(P.land_pubmed(T.article(spark, sf_dir)), "PubmedArticle", P.PUBMED_SCHEMA)
    a = N.normalize_pubmed(items)
    return a.select("external_id", "published_date", "doi", "journal", F.size("authors").alias("n_authors"),
                    F.try_element_at("authors", F.lit(1))["name"].alias("first_author"))


@query("rss_normalize", views=("article",), sql=f"""
SELECT external_id, {_PLAIN} AS title, published_date, url
FROM article WHERE {_PLAIN} <> ''
""")
def rss_normalize(spark, sf_dir):
    """S3 + S4: RSS feed pages read at item level and normalised by a configured mapping."""
    landed = P.land_rss(T.article(spark, sf_dir))
    items = P.read_rss_payloads(landed)
    mapping = {"external_id": "guid", "title": "title", "published_date": "pubDate", "url": "link"}
    return N.normalize(items, mapping, "rss").select("external_id", "title", "published_date", "url")
