"""Page queries (S12, S14, S16, A14, T28, T29) over the whole `pages` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import WS
from lectern.operators import pages as PG
from lectern.plans.catalog import query
from lectern.session import stored
from lectern.sources import tables as T


def _q(s: str) -> str:
    return s.replace("'", "''")


def duck_unescape(expr: str) -> str:
    for k, v in PG.ENTITIES:
        expr = f"replace({expr}, '{_q(k)}', '{_q(v)}')"
    return expr


def duck_text_of(expr: str) -> str:
    t = f"regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g')"
    t = duck_unescape(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


#: content of the first paragraph: a paragraph ends where the next one opens, too
FIRST_P = "regexp_extract_all(blk, '(?s)<p\\b[^>]*>(.*?)(?:</p>|<p\\b|$)', 1)[1]"


@query("page_items", sql=f"""
WITH b AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<article\\b[^>]*>(.*?)</article>', 1)) AS blk,
                  generate_subscripts(regexp_extract_all(html, '(?s)<article\\b[^>]*>(.*?)</article>', 1), 1) - 1
                    AS item_index
           FROM pages)
SELECT page_id, item_index,
       {duck_text_of("regexp_extract_all(blk, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1)[1]")} AS title,
       {duck_text_of(FIRST_P)} AS abstract,
       len(regexp_extract_all(blk, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS n_links
FROM b
""")
def page_items(spark, sf_dir):
    """Items of every page: <article> containers, title = first h1, abstract = first p,
    all link targets (absolute)."""
    items = PG.extract_items(T.pages(spark, sf_dir), ("article", None),
                             {"title": ("h1", None, False), "abstract": ("p", None, False),
                              "links": ("a", "href", True)})
    return items.select("page_id", "item_index", "title", "abstract", F.size("links").alias("n_links"))


@query("container_candidates", sql="""
WITH c AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<body\\b[^>]*>(.*)</body>', 1),
                                                     '<\\w+\\b[^>]*\\bclass="([^"]*)"', 1)) AS c FROM pages),
n AS (SELECT page_id, replace(trim(regexp_replace(c, '\\s+', ' ', 'g')), ' ', '.') AS cls FROM c)
SELECT page_id, cls, count(*) AS n, '.' || cls AS selector FROM n WHERE cls <> ''
GROUP BY page_id, cls HAVING count(*) BETWEEN 3 AND 60
""")
def container_candidates(spark, sf_dir):
    """Repeating class combinations (3..60 per page) of every page."""
    return PG.container_candidates(T.pages(spark, sf_dir))


def _duck_body_len() -> str:
    body = "regexp_replace(regexp_extract(html, '(?s)<body\\b[^>]*>(.*)</body>', 1), '(?s)<!--.*?-->', '', 'g')"
    node = f"regexp_replace({duck_unescape('s')}, '^{WS}+|{WS}+$', '', 'g')"
    return f"length(array_to_string(list_transform(string_split_regex({body}, '<[^>]+>'), lambda s: {node}), ''))"


_MARK = " OR ".join(f"contains(html, '{_q(m)}')" for m in PG.SPA_MARKERS)


@query("page_render_check", sql=f"""
SELECT page_id, bl AS body_text_len,
       CASE WHEN bl < 200 OR {_MARK} THEN 'script_rendered' ELSE 'static' END AS render_class
FROM (SELECT page_id, html, {_duck_body_len()} AS bl FROM pages)
""")
def page_render_check(spark, sf_dir):
    """Static vs script-rendered classification of every page."""
    p = T.pages(spark, sf_dir)
    return p.select("page_id", PG.body_text_length(F.col("html")).alias("body_text_len"),
                    PG.render_class(F.col("html")).alias("render_class"))


def _duck_is_next() -> str:
    inner = duck_text_of("regexp_extract(e, '(?s)^<[^>]*>(.*)</\\w+>$', 1)")
    cls = "regexp_extract(e, '^<[^>]*\\bclass=\"([^\"]*)\"', 1)"
    aria = "regexp_extract(e, '^<[^>]*\\baria-label=\"([^\"]*)\"', 1)"
    conds = []
    for w in PG.NEXT_WORDS:
        conds += [f"contains({inner}, '{_q(w)}')", f"contains({cls}, '{_q(w)}')", f"contains({aria}, '{_q(w)}')"]
    return " OR ".join(conds)


@query("pagination_detect", sql=f"""
WITH e AS (SELECT page_id, url,
                  list_bool_or(list_transform(
                      regexp_extract_all(html, '(?s)<(?:a|button)\\b[^>]*>.*?</(?:a|button)>'),
                      lambda e: {_duck_is_next()})) AS has_next
           FROM pages)
SELECT page_id,
       CASE WHEN coalesce(has_next, false) THEN 'NEXT_BUTTON'
            WHEN contains(url, 'page=') OR contains(url, 'p=') THEN 'QUERY_PARAM' ELSE 'NONE' END AS type,
       CASE WHEN coalesce(has_next, false) THEN ''
            WHEN contains(url, 'page=') OR contains(url, 'p=')
              THEN regexp_replace(url, '^(.*?[?&](?:page|p)=)\\d+', '\\1{{page}}') ELSE '' END AS template
FROM e
""")
def pagination_detect(spark, sf_dir):
    """How to reach the next page of every page."""
    p = T.pages(spark, sf_dir)
    r = PG.pagination(F.col("url"), F.col("html"))
    return p.select("page_id", r["type"].alias("type"), r["template"].alias("template"))


@query("page_frontier", sql="""
SELECT page_id, page_no, replace(tpl, '{page}', CAST(page_no AS VARCHAR)) AS page_url
FROM (SELECT page_id, regexp_replace(url, '^(.*?[?&](?:page|p)=)\\d+', '\\1{page}') AS tpl FROM pages
      WHERE regexp_matches(url, '[?&](page|p)=\\d+')), range(1, 6) AS t(page_no)
""")
def page_frontier(spark, sf_dir):
    """Pages 1..5 of every paginated URL, from its {page} template."""
    p = T.pages(spark, sf_dir).filter(F.col("url").rlike(r"[?&](page|p)=\d+"))
    cfg = p.select("page_id", F.regexp_replace("url", r"^(.*?[?&](?:page|p)=)\d+", "$1{page}").alias("tpl"))
    return PG.page_frontier(cfg, "tpl", 5).select("page_id", "page_no", "page_url")


@query("crawl_two_stage", sql="""
WITH l AS (SELECT page_id, url AS list_url, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href,
                  generate_subscripts(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1), 1) - 1 AS pos
           FROM pages),
a AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
                     WHEN starts_with(href, '//') THEN regexp_extract(list_url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) || ':' || href
                     WHEN starts_with(href, '/') THEN regexp_extract(list_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href
                     ELSE NULL END AS detail_url FROM l),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, detail_url ORDER BY pos) AS r1 FROM a),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS step_rank FROM d WHERE r1 = 1)
SELECT s.page_id, s.step_rank, s.detail_url, p.page_id IS NOT NULL AS landed
FROM s LEFT JOIN (SELECT DISTINCT url AS page_id, url FROM pages) p ON p.url = s.detail_url
""")
def crawl_two_stage(spark, sf_dir):
    """Every page as a list page: all its links, absolute and de-duplicated, matched to the
    landed pages (unmatched = the error list)."""
    p = T.pages(spark, sf_dir)
    links = PG.discover_links(p, "a")
    landed = p.select(F.col("url").alias("detail_url"), F.lit(True).alias("landed")).dropDuplicates(["detail_url"])
    return (links.join(landed, "detail_url", "left")
            .select("page_id", "step_rank", "detail_url", F.coalesce("landed", F.lit(False)).alias("landed")))


_LANDED = """
l AS (SELECT page_id, url AS list_url, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href,
             generate_subscripts(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1), 1) AS pos FROM pages),
a AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
                     WHEN starts_with(href, '//') THEN regexp_extract(list_url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) || ':' || href
                     WHEN starts_with(href, '/') THEN regexp_extract(list_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href END AS detail_url FROM l),
s AS (SELECT page_id, detail_url, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS step_rank FROM a GROUP BY page_id, detail_url),
d AS (SELECT detail_url AS url, arg_min(p.html, p.page_id) AS html, min(p.page_id) AS page_id FROM s JOIN pages p USING (page_id) WHERE step_rank = 1 GROUP BY 1),
landed AS (SELECT url, CASE WHEN page_id % 7 = 0 THEN substring(html, 1, 40) WHEN page_id % 11 <> 0 THEN html END AS html FROM d)"""


@query("crawl_details", sql=f"""
WITH {_LANDED},
b AS (SELECT url, regexp_extract_all(html, '(?s)<article\\b[^>]*>(.*?)</article>', 1) AS blks FROM landed),
i AS (SELECT url, unnest(blks) AS blk, generate_subscripts(blks, 1) - 1 AS item_index FROM b)
SELECT s.page_id, s.step_rank, s.detail_url, CAST(i.item_index AS INTEGER) AS item_index,
       CASE WHEN i.url IS NOT NULL THEN {duck_text_of("regexp_extract_all(blk, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1)[1]")} END AS title,
       CASE WHEN i.url IS NOT NULL THEN {duck_text_of(FIRST_P)} END AS abstract,
       len(regexp_extract_all(blk, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS n_links,
       CASE WHEN landed.url IS NULL THEN 'not landed' WHEN i.url IS NULL THEN 'no items' END AS error
FROM s LEFT JOIN landed ON landed.url = s.detail_url LEFT JOIN i ON i.url = s.detail_url
""")
def crawl_details(spark, sf_dir):
    """S16, both stages: every page as a list page; the page behind each of its links read into items, or the error.
    The first link of a page has been landed (as that page itself); every seventh of these is cut short and every
    eleventh empty."""
    p = T.pages(spark, sf_dir)
    links = stored(PG.discover_links(p), "links")
    first = links.where("step_rank = 1").join(p.select("page_id", "html"), "page_id")
    first = first.groupBy(F.col("detail_url").alias("url")).agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("n"))
    html = F.when(F.col("n") % 7 == 0, F.substring("html", 1, 40)).when(F.col("n") % 11 != 0, F.col("html"))
    out = PG.crawl_details(links, first.select("url", html.alias("html")), ("article", None),
                           {"title": ("h1", None, False), "abstract": ("p", None, False), "links": ("a", "href", True)})
    return out.select("page_id", "step_rank", "detail_url", "item_index", "title", "abstract", F.when(F.col("error").isNull(), F.size("links")).alias("n_links"), "error")


@query("frontier_queries", sql="""
WITH c AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS site, page_id % 3 AS k,
                  (['deep learning', 'a&b', ''])[page_id % 3 + 1] AS q, (['deep%20learning', 'a%26b', ''])[page_id % 3 + 1] AS code,
                  CASE WHEN page_id % 5 <> 0 THEN 'cat' || CAST(page_id % 5 AS VARCHAR) END AS category FROM pages),
t AS (SELECT *, page_id % 4 AS form FROM c)
SELECT page_id, page_no, CASE form
    WHEN 0 THEN 'https://' || site || '/find/' || code || '/' || CAST(page_no AS VARCHAR)
    WHEN 1 THEN 'https://' || site || '/' || coalesce(category, '') || '?page=' || CAST(page_no AS VARCHAR) || CASE WHEN q <> '' THEN '&q=' || code ELSE '' END
    WHEN 2 THEN 'https://' || site || '/list' || CASE WHEN q <> '' THEN '?q=' || code ELSE '' END
    ELSE 'https://' || site || '/' || coalesce(category, '') || '/' || code END AS page_url
FROM t, range(1, 4) AS r(page_no)
""")
def frontier_queries(spark, sf_dir):
    """{page}, {query} and {category} templates of every page's site, and queries that a template has no place for (q=)."""
    host = F.concat(F.lit("https://"), F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    forms = F.array(*[F.lit(x) for x in ("/find/{query}/{page}", "/{category}?page={page}", "/list", "/{category}/{query}")])
    asked = F.array(F.lit("deep learning"), F.lit("a&b"), F.lit(""))
    at = lambda a, n: F.element_at(a, (F.col("page_id") % n + 1).cast("int"))
    cfg = T.pages(spark, sf_dir).select(
        "page_id", F.concat(host, at(forms, 4)).alias("tpl"), at(asked, 3).alias("q"),
        F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("cat"), (F.col("page_id") % 5).cast("string"))).alias("category"))
    return PG.page_frontier(cfg, "tpl", 3, F.col("q")).select("page_id", "page_no", "page_url")


@query("category_crawl", sql="""
WITH l AS (SELECT page_id, url AS list_url,
                  unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href,
                  generate_subscripts(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1), 1) - 1 AS pos
           FROM pages),
a AS (SELECT *, regexp_extract(list_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href AS category
      FROM l WHERE regexp_matches(href, '^/[A-Za-z]')),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, category ORDER BY pos) AS r1 FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS cat_rank FROM d WHERE r1 = 1),
f AS (SELECT page_id, category, cat_rank, page_no, category || '?page=' || CAST(page_no AS VARCHAR) AS page_url
      FROM c, range(1, 5) AS t(page_no)),
landed AS (SELECT DISTINCT category || '?page=' || CAST(n AS VARCHAR) AS url FROM c, range(1, 5) AS t(n) WHERE n <> page_id % 4),
g AS (SELECT f.*, l.url IS NOT NULL AS got FROM f LEFT JOIN landed l ON l.url = f.page_url)
SELECT page_id, category, cat_rank, page_no, page_url,
       bool_and(got) OVER (PARTITION BY page_id, category ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS consumed FROM g
""")
def category_crawl(spark, sf_dir):
    """Every page as a category page: all its category links (relative links starting with a
    letter), pages 1..4 of each, consumed until the first page that was not landed.  Of a
    category found on page p, every page but number p % 4 was landed."""
    p = T.pages(spark, sf_dir)
    links = PG.discover_links(p.withColumn("html", F.regexp_replace("html", r'<a\b[^>]*\bhref="(?!/[A-Za-z])[^"]*"', "<a>")), "a")
    landed = links.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"), "page_id", "detail_url").filter(F.col("n") != F.col("page_id") % 4)
    landed = landed.select(F.concat("detail_url", F.lit("?page="), F.col("n").cast("string")).alias("url"))
    return PG.category_crawl(p, landed, r"^/[A-Za-z]", 4)
