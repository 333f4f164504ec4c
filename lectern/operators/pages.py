"""Web pages as a table.

Items are found by balanced tags (`markup`, one Arrow-batched pass over a page) with a
tag/class subset of selectors and the next-sibling step (a general CSS engine is out of
scope); everything else is Catalyst regular expressions over the `pages` table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions.text import WS, strip_ws
from lectern.functions.urls import absolute_url
from lectern.operators.markup import Selector, items

# ---- fixed values that must equal the reference ----
SPA_MARKERS = ["ng-app", "data-critters-container", "__next", "__nuxt", "data-reactroot", 'id="app"']
NEXT_WORDS = ["Next", "Sonraki", ">", "»", "arrow-right"]
LAZY_IMAGE_ATTRS = ["data-src", "data-lazy-src", "data-original", "src"]
MIN_BODY_TEXT = 200
CONTAINER_MIN, CONTAINER_MAX = 3, 60
# ---- end of fixed values ----

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for k, v in ENTITIES:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def text_of(fragment: Column) -> Column:
    """Element text: tags removed, entities decoded, whitespace collapsed, stripped."""
    t = F.regexp_replace(fragment, r"(?s)<!--.*?-->", "")
    t = unescape(F.regexp_replace(t, r"<[^>]+>", " "))
    return strip_ws(F.regexp_replace(t, f"{WS}+", " "))


def extract_items(pages: DataFrame, container: tuple[str, str | None],
                  fields: dict[str, tuple[str, str | None, bool]], base_url: Column | None = None) -> DataFrame:
    """One row per container element of every page, nested ones included, in document order.

    container: (tag, class or None).  fields: name -> (selector, attribute or None for text, multi); a selector is a
    tag, `.class` or `tag.class`, and with a leading `+` it looks in the container's next sibling element instead.  A
    field's value is the first (or, multi, every) matching element; `img` fields take the first present of data-src,
    data-lazy-src, data-original, src; `href`/`src` values are made absolute against the page URL (T23).  Elements
    are found by balanced tags (`markup`), one pass over each page.
    """
    selectors = [(Selector.of(s), LAZY_IMAGE_ATTRS if Selector.of(s).tag == "img" and a else [a] if a else None, multi) for s, a, multi in fields.values()]
    inside = Selector.of(f"{container[0]}.{container[1]}" if container[1] else container[0])

    @F.pandas_udf("array<array<array<string>>>")
    def found(html: pd.Series) -> pd.Series:
        return pd.Series([items(h, inside, selectors) if h else [] for h in html])

    rows = pages.select("page_id", "url", F.posexplode(found("html")).alias("item_index", "_item"))
    base = base_url if base_url is not None else F.col("url")
    cols = [F.col("page_id"), F.col("url"), F.col("item_index")]
    for k, (name, (_, attr, multi)) in enumerate(fields.items()):
        vals = F.col("_item")[k]
        if attr is None:
            vals = F.transform(vals, text_of)
        elif attr in ("href", "src"):
            vals = F.transform(vals, lambda v: absolute_url(base, unescape(v)))
        else:
            vals = F.transform(vals, unescape)
        cols.append(vals.alias(name) if multi else F.try_element_at(vals, F.lit(1)).alias(name))
    return rows.select(*cols)


def body_text_length(html: Column) -> Column:
    """T28 input: length of the body's text nodes, each stripped, joined without separator
    (comments dropped, script/style text counted, entities decoded)."""
    body = F.regexp_extract(html, r"(?s)<body\b[^>]*>(.*)</body>", 1)
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    nodes = F.transform(F.split(body, "<[^>]+>"), lambda s: strip_ws(unescape(s)))
    return F.length(F.array_join(nodes, ""))


def render_class(html: Column) -> Column:
    """T28: 'script_rendered' when the body text is short or a framework marker occurs."""
    marker = F.lit(False)
    for m in SPA_MARKERS:
        marker = marker | F.contains(html, F.lit(m))
    return F.when((body_text_length(html) < MIN_BODY_TEXT) | marker, "script_rendered").otherwise("static")


def pagination(url: Column, html: Column) -> Column:
    """NEXT_BUTTON when a link/button text, class or aria-label holds a next word;
    else QUERY_PARAM with a {page} template when the URL has page= or p=; else NONE."""
    els = F.regexp_extract_all(html, F.lit(r"(?s)<(?:a|button)\b[^>]*>.*?</(?:a|button)>"), 0)

    def is_next(e: Column) -> Column:
        inner = text_of(F.regexp_extract(e, r"(?s)^<[^>]*>(.*)</\w+>$", 1))
        cls = F.regexp_extract(e, r"^<[^>]*\bclass=\"([^\"]*)\"", 1)
        aria = F.regexp_extract(e, r"^<[^>]*\baria-label=\"([^\"]*)\"", 1)
        out = F.lit(False)
        for w in NEXT_WORDS:
            out = out | F.contains(inner, F.lit(w)) | F.contains(cls, F.lit(w)) | F.contains(aria, F.lit(w))
        return out

    has_next = F.exists(els, is_next)
    param = F.contains(url, F.lit("page=")) | F.contains(url, F.lit("p="))
    template = F.regexp_replace(url, r"^(.*?[?&](?:page|p)=)\d+", "$1{page}")
    return (F.when(has_next, F.struct(F.lit("NEXT_BUTTON").alias("type"), F.lit("").alias("template")))
            .when(param, F.struct(F.lit("QUERY_PARAM").alias("type"), template.alias("template")))
            .otherwise(F.struct(F.lit("NONE").alias("type"), F.lit("").alias("template"))))


def container_candidates(pages: DataFrame, lo: int = CONTAINER_MIN, hi: int = CONTAINER_MAX) -> DataFrame:
    """Per page, class combinations of body elements seen lo..hi times."""
    body = F.regexp_extract(F.col("html"), r"(?s)<body\b[^>]*>(.*)</body>", 1)
    cls = F.regexp_extract_all(body, F.lit(r"<\w+\b[^>]*\bclass=\"([^\"]*)\""), 1)
    e = pages.select("page_id", F.explode(cls).alias("c"))
    e = e.select("page_id", F.regexp_replace(F.trim(F.regexp_replace("c", r"\s+", " ")), " ", ".").alias("cls"))
    g = e.filter(F.col("cls") != "").groupBy("page_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    return g.filter((F.col("n") >= lo) & (F.col("n") <= hi)).withColumn("selector", F.concat(F.lit("."), "cls"))


def page_frontier(cfg: DataFrame, template_col: str, max_pages: Column | int, query: Column | str = "") -> DataFrame:
    """Expand {page} (1..max_pages), {query} (percent-encoded) and {category} templates; a query that the template
    has no place for is added as q=."""
    mp = F.lit(max_pages) if isinstance(max_pages, int) else max_pages
    out = cfg.withColumn("page_no", F.explode(F.sequence(F.lit(1), mp)))
    asked = F.lit(query) if isinstance(query, str) else query
    code = F.replace(F.url_encode(asked), F.lit("+"), F.lit("%20"))
    tpl = F.col(template_col)
    added = F.concat(tpl, F.when(tpl.contains("?"), F.lit("&q=")).otherwise(F.lit("?q=")), code)
    url = F.when(tpl.contains("{query}"), F.replace(tpl, F.lit("{query}"), code)).when(asked != "", added).otherwise(tpl)
    url = F.replace(url, F.lit("{page}"), F.col("page_no").cast("string"))
    if "category" in cfg.columns:
        url = F.replace(url, F.lit("{category}"), F.coalesce(F.col("category"), F.lit("")))
    return out.withColumn("page_url", url)


def consume_pages(page_items: DataFrame, key: str, page_no: str, n_items: str, max_pages: int,
                  max_results: int | None, stop_when_empty: bool = True) -> DataFrame:
    """Pages in order per source; stop at the first empty page, at most max_pages
    pages and max_results items.  Running windows per source (no collect)."""
    w = Window.partitionBy(key).orderBy(page_no)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = page_items.withColumn("_rank", F.row_number().over(w))
    if stop_when_empty:
        df = df.withColumn("_empty_before", F.coalesce(F.max((F.col(n_items) == 0).cast("int")).over(before), F.lit(0)))
        df = df.filter((F.col("_empty_before") == 0) & (F.col(n_items) > 0))
    df = df.filter(F.col("_rank") <= max_pages)
    if max_results is not None:
        df = (df.withColumn("_items_before", F.coalesce(F.sum(n_items).over(before), F.lit(0)))
              .filter(F.col("_items_before") < max_results)
              .withColumn("take", F.least(F.col(n_items), F.lit(max_results) - F.col("_items_before"))))
    else:
        df = df.withColumn("take", F.col(n_items))
    return df.drop("_rank", "_empty_before", "_items_before")


def discover_links(pages: DataFrame, link_tag: str = "a", max_pages_per_step: int | None = None) -> DataFrame:
    """S16 step 1: links of each list page made absolute, order-preserving dedupe; all of
    them, or with max_pages_per_step that many less one (the list page counts as one)."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(rf"<{link_tag}\b[^>]*\bhref=\"([^\"]*)\""), 1)
    links = pages.select(F.col("page_id"), F.col("url").alias("list_url"),
                         F.posexplode(hrefs).alias("pos", "href"))
    links = links.withColumn("detail_url", absolute_url(F.col("list_url"), unescape(F.col("href"))))
    w1 = Window.partitionBy("page_id", "detail_url").orderBy("pos")
    first = links.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") == 1)
    w2 = Window.partitionBy("page_id").orderBy("pos")
    ranked = first.withColumn("step_rank", F.row_number().over(w2))
    if max_pages_per_step is not None:
        ranked = ranked.filter(F.col("step_rank") <= max_pages_per_step - 1)
    return ranked.select("page_id", "list_url", "detail_url", "step_rank")


def crawl_details(links: DataFrame, landed: DataFrame, container: tuple[str, str | None],
                  fields: dict[str, tuple[str, str | None, bool]]) -> DataFrame:
    """S16 step 2: the items of the detail page behind every discovered link (`discover_links`), in one pass over the
    landed pages (url, html); what could not be had comes as a row with an error instead of an item: `not landed`, or
    `no items` where the page is empty or broken.

    Only pages that some link names are read into items, each once however many links name it.
    """
    asked = links.select("detail_url").distinct()
    found = landed.join(asked, landed["url"] == asked["detail_url"], "left_semi").dropDuplicates(["url"])
    got = extract_items(found.select(F.col("url").alias("page_id"), "url", "html"), container, fields).drop("page_id")
    pages = found.select(F.col("url").alias("_page")).join(got, F.col("_page") == F.col("url"), "left").drop("url")
    out = links.join(pages, F.col("detail_url") == F.col("_page"), "left")
    error = F.when(F.col("_page").isNull(), "not landed").when(F.col("item_index").isNull(), "no items")
    return out.withColumn("error", error).drop("_page")


def category_crawl(category_pages: DataFrame, landed: DataFrame, link_pattern: str,
                   max_pages: int, limit_categories: int | None = None) -> DataFrame:
    """Category links of each category page (all, or the first `limit_categories`, in page
    order, de-duplicated), each expanded to pages 1..max_pages (S14) and matched to the landed
    pages; consumption stops at a category's first page that was not landed (S15)."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r"<a\b[^>]*\bhref=\"([^\"]*)\""), 1)
    links = (category_pages.select("page_id", F.col("url").alias("list_url"), F.posexplode(hrefs).alias("pos", "href"))
             .filter(F.col("href").rlike(link_pattern))
             .withColumn("category", absolute_url(F.col("list_url"), unescape(F.col("href")))))
    w1 = Window.partitionBy("page_id", "category").orderBy("pos")
    w2 = Window.partitionBy("page_id").orderBy("pos")
    cats = (links.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") == 1)
            .withColumn("cat_rank", F.row_number().over(w2))
            .filter(F.lit(True) if limit_categories is None else F.col("cat_rank") <= limit_categories)
            .withColumn("tpl", F.concat(F.col("category"),
                                        F.when(F.col("category").contains("?"), F.lit("&page={page}"))
                                        .otherwise(F.lit("?page={page}")))))
    frontier = page_frontier(cats, "tpl", max_pages)
    got = landed.select(F.col("url").alias("page_url"), F.lit(1).alias("n_items")).dropDuplicates(["page_url"])
    pages = frontier.join(got, "page_url", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    w3 = Window.partitionBy("page_id", "category").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return (pages.withColumn("_missing_before", F.coalesce(F.max((F.col("n_items") == 0).cast("int")).over(w3), F.lit(0)))
            .withColumn("consumed", (F.col("_missing_before") == 0) & (F.col("n_items") > 0))
            .select("page_id", "category", "cat_rank", "page_no", "page_url", "consumed"))
