"""Search, listing, interleave and de-duplication.

All predicates are Catalyst expressions.  Limits are arguments of the caller:
nothing is cut unless a call says so.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.session import AS_OF, cut_lineage

#: The named date filters, in days.
DATE_RANGES = {"last_30_days": 30, "last_3_months": 90, "last_year": 365}


# ---------------------------------------------------------------- predicates

def text_match(q: str, cols: list[str], array_cols: tuple[str, ...] = (),
               struct_array_cols: tuple[tuple[str, str], ...] = ()) -> Column:
    """case-insensitive substring OR over columns; arrays match element values."""
    needle = F.lit(q.strip().lower())
    conds = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in cols]
    for c in array_cols:
        conds.append(F.coalesce(F.exists(F.col(c), lambda x: F.lower(x).contains(needle)), F.lit(False)))
    for c, field in struct_array_cols:
        conds.append(F.coalesce(F.exists(F.col(c), lambda x: F.lower(x[field]).contains(needle)),
                                F.lit(False)))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def all_categories(terms: str, col: str = "categories") -> Column:
    """every comma-separated term must be a substring of some element."""
    out = F.lit(True)
    for t in [t.strip().lower() for t in terms.split(",") if t.strip()]:
        out = out & F.coalesce(F.exists(F.col(col), _contains_lower(t)), F.lit(False))
    return out


def _contains_lower(t: str):
    return lambda x: F.lower(x).contains(F.lit(t))


def from_source(source: str, name_col: str, id_col: str) -> Column:
    """source name substring OR numeric id equality."""
    s = source.strip()
    cond = F.lower(F.col(name_col)).contains(F.lit(s.lower()))
    if s.isdigit():
        cond = cond | (F.col(id_col) == F.lit(int(s)))
    return F.coalesce(cond, F.lit(False))


def in_date_range(name: str, as_of: str = AS_OF, col: str = "published_date") -> Column:
    """30/90/365 days back from as_of; null dates drop; unknown name = no filter."""
    days = DATE_RANGES.get(name)
    if days is None:
        return F.lit(True)
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days)
    return F.coalesce(F.col(col) >= cutoff, F.lit(False))


def valid_items(df: DataFrame) -> DataFrame:
    """stripped title of 3+ chars and a non-empty external_id."""
    return df.filter((F.length(F.trim(F.col("title"))) >= 3)
                     & (F.length(F.coalesce(F.col("external_id"), F.lit(""))) > 0))


def in_window(df: DataFrame, start: str | None, end: str | None, col: str = "published_date") -> DataFrame:
    """date window; a null date passes."""
    cond = F.lit(True)
    if start:
        cond = cond & (F.col(col) >= F.to_date(F.lit(start)))
    if end:
        cond = cond & (F.col(col) <= F.to_date(F.lit(end)))
    return df.filter(F.col(col).isNull() | cond)


def matches_query(q: str) -> Column:
    """query in title OR abstract OR joined author names."""
    needle = F.lit(q.strip().lower())
    names = F.concat_ws(" ", F.transform(F.coalesce(F.col("authors"), F.array()), lambda a: a["name"]))
    return (F.coalesce(F.lower("title").contains(needle), F.lit(False))
            | F.coalesce(F.lower("abstract").contains(needle), F.lit(False))
            | F.lower(names).contains(needle))


def client_filter(df: DataFrame, categories: list[str] | None = None, sources: list[str] | None = None,
                  date_range: str | None = None, as_of: str = AS_OF) -> DataFrame:
    """ANY selected category substring, exact source membership, calendar cutoffs,
    null date passes."""
    if categories:
        cats = [c.lower() for c in categories]
        cond = F.lit(False)
        for c in cats:
            cond = cond | F.exists(F.col("categories"), _contains_lower(c))
        df = df.filter(F.coalesce(cond, F.lit(False)))
    if sources:
        df = df.filter(F.col("source_name").isin(sources))
    if date_range:
        d = F.to_date(F.lit(as_of))
        cutoff = {"last_30_days": F.date_sub(d, 30), "last_3_months": F.add_months(d, -3),
                  "last_year": F.add_months(d, -12)}.get(date_range)
        if cutoff is not None:
            df = df.filter(F.col("published_date").isNull() | (F.col("published_date") >= cutoff))
    return df


def profile_complete(profiles: DataFrame) -> DataFrame:
    """profession, field_of_study and 3+ interests, or the flag already set."""
    cond = (F.length(F.coalesce("profession", F.lit(""))) > 0) \
        & (F.length(F.coalesce("field_of_study", F.lit(""))) > 0) \
        & (F.size(F.coalesce("interests", F.array())) >= 3)
    return profiles.withColumn("is_profile_complete",
                               cond | F.coalesce(F.col("is_profile_complete"), F.lit(False)))


def set_flag(df: DataFrame, selection: Column, col: str, value) -> DataFrame:
    """bulk flag update over a selection."""
    return df.withColumn(col, F.when(selection, F.lit(value)).otherwise(F.col(col)))


def shorten(c: Column, n: int) -> Column:
    """Title shortening to n chars + '...'."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def merge_keywords(a: Column, b: Column) -> Column:
    """Sorted union of two keyword lists."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def faceted_browse(df: DataFrame, selected: dict[str, list], q: str, search_cols: list[str], facets: list[str]) -> DataFrame:
    """rows of the selected facet values that match the search, counted by every facet in one pass."""
    from lectern.operators.aggregates import facet_counts
    for col, values in selected.items():
        df = df.filter(F.col(col).isin(values))
    return facet_counts(df.filter(text_match(q, search_cols)) if q.strip() else df, facets)


def with_source(content: DataFrame, sources: DataFrame, ref: str) -> DataFrame:
    """Content with its source configuration (left join; content without one stays)."""
    c = sources.select(F.col("id").alias(ref), F.col("name").alias("source_config"), "is_active")
    return content.join(c, ref, "left")


def interest_overlap(content: DataFrame, tags: DataFrame, n: int) -> DataFrame:
    """Per user, the `n` newest items with a tag in common with (user_id, tag).

    A tag common to many users and items makes many pairs, so items are cut to the `n`
    newest of each tag first: a user's answer is among those of their tags.
    """
    newest = [F.col("published_date").desc_nulls_last(), F.col("id")]
    by_tag = content.select("id", "external_id", "published_date", F.explode(F.array_distinct("categories")).alias("tag"))
    by_tag = by_tag.withColumn("_r", F.row_number().over(Window.partitionBy("tag").orderBy(*newest))).filter(F.col("_r") <= n)
    hits = tags.join(by_tag, "tag").select("user_id", "id", "external_id", "published_date").distinct()
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*newest)))
    return ranked.filter(F.col("rank") <= n).select("user_id", "external_id", "rank")


# ---------------------------------------------------------------- union / listing

def union_content(articles: DataFrame, scraped: DataFrame) -> DataFrame:
    """One shape for both content tables; scraped ids +1 000 000, scraper ids +1000."""
    a = articles.select(
        F.col("id").cast("bigint").alias("id"), "external_id", "title", "abstract",
        "published_date", "doi", "url", "categories",
        F.col("citation_count").cast("int").alias("citation_count"),
        F.col("api_source_id").cast("bigint").alias("source_id"), "source_name",
        F.lit("article").alias("type"))
    s = scraped.select(
        (F.col("id") + 1000000).cast("bigint").alias("id"), "external_id", "title", "abstract",
        "published_date", "doi", F.col("source_url").alias("url"), "categories",
        F.lit(0).alias("citation_count"),
        (F.col("scraper_config_id") + 1000).cast("bigint").alias("source_id"), "source_name",
        F.lit("scraped").alias("type"))
    return a.unionByName(s)


def unified_listing(articles: DataFrame, scraped: DataFrame, search: str = "", categories: str = "",
                    source: str = "", date_range: str = "", page: int = 1, page_size: int = 20,
                    cap: int | None = None, as_of: str = AS_OF) -> DataFrame:
    """L1: per-side filters, union, date-desc sort, one page.

    Output adds `pos` (1-based rank in the merged list), `total` (rows in the merged
    list) and `total_pages` (min 1).  The page is reached by a top-(offset + page size),
    never by sorting the tables.  With `cap`, each side is first cut to its newest `cap`
    rows, as a caller may want for a quick first page.
    """
    if search.strip():
        articles = articles.filter(text_match(search, ["title", "abstract"], ("keywords",),
                                              (("authors", "name"),)))
        scraped = scraped.filter(text_match(search, ["title", "abstract"]))
    if categories.strip():
        articles = articles.filter(all_categories(categories))
        scraped = scraped.filter(all_categories(categories))
    if source.strip():
        articles = articles.filter(from_source(source, "source_name", "api_source_id"))
        scraped = scraped.filter(from_source(source, "source_name", "scraper_config_id"))
    if date_range.strip():
        articles = articles.filter(in_date_range(date_range, as_of))
        scraped = scraped.filter(in_date_range(date_range, as_of))
    u = union_content(articles, scraped)
    order = [F.col("published_date").desc_nulls_last(), F.col("id").asc()]
    if cap is not None:
        u = (u.filter(F.col("type") == "article").orderBy(*order).limit(cap)
             .unionByName(u.filter(F.col("type") == "scraped").orderBy(*order).limit(cap)))
    merged = [F.col("published_date").desc_nulls_last(), F.when(F.col("type") == "article", 0).otherwise(1), F.col("id")]
    start = (page - 1) * page_size
    top = u.orderBy(*merged).limit(start + page_size)
    # at most start + page_size rows come to this window
    ranked = top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*merged))).filter(F.col("pos") > start)
    # the total, once for every place of the page, so that it joins on equal keys
    total = u.agg(F.count(F.lit(1)).alias("total")).select("total", F.explode(F.sequence(F.lit(start + 1), F.lit(start + page_size))).alias("pos"))
    return (ranked.join(total, "pos")
            .withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(page_size)))
                        .cast("bigint"))
            .select("pos", "id", "external_id", "title", "published_date", "type", "source_name",
                    "total", "total_pages"))


def scraped_feed(scraped: DataFrame, search: str = "", content_type: str = "", page: int = 1,
                 per_page: int = 20) -> DataFrame:
    """L2 (with F1 and F5): scraped feed page ordered by -scraped_at."""
    if search.strip():
        scraped = scraped.filter(text_match(search, ["title", "abstract"]))
    if content_type:
        scraped = scraped.filter(F.col("content_type") == content_type)
    return (scraped.orderBy(F.col("scraped_at").desc(), F.col("id").asc())
            .offset((page - 1) * per_page).limit(per_page)
            .select("id", "external_id", "title", "content_type", "published_date", "source_url",
                    F.col("source_name").alias("scraper_name"), "scraped_at"))


def library_page(saved: DataFrame, user_id: int | None = None, search: str = "", page: int = 1,
                 page_size: int = 20) -> DataFrame:
    """L3: a user's library, -saved_at, searched, with total/total_pages.

    With user_id=None it pages every user's library at once (window per user).
    """
    if user_id is not None:
        saved = saved.filter(F.col("user_id") == user_id)
    if search.strip():
        saved = saved.filter(text_match(search, ["title", "abstract"]))
    # positions without sorting a whole (possibly hot) user in one task; totals by aggregation
    ranked = position_within(saved, "user_id", [("saved_at", False), ("external_id", True)], "pos")
    totals = saved.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    start = (page - 1) * page_size
    return (ranked.filter((F.col("pos") > start) & (F.col("pos") <= start + page_size))
            .join(totals, "user_id")
            .withColumn("total_pages",
                        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(page_size))).cast("bigint")))


def page_count(n: Column, size: int) -> Column:
    """ceil(count/size)."""
    return F.ceil(n / F.lit(size)).cast("bigint")


# ---------------------------------------------------------------- interleave / dedupe

def position_within(df: DataFrame, key: str, order: list[tuple[str, bool]], out: str = "rn") -> DataFrame:
    """row_number() over (partition by key order by `order`), without one task sorting a whole key.

    `order` lists (column, ascending), nulls last, and must be total; rows that tie on
    all of it share a position.  Only the key and the order columns are numbered: they
    are range-partitioned, sorted and stored in the checkpoint folder with a running
    number, so that everything below reads the same slices whatever the number of
    partitions.  A position is the running number's distance from the first row of its
    key and slice, plus the rows of the key in earlier slices (one small row per key and
    slice).  The rows of `df` are joined to their positions once.
    """
    sorts = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    cols = list(dict.fromkeys([key, *[c for c, _ in order]]))
    by = [F.col(key).asc_nulls_last(), *sorts]
    numbered = cut_lineage(df.select(*cols).distinct().repartitionByRange(*by).sortWithinPartitions(*by)
                           .withColumn("_n", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_slice", F.shiftright("_n", 33))
    slices = numbered.groupBy(F.col(key).alias("_key"), F.col("_slice").alias("_at")).agg(
        F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    placed = numbered.join(slices, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_at")))
    placed = placed.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)],
                           (F.col("_before") + F.col("_n") - F.col("_first") + 1).cast("int").alias(out))
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(cols)])
    return df.join(placed, same).drop(*[f"_c{i}" for i in range(len(cols))])


def interleave(df: DataFrame, source: str, order: list[tuple[str, bool]],
               source_rank: Column | None = None) -> DataFrame:
    """Round-robin over per-source lists.

    Adds `rn` (1-based position inside its source list, in `order`: (column, ascending)
    pairs, nulls last) and `src_rank`;
    the interleaved order is (rn, src_rank).  Positions come from `position_within`,
    so a hot source is numbered by many tasks; no global sort is needed either.
    """
    out = position_within(df, source, order)
    return out.withColumn("src_rank", F.col(source) if source_rank is None else source_rank)


def interleave_by_size(df: DataFrame, source: str, pos: str) -> DataFrame:
    """Sources ordered by bucket size desc, then first appearance; order key
    (rn, src_size desc, first_pos).  Sizes and first positions are one aggregation."""
    stats = df.groupBy(source).agg(F.count(F.lit(1)).alias("src_size"), F.min(pos).alias("first_pos"))
    return position_within(df, source, [(pos, True)]).join(stats, source)


def dedupe_key() -> Column:
    """W3 key: first non-empty of doi, external_id, title."""
    return F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.nullif(F.col("external_id"), F.lit("")),
                      F.nullif(F.col("title"), F.lit("")))


def dedupe_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Keep the first row per key in the given (ascending) order; rows with no key drop.

    An aggregation, not a window: `min_by(row, order)` is combined map-side, so a hot
    key (say a third of all rows are copies of one item) is reduced inside every
    input partition before the shuffle and never lands whole in one task.
    """
    cols = df.columns
    k = df.withColumn("_k", key).filter(F.col("_k").isNotNull())
    first = (k.groupBy("_k")
             .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order)).alias("_row")))
    return first.select(*[F.col("_row")[c].alias(c) for c in cols], "_k")


STORED = "stored"          # the list of the platform's own matches, the first of the lists
STORED_MATCHES = 40        # fixed value: own matches that join a live search
DEADLINE_SECONDS = 45      # fixed value: what a live search waits for


def live_response(results: DataFrame, outcomes: DataFrame, stored: DataFrame, order: list[tuple[str, bool]], max_results: int,
                  deadline: int = DEADLINE_SECONDS) -> DataFrame:
    """M12, the whole answer of a live search: own matches first, the sources that answered in time, and a report.

    results: rows with `source`; outcomes: (source, seconds, error), one row for each source asked; stored: own
    matches with the columns of `results`, the newest STORED_MATCHES of them join.  A source that took longer than
    `deadline` is late, one with an error has failed; neither gives results.  The lists are interleaved (W1, own matches
    first, then sources by name), de-duplicated (W3), and the first `max_results` are returned.

    Rows (part, pos, external_id, source, note, total): `article` rows in order, a `late` or `failed` row for each such
    source, and one `summary` row: total found before the limit, note `partial` if a source was late, else `complete`.
    """
    late = F.col("seconds") > deadline
    state = F.when(late, "late").when(F.coalesce("error", F.lit("")) != "", "failed").otherwise("ok")
    told = outcomes.select(F.col("source").alias("asked"), state.alias("state"), "error")
    fine = results.join(told.where("state = 'ok'").select(F.col("asked").alias("source")), "source", "left_semi").select(*results.columns)
    own = stored.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]).limit(STORED_MATCHES)
    lists = fine.withColumn("_rank", F.concat(F.lit("1"), F.col("source"))).unionByName(
        own.select(*[c for c in results.columns if c != "source"], F.lit(STORED).alias("source"), F.lit("0").alias("_rank")))
    found = cut_lineage(dedupe_first(interleave(lists, "source", order, F.col("_rank")), dedupe_key(), [F.col("rn"), F.col("src_rank")])
                        .select("external_id", "source", "rn", "src_rank"))
    first = found.orderBy("rn", "src_rank").limit(max_results)  # at most max_results rows are numbered
    pos = F.row_number().over(Window.orderBy("rn", "src_rank"))
    none = lambda kind: F.lit(None).cast(kind)
    articles = first.select(F.lit("article").alias("part"), pos.alias("pos"), "external_id", "source", none("string").alias("note"), none("long").alias("total"))
    reports = told.where("state <> 'ok'").select("state", none("int"), none("string"), "asked", F.when(F.col("state") == "failed", F.col("error")), none("long"))
    n_late = told.agg(F.count(F.when(F.col("state") == "late", 1)).alias("late")).withColumn("total", F.lit(0))
    total = found.agg(F.count(F.lit(1)).alias("total")).withColumn("late", F.lit(0)).select("late", "total").unionAll(n_late.select("late", "total"))
    summary = total.agg(F.sum("late").alias("late"), F.sum("total").alias("total")).select(
        F.lit("summary"), none("int"), none("string"), none("string"), F.when(F.col("late") > 0, "partial").otherwise("complete"), F.col("total").cast("long"))
    return articles.unionAll(reports).unionAll(summary)


# ---------------------------------------------------------------- live result cleaning

def clean_live(df: DataFrame, as_of: str = AS_OF, max_abstract: int | None = None) -> DataFrame:
    """F8 + T8-T10: drop empty titles, future dates, rows without a URL; keep named authors;
    split an inline `keywords:` tail off the abstract; cut abstracts to `max_abstract` characters if that is given."""
    from lectern.functions.text import inline_keywords, strip_inline_keywords, truncate_words
    from lectern.functions.urls import article_url
    today = F.to_date(F.lit(as_of))
    title = F.trim(F.coalesce(F.col("title"), F.lit("")))
    pd = F.try_to_timestamp(F.substring(F.col("published_date").cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    url = article_url(F.col("url"), F.col("doi"), F.col("external_id"))
    abstract = F.coalesce(F.col("abstract"), F.lit(""))
    kws = inline_keywords(abstract)
    stripped = strip_inline_keywords(abstract)
    merged = F.when(F.size(kws) > 0, merge_keywords(F.col("keywords"), kws)) \
        .otherwise(F.coalesce(F.col("keywords"), F.array().cast("array<string>")))
    out = (df.withColumn("title", title)
           .withColumn("url", url)
           .withColumn("keywords", merged)
           .withColumn("abstract", stripped if max_abstract is None else truncate_words(stripped, max_abstract))
           .withColumn("authors", F.filter(F.coalesce(F.col("authors"), F.array()),
                                           lambda a: F.length(F.trim(F.coalesce(a["name"], F.lit("")))) > 0)))
    return out.filter((F.col("title") != "") & (pd.isNull() | (pd <= today))
                      & (F.length(F.coalesce(F.col("url"), F.lit(""))) > 0))
