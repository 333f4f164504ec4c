"""Source normalisers (S4-S8, R1, R3, T13-T17): item rows -> the common article shape.

Each normaliser is one `select` of column expressions over exploded items.
`register_normalizer` is the extension point for further sources (R1).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.text import bare_doi, plain_text

ARTICLE_COLUMNS = ["external_id", "title", "abstract", "authors", "published_date", "doi", "url",
                   "pdf_url", "journal", "volume", "issue", "pages", "categories", "keywords",
                   "citation_count", "source"]

_NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_normalizer(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """A normaliser maps exploded item rows (column `item`) to ARTICLE_COLUMNS."""
    _NORMALIZERS[name] = fn


def normalizer(name: str) -> Callable[[DataFrame], DataFrame]:
    return _NORMALIZERS[name]


# ---------------------------------------------------------------- column helpers

@F.arrow_udf(StringType())
def _rebuilt(index: pa.Array) -> pa.Array:
    """The words of each map in the order of their positions; a missing position adds a space, a word without one is left out
    and so is what follows it."""
    out = []
    for entries in index.to_pylist():
        if not entries or any(at is None for _, at in entries):
            out.append(None if entries else "")
            continue
        n = sum(len(at) for _, at in entries)
        words: list = [None] * n
        try:
            for w, at in entries:
                for p in at:
                    words[p if p >= 0 else n] = w
        except (IndexError, TypeError):
            words = [None]
        if None in words:  # gaps, repeats or nulls
            pairs = sorted(((p is not None, p or 0, w) for w, at in entries for p in at))
            words, before = [], -1
            for there, p, w in pairs:
                if there and before is not None:
                    words.append(" " * (p - before) + w)
                before = p if there else None
            out.append("".join(words)[1:])
        else:
            out.append(" ".join(words))
    return pa.array(out, pa.string())


def from_inverted_index(m: Column) -> Column:
    """Word -> positions map back to text; missing positions are empty words
    joined by single spaces."""
    return _rebuilt(m)


def ensure_list(c: Column) -> Column:
    """T16 for string input: null -> [], 'a, b' -> ['a', 'b'] (trimmed, non-empty)."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(
        F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def date_from_parts(parts: Column) -> Column:
    """[y, m, d] / [y, m] / [y] -> date, month and day default 1."""
    y, mo, d = (F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3)))
    return F.when(F.size(parts) >= 1, F.try_make_timestamp(
        y, F.coalesce(mo, F.lit(1)), F.coalesce(d, F.lit(1)), F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def payload_date(c: Column, fmt: str | None = None) -> Column:
    """Configured format first, then common formats, then the first 10 chars as ISO."""
    fmts = ([fmt] if fmt else []) + ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/MM/dd", "dd/MM/yyyy",
                                     "MMMM d, yyyy"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in fmts],
                      F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def author_names(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("orcid"),
                                                 F.lit(None).cast("string").alias("institution")))


# ---------------------------------------------------------------- normalisers

def normalize_openalex(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """OpenAlex work -> article (plus the `keep` columns of the item rows)."""
    i = F.col("item")
    oid = F.replace(F.coalesce(i["id"], F.lit("")), F.lit("https://openalex.org/"), F.lit(""))
    bib = i["biblio"]
    first, last = F.coalesce(bib["first_page"], F.lit("")), F.coalesce(bib["last_page"], F.lit(""))
    pages = F.when((first != "") & (last != ""), F.concat(first, F.lit("-"), last)).otherwise(first)
    doi = bare_doi(F.coalesce(i["doi"], F.lit("")))
    cats = F.transform(F.slice(F.coalesce(i["concepts"], F.array()), 1, 5),
                       lambda c: F.coalesce(c["display_name"], F.lit("")))
    return items.select(
        *keep,
        F.concat(F.lit("openalex:"), oid).alias("external_id"),
        F.coalesce(i["title"], F.lit("")).alias("title"),
        from_inverted_index(i["abstract_inverted_index"]).alias("abstract"),
        F.transform(F.coalesce(i["authorships"], F.array()), lambda a: F.struct(
            a["author"]["display_name"].alias("name"), a["author"]["orcid"].alias("orcid"),
            F.try_element_at(a["institutions"], F.lit(1))["display_name"].alias("institution"))).alias("authors"),
        F.try_to_timestamp(i["publication_date"], F.lit("yyyy-MM-dd")).cast("date").alias("published_date"),
        F.nullif(doi, F.lit("")).alias("doi"),
        F.coalesce(i["id"], F.lit("")).alias("url"),
        F.coalesce(i["primary_location"]["pdf_url"], F.lit("")).alias("pdf_url"),
        F.coalesce(i["primary_location"]["source"]["display_name"], F.lit("")).alias("journal"),
        F.coalesce(bib["volume"], F.lit("")).alias("volume"),
        F.coalesce(bib["issue"], F.lit("")).alias("issue"),
        pages.alias("pages"), cats.alias("categories"), cats.alias("keywords"),
        F.coalesce(i["cited_by_count"], F.lit(0)).alias("citation_count"),
        F.lit("openalex").alias("source"))


def normalize_crossref(items: DataFrame) -> DataFrame:
    """CrossRef item -> article ('given family' names, date-parts, first title)."""
    i = F.col("item")
    parts = F.try_element_at(i["published"]["date-parts"], F.lit(1))
    return items.select(
        F.concat(F.lit("crossref:"), F.coalesce(i["DOI"], F.lit(""))).alias("external_id"),
        F.coalesce(F.try_element_at(i["title"], F.lit(1)), F.lit("")).alias("title"),
        F.coalesce(i["abstract"], F.lit("")).alias("abstract"),
        F.transform(F.coalesce(i["author"], F.array()), lambda a: F.struct(
            F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))))
            .alias("name"), F.coalesce(a["ORCID"], F.lit("")).alias("orcid"),
            F.lit(None).cast("string").alias("institution"))).alias("authors"),
        F.when(F.size(F.coalesce(parts, F.array())) > 0, date_from_parts(parts)).alias("published_date"),
        i["DOI"].alias("doi"),
        F.coalesce(i["URL"], F.lit("")).alias("url"),
        F.lit("").alias("pdf_url"),
        F.coalesce(F.try_element_at(i["container-title"], F.lit(1)), F.lit("")).alias("journal"),
        F.coalesce(i["volume"], F.lit("")).alias("volume"),
        F.coalesce(i["issue"], F.lit("")).alias("issue"),
        F.coalesce(i["page"], F.lit("")).alias("pages"),
        F.coalesce(i["subject"], F.array().cast("array<string>")).alias("categories"),
        F.coalesce(i["subject"], F.array().cast("array<string>")).alias("keywords"),
        F.coalesce(i["is-referenced-by-count"], F.lit(0)).alias("citation_count"),
        F.lit("crossref").alias("source"))


def normalize_semantic_scholar(items: DataFrame) -> DataFrame:
    """Semantic Scholar paper -> article (publicationDate, else Jan 1 of year; nulls -> '')."""
    i = F.col("item")
    pub = F.try_to_timestamp(i["publicationDate"], F.lit("yyyy-MM-dd")).cast("date")
    date = F.when(F.coalesce(i["publicationDate"], F.lit("")) != "", pub) \
        .when(i["year"].isNotNull(), F.make_date(i["year"], F.lit(1), F.lit(1)))
    fos = F.coalesce(i["fieldsOfStudy"], F.array().cast("array<string>"))
    return items.select(
        F.concat(F.lit("s2:"), F.coalesce(i["paperId"], F.lit(""))).alias("external_id"),
        F.coalesce(i["title"], F.lit("")).alias("title"),
        F.coalesce(i["abstract"], F.lit("")).alias("abstract"),
        author_names(F.transform(F.coalesce(i["authors"], F.array()), lambda a: F.coalesce(a["name"], F.lit(""))))
        .alias("authors"),
        date.alias("published_date"), F.lit(None).cast("string").alias("doi"),
        F.coalesce(i["url"], F.lit("")).alias("url"),
        F.coalesce(i["openAccessPdf"]["url"], F.lit("")).alias("pdf_url"),
        F.lit("").alias("journal"), F.lit("").alias("volume"), F.lit("").alias("issue"), F.lit("").alias("pages"),
        fos.alias("categories"), fos.alias("keywords"),
        F.coalesce(i["citationCount"], F.lit(0)).alias("citation_count"),
        F.lit("semantic_scholar").alias("source"))


def _article(items: DataFrame, **cols: Column) -> DataFrame:
    """Select ARTICLE_COLUMNS, defaulting the ones a source does not provide."""
    empty = F.array().cast("array<string>")
    defaults = {"abstract": F.lit(""), "doi": F.lit(None).cast("string"), "url": F.lit(""), "pdf_url": F.lit(""),
                "journal": F.lit(""), "volume": F.lit(""), "issue": F.lit(""), "pages": F.lit(""),
                "categories": empty, "keywords": empty, "citation_count": F.lit(0),
                "authors": author_names(empty), "published_date": F.lit(None).cast("date")}
    return items.select(*[cols.get(c, defaults.get(c)).alias(c) for c in ARTICLE_COLUMNS])


def normalize_core(items: DataFrame) -> DataFrame:
    """CORE result -> article (date = first 10 chars; url = download url, else the
    first full-text url, only when full-text urls exist)."""
    i = F.col("item")
    urls = F.coalesce(i["sourceFulltextUrls"], F.array().cast("array<string>"))
    dl = F.coalesce(i["downloadUrl"], F.lit(""))
    url = F.when(F.size(urls) > 0, F.when(dl != "", dl).otherwise(F.try_element_at(urls, F.lit(1)))).otherwise("")
    return _article(
        items,
        external_id=F.concat(F.lit("core:"), F.coalesce(i["id"], F.lit(""))),
        title=F.coalesce(i["title"], F.lit("")), abstract=F.coalesce(i["abstract"], F.lit("")),
        authors=author_names(F.coalesce(i["authors"], F.array().cast("array<string>"))),
        published_date=F.try_to_timestamp(F.substring(i["publishedDate"], 1, 10), F.lit("yyyy-MM-dd")).cast("date"),
        doi=i["doi"], url=url, pdf_url=dl, journal=F.coalesce(i["publisher"], F.lit("")), source=F.lit("core"))


def normalize_doaj(items: DataFrame) -> DataFrame:
    """DOAJ result -> article (bibjson; year -> Jan 1; first identifier / link)."""
    b = F.col("item")["bibjson"]
    year = F.try_cast(b["year"], "int") if hasattr(F, "try_cast") else b["year"].cast("int")
    return _article(
        items,
        external_id=F.concat(F.lit("doaj:"), F.coalesce(F.col("item")["id"], F.lit(""))),
        title=F.coalesce(b["title"], F.lit("")), abstract=F.coalesce(b["abstract"], F.lit("")),
        authors=author_names(F.transform(F.coalesce(b["author"], F.array()), lambda a: F.coalesce(a["name"], F.lit("")))),
        published_date=F.when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1))),
        doi=F.try_element_at(b["identifier"], F.lit(1))["id"],
        url=F.coalesce(F.try_element_at(b["link"], F.lit(1))["url"], F.lit("")),
        journal=F.coalesce(b["journal"]["title"], F.lit("")),
        categories=F.coalesce(b["subject"], F.array().cast("array<string>")),
        keywords=F.coalesce(b["keywords"], F.array().cast("array<string>")), source=F.lit("doaj"))


def normalize_pubmed(items: DataFrame) -> DataFrame:
    """PubmedArticle -> article (ForeName LastName; a non-numeric month counts as 1;
    DOI from the ArticleId of IdType doi)."""
    m = F.col("item")["MedlineCitation"]
    a = m["Article"]
    pd_ = a["Journal"]["JournalIssue"]["PubDate"]
    month = F.when(pd_["Month"].rlike(r"^\d+$"), pd_["Month"].cast("int")).otherwise(F.lit(1))
    day = F.coalesce(pd_["Day"].cast("int"), F.lit(1))
    date = F.when(pd_["Year"].isNotNull(), F.try_make_timestamp(
        pd_["Year"].cast("int"), month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    ids = F.coalesce(F.col("item")["PubmedData"]["ArticleIdList"]["ArticleId"], F.array())
    doi = F.try_element_at(F.filter(ids, lambda x: x["_IdType"] == "doi"), F.lit(1))["_VALUE"]
    names = F.transform(F.filter(F.coalesce(a["AuthorList"]["Author"], F.array()), lambda x: x["LastName"].isNotNull()),
                        lambda x: F.trim(F.concat(F.coalesce(x["ForeName"], F.lit("")), F.lit(" "), x["LastName"])))
    pmid = F.coalesce(m["PMID"], F.lit(""))
    return _article(
        items,
        external_id=F.concat(F.lit("pubmed:"), pmid),
        title=F.coalesce(a["ArticleTitle"], F.lit("")), abstract=F.coalesce(a["Abstract"]["AbstractText"], F.lit("")),
        authors=author_names(names), published_date=date, doi=F.nullif(doi, F.lit("")),
        url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")),
        journal=F.coalesce(a["Journal"]["Title"], F.lit("")), source=F.lit("pubmed"))


def normalize_arxiv(items: DataFrame) -> DataFrame:
    """arXiv Atom entry -> article (id after /abs/, categories double as keywords,
    pdf link by title, date = first 10 chars)."""
    i = F.col("item")
    aid = F.regexp_extract(F.coalesce(i["id"], F.lit("")), r"/abs/(.+)$", 1)
    cats = F.transform(F.coalesce(i["category"], F.array()), lambda c: c["_term"])
    pdf = F.try_element_at(F.filter(F.coalesce(i["link"], F.array()), lambda l: l["_title"] == "pdf"), F.lit(1))["_href"]
    return items.select(
        F.concat(F.lit("arxiv:"), aid).alias("external_id"),
        F.trim(F.regexp_replace(F.coalesce(i["title"], F.lit("")), r"\s*\n\s*", " ")).alias("title"),
        F.coalesce(i["summary"], F.lit("")).alias("abstract"),
        author_names(F.transform(F.coalesce(i["author"], F.array()), lambda a: a["name"])).alias("authors"),
        F.try_to_timestamp(F.substring(i["published"], 1, 10), F.lit("yyyy-MM-dd")).cast("date")
        .alias("published_date"),
        F.nullif(F.coalesce(i["doi"], F.lit("")), F.lit("")).alias("doi"),
        F.coalesce(i["id"], F.lit("")).alias("url"),
        F.coalesce(pdf, F.lit("")).alias("pdf_url"),
        F.lit("arXiv").alias("journal"), F.lit("").alias("volume"), F.lit("").alias("issue"),
        F.lit("").alias("pages"), cats.alias("categories"), cats.alias("keywords"),
        F.lit(0).alias("citation_count"), F.lit("arxiv").alias("source"))


def compile_mapping(mapping: dict[str, str], item: str = "item") -> dict[str, Column]:
    """{target: "dot.path"} -> column expressions; numeric segments index lists
    (0-based), a path through a list of structs collects the field of every element."""
    out = {}
    for target, path in mapping.items():
        c = F.col(item)
        for seg in path.split("."):
            c = F.try_element_at(c, F.lit(int(seg) + 1)) if seg.isdigit() else c.getField(seg)
        out[target] = c
    return out


def normalize(items: DataFrame, mapping: dict[str, str], source: str, date_format: str | None = None,
              item: str = "item") -> DataFrame:
    """Config-driven normalisation.  authors/date/list/title rules, rows without a
    title drop, a missing external_id is synthesised as source ':' sha256(item json)."""
    cols = compile_mapping(mapping, item)
    get = lambda k: cols.get(k, F.lit(None).cast("string"))
    title = plain_text(F.coalesce(get("title").cast("string"), F.lit("")))
    abstract = plain_text(F.coalesce(get("abstract").cast("string"), F.lit("")))
    ext = F.coalesce(F.nullif(get("external_id").cast("string"), F.lit("")),
                     F.concat(F.lit(source + ":"), F.sha2(F.to_json(F.col(item)), 256)))
    out = items.select(
        ext.alias("external_id"), title.alias("title"), abstract.alias("abstract"),
        payload_date(get("published_date").cast("string"), date_format).alias("published_date"),
        get("doi").cast("string").alias("doi"), get("url").cast("string").alias("url"),
        F.lit(source).alias("source"))
    return out.filter(F.col("title") != "")


register_normalizer("openalex", normalize_openalex)
register_normalizer("crossref", normalize_crossref)
register_normalizer("arxiv", normalize_arxiv)
register_normalizer("semantic_scholar", normalize_semantic_scholar)
register_normalizer("core", normalize_core)
register_normalizer("doaj", normalize_doaj)
register_normalizer("pubmed", normalize_pubmed)


# ---------------------------------------------------------------- S13: scraped items under alias names

#: The names under which a scraped field may come, first given wins.
ALIASES = {"title": ("title", "name"), "abstract": ("abstract", "description", "summary"), "published_date": ("published_date", "date"),
           "url": ("url", "link"), "pdf_url": ("pdf_url", "pdf"), "image_url": ("image_url", "image", "img"),
           "categories": ("categories", "tags")}


def normalize_items(raw: DataFrame, base_url: Column, source_type: str) -> DataFrame:
    """One item schema from fields under alias names; links made absolute against `base_url`,
    dates parsed, missing ids made from title and url (T21); items without a title are dropped."""
    from lectern.functions.dates import with_parsed_date
    from lectern.functions.urls import absolute_url, record_id

    def first(field: str) -> Column:
        kind = "array<string>" if field == "categories" else "string"
        given = [F.col(a) if kind != "string" else F.nullif(F.trim(F.col(a)), F.lit("")) for a in ALIASES[field] if a in raw.columns]
        return F.coalesce(*given, F.lit(None).cast(kind)).alias(field)

    own = F.nullif(F.col("external_id"), F.lit("")) if "external_id" in raw.columns else F.lit(None).cast("string")
    items = raw.select(*[first(f) for f in ALIASES], own.alias("external_id"), base_url.alias("_base")).filter(F.col("title").isNotNull())
    for link in ("url", "pdf_url", "image_url"):
        items = items.withColumn(link, absolute_url(F.col("_base"), F.col(link)))
    items = with_parsed_date(items, F.col("published_date"), "published_date")
    made = record_id(F.lit(source_type), F.col("title"), F.coalesce("url", F.lit("")))
    return items.withColumn("external_id", F.coalesce("external_id", made)).drop("_base")
