"""Landed API payloads (S1-S3) and the builders that land them from the content tables.

The network fetch is out of scope: a payload is a row (source, page, fetched_at,
payload) already landed as text.  Readers parse payload text with a declared
schema (no inference) and explode the item list; failures drop (null parse).

Builders turn the article view into the shape each API answers with, so the
round trip builder -> reader -> normaliser can be checked against the view.
A page holds the items of one (source, doc_id div PAGE) bucket: at most PAGE
items, whatever the size of a source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = 50


def _landed(items: DataFrame, payload: Column, fetched_at: str = "2024-01-30 12:00:00") -> DataFrame:
    """Group item rows (with `source_name`, `doc_id`, `item`) into pages of <= PAGE items."""
    pages = (items.groupBy("source_name", (F.col("doc_id") / PAGE).cast("long").alias("page"))
             .agg(F.collect_list("item").alias("items")))
    return pages.select(F.col("source_name").alias("source"), "page",
                        F.lit(fetched_at).cast("timestamp").alias("fetched_at"), payload.alias("payload"))


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def _positions(texts: pa.Array) -> pa.Array:
    """word -> rising positions over the texts of each row; null without texts."""
    ends, keys, sizes, flat = [0], [], [], []
    for own in texts.to_pylist():
        at: dict[str, list[int]] = {}
        for text in own:
            for i, w in enumerate(text.split(" ")):
                at.setdefault(w, []).append(i)
        for w, places in at.items():
            keys.append(w)
            sizes.append(len(places))
            flat += places if len(own) == 1 else sorted(places)
        ends.append(len(keys))
    items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
    out = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), items)
    return pc.if_else(pa.array(np.diff(ends) > 0), out, pa.scalar(None, out.type))


def inverted_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word -> positions map of a text split on single spaces (OpenAlex abstract form).
    Texts, not words, are grouped by id: the texts of one id (usually one) make one map."""
    return df.groupBy(id_col).agg(F.collect_list(text_col).alias("texts")).select(id_col, _positions("texts").alias("aii"))


# ---------------------------------------------------------------- builders

def land_openalex(articles: DataFrame) -> DataFrame:
    idx = inverted_index(articles, "id", "abstract")
    a = articles.drop("abstract").join(idx, "id", "left")
    item = F.struct(
        F.concat(F.lit("https://openalex.org/W"), F.col("id").cast("string")).alias("id"),
        F.col("title").alias("title"),
        F.col("aii").alias("abstract_inverted_index"),
        F.transform("authors", lambda x: F.struct(
            F.struct(x["name"].alias("display_name"), x["orcid"].alias("orcid")).alias("author"),
            F.array().cast("array<struct<display_name:string>>").alias("institutions"))).alias("authorships"),
        F.date_format("published_date", "yyyy-MM-dd").alias("publication_date"),
        F.when(F.col("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), F.col("doi"))).alias("doi"),
        F.struct(F.struct(F.col("source_name").alias("display_name")).alias("source"),
                 F.lit(None).cast("string").alias("pdf_url")).alias("primary_location"),
        F.col("citation_count").alias("cited_by_count"),
        F.transform("categories", lambda c: F.struct(c.alias("display_name"))).alias("concepts"),
        F.struct(F.lit("1").alias("volume"), F.lit("2").alias("issue"),
                 (F.col("id") % 90 + 1).cast("string").alias("first_page"),
                 (F.col("id") % 90 + 9).cast("string").alias("last_page")).alias("biblio"))
    return _landed(a.select(F.col("id").alias("doc_id"), "source_name", item.alias("item")),
                   F.to_json(F.struct(F.col("items").alias("results"))))


def land_crossref(articles: DataFrame) -> DataFrame:
    d = F.col("published_date")
    item = F.struct(
        F.coalesce(F.col("doi"), F.concat(F.lit("10.9999/x."), F.col("id").cast("string"))).alias("DOI"),
        F.array(F.col("title")).alias("title"),
        F.col("abstract").alias("abstract"),
        F.transform("authors", lambda x: F.struct(F.try_element_at(F.split(x["name"], " "), F.lit(1)).alias("given"),
                                                  F.try_element_at(F.split(x["name"], " "), F.lit(2)).alias("family"),
                                                  x["orcid"].alias("ORCID"))).alias("author"),
        F.struct(F.when(d.isNull(), F.array(F.array().cast("array<int>")))
                 .when(F.col("id") % 3 == 0, F.array(F.array(F.year(d), F.month(d))))
                 .otherwise(F.array(F.array(F.year(d), F.month(d), F.dayofmonth(d))))
                 .alias("date-parts")).alias("published"),
        F.col("url").alias("URL"),
        F.array(F.col("source_name")).alias("container-title"),
        F.col("citation_count").alias("is-referenced-by-count"),
        F.col("categories").alias("subject"))
    return _landed(articles.select(F.col("id").alias("doc_id"), "source_name", item.alias("item")),
                   F.to_json(F.struct(F.struct(F.col("items").alias("items")).alias("message"))))


def land_semantic_scholar(articles: DataFrame) -> DataFrame:
    """Semantic Scholar `data` pages; every fourth item carries only the year."""
    d = F.col("published_date")
    item = F.struct(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("paperId"),
        F.col("title").alias("title"),
        F.col("abstract").alias("abstract"),
        F.transform("authors", lambda x: F.struct(x["name"].alias("name"))).alias("authors"),
        F.year(d).alias("year"),
        F.when(F.col("id") % 4 != 0, F.date_format(d, "yyyy-MM-dd")).alias("publicationDate"),
        F.col("url").alias("url"),
        F.struct(F.concat(F.col("url"), F.lit(".pdf")).alias("url")).alias("openAccessPdf"),
        F.col("citation_count").alias("citationCount"),
        F.col("categories").alias("fieldsOfStudy"))
    return _landed(articles.select(F.col("id").alias("doc_id"), "source_name", item.alias("item")),
                   F.to_json(F.struct(F.col("items").alias("data"))))


def land_core(articles: DataFrame) -> DataFrame:
    """CORE `results` pages; every other item has a download URL."""
    item = F.struct(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"),
        F.col("title").alias("title"), F.col("abstract").alias("abstract"),
        F.transform("authors", lambda x: x["name"]).alias("authors"),
        F.date_format("published_date", "yyyy-MM-dd'T'00:00:00").alias("publishedDate"),
        F.col("doi").alias("doi"),
        F.when(F.col("id") % 2 == 0, F.concat(F.col("url"), F.lit(".pdf"))).alias("downloadUrl"),
        F.array(F.col("url")).alias("sourceFulltextUrls"),
        F.col("source_name").alias("publisher"))
    return _landed(articles.select(F.col("id").alias("doc_id"), "source_name", item.alias("item")),
                   F.to_json(F.struct(F.col("items").alias("results"))))


def land_doaj(articles: DataFrame) -> DataFrame:
    """DOAJ `results` pages with `bibjson` records (year only, identifiers, links)."""
    bib = F.struct(
        F.col("title").alias("title"), F.col("abstract").alias("abstract"),
        F.transform("authors", lambda x: F.struct(x["name"].alias("name"))).alias("author"),
        F.year("published_date").cast("string").alias("year"),
        F.when(F.col("doi").isNotNull(), F.array(F.struct(F.col("doi").alias("id"), F.lit("doi").alias("type"))))
        .otherwise(F.array().cast("array<struct<id:string,type:string>>")).alias("identifier"),
        F.array(F.struct(F.col("url").alias("url"))).alias("link"),
        F.struct(F.col("source_name").alias("title")).alias("journal"),
        F.col("categories").alias("subject"), F.col("keywords").alias("keywords"))
    item = F.struct(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), bib.alias("bibjson"))
    return _landed(articles.select(F.col("id").alias("doc_id"), "source_name", item.alias("item")),
                   F.to_json(F.struct(F.col("items").alias("results"))))


def _xml_text(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def land_pubmed(articles: DataFrame) -> DataFrame:
    """PubMed XML pages (PubmedArticle records); every other item names its month."""
    d = F.col("published_date")
    month = F.when(F.col("id") % 2 == 0, F.date_format(d, "MMM")).otherwise(F.month(d).cast("string"))
    pub = F.when(d.isNull(), F.lit("")).otherwise(F.concat(
        F.lit("<PubDate><Year>"), F.year(d).cast("string"), F.lit("</Year><Month>"), month,
        F.lit("</Month><Day>"), F.dayofmonth(d).cast("string"), F.lit("</Day></PubDate>")))
    auth = F.array_join(F.transform("authors", lambda x: F.concat(
        F.lit("<Author><LastName>"), _xml_text(F.try_element_at(F.split(x["name"], " "), F.lit(2))),
        F.lit("</LastName><ForeName>"), _xml_text(F.try_element_at(F.split(x["name"], " "), F.lit(1))),
        F.lit("</ForeName></Author>"))), "")
    ids = F.concat(F.lit('<ArticleId IdType="pubmed">'), F.col("id").cast("string"), F.lit("</ArticleId>"),
                   F.when(F.col("doi").isNotNull(), F.concat(F.lit('<ArticleId IdType="doi">'), F.col("doi"),
                                                             F.lit("</ArticleId>"))).otherwise(F.lit("")))
    rec = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("id").cast("string"), F.lit("</PMID><Article>"),
        F.lit("<Journal><Title>"), _xml_text(F.col("source_name")), F.lit("</Title><JournalIssue>"), pub,
        F.lit("</JournalIssue></Journal><ArticleTitle>"), _xml_text(F.col("title")), F.lit("</ArticleTitle>"),
        F.lit("<Abstract><AbstractText>"), _xml_text(F.col("abstract")), F.lit("</AbstractText></Abstract>"),
        F.lit("<AuthorList>"), auth, F.lit("</AuthorList></Article></MedlineCitation>"),
        F.lit("<PubmedData><ArticleIdList>"), ids, F.lit("</ArticleIdList></PubmedData></PubmedArticle>"))
    return _landed(articles.select(F.col("id").alias("doc_id"), "source_name", rec.alias("item")),
                   F.concat(F.lit("<PubmedArticleSet>"), F.array_join("items", ""), F.lit("</PubmedArticleSet>")))


def land_rss(articles: DataFrame) -> DataFrame:
    """RSS 2.0 channel pages of the articles (item: title, link, description, pubDate, guid)."""
    item = F.concat(
        F.lit("<item><title>"), _xml_text(F.col("title")), F.lit("</title><link>"), F.col("url"),
        F.lit("</link><description>"), _xml_text(F.col("source_name")), F.lit("</description><pubDate>"),
        F.coalesce(F.date_format("published_date", "yyyy-MM-dd"), F.lit("")), F.lit("</pubDate><guid>"),
        F.col("external_id"), F.lit("</guid></item>"))
    return _landed(articles.select(F.col("id").alias("doc_id"), "source_name", item.alias("item")),
                   F.concat(F.lit('<rss version="2.0"><channel><title>feed</title>'), F.array_join("items", ""),
                            F.lit("</channel></rss>")))


def land_arxiv(articles: DataFrame) -> DataFrame:
    """Atom feed pages (namespaced XML) of the articles."""
    def esc(c: Column) -> Column:
        c = F.replace(c, F.lit("&"), F.lit("&amp;"))
        c = F.replace(c, F.lit("<"), F.lit("&lt;"))
        return F.replace(c, F.lit(">"), F.lit("&gt;"))
    cats = F.array_join(F.transform("categories", lambda c: F.concat(
        F.lit('<category term="'), esc(c), F.lit('"/>'))), "")
    auth = F.array_join(F.transform("authors", lambda x: F.concat(
        F.lit("<author><name>"), esc(x["name"]), F.lit("</name></author>"))), "")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), F.col("id").cast("string"), F.lit("v1</id>"),
        F.lit("<title>"), esc(F.col("title")), F.lit("</title>"),
        F.lit("<summary>"), esc(F.col("abstract")), F.lit("</summary>"),
        F.lit("<published>"), F.coalesce(F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")),
        F.lit("</published>"), auth, cats,
        F.lit('<link title="pdf" href="http://arxiv.org/pdf/'), F.col("id").cast("string"), F.lit('v1"/>'),
        F.lit("</entry>"))
    return _landed(articles.select(F.col("id").alias("doc_id"), "source_name", entry.alias("item")),
                   F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'),
                            F.array_join("items", ""), F.lit("</feed>")))


# ---------------------------------------------------------------- readers

def read_json_payloads(landed: DataFrame, schema: T.StructType | str, path: list[str]) -> DataFrame:
    """Parse each payload with `schema`, walk `path` to the item list, one row per item.
    A payload that does not parse, or whose path is not a list, yields no rows."""
    p = F.from_json(F.col("payload"), schema)
    node = p
    for k in path:
        node = node.getField(k)
    return landed.select("source", "page", "fetched_at", F.explode(node).alias("item"))


def read_rss_payloads(landed: DataFrame) -> DataFrame:
    """S3: RSS items (rowTag item) with the common RSS fields."""
    return read_xml_payloads(landed, "item", RSS_ITEM_SCHEMA)


def read_xml_payloads(landed: DataFrame, row_tag: str, schema: str) -> DataFrame:
    """Namespaces stripped, each <row_tag> element parsed with `schema`
    (attributes as _name).  Malformed payloads yield no rows."""
    no_ns = F.regexp_replace(F.regexp_replace(F.col("payload"), r"\sxmlns(:\w+)?=\"[^\"]*\"", ""),
                             r"<(/?)\w+:", "<$1")
    elements = F.regexp_extract_all(no_ns, F.lit(rf"(?s)<{row_tag}[\s>].*?</{row_tag}>"), 0)
    return (landed.select("source", "page", "fetched_at", F.explode(elements).alias("xml"))
            .select("source", "page", "fetched_at", F.from_xml("xml", schema).alias("item"))
            .filter(F.col("item").isNotNull()))


OPENALEX_SCHEMA = """results array<struct<
  id:string, title:string, abstract_inverted_index:map<string,array<int>>,
  authorships:array<struct<author:struct<display_name:string,orcid:string>,
                           institutions:array<struct<display_name:string>>>>,
  publication_date:string, doi:string,
  primary_location:struct<source:struct<display_name:string>,pdf_url:string>,
  cited_by_count:int, concepts:array<struct<display_name:string>>,
  biblio:struct<volume:string,issue:string,first_page:string,last_page:string>>>"""

CROSSREF_SCHEMA = """message struct<items:array<struct<
  DOI:string, title:array<string>, abstract:string,
  author:array<struct<given:string,family:string,ORCID:string>>,
  published:struct<`date-parts`:array<array<int>>>, URL:string, `container-title`:array<string>,
  volume:string, issue:string, page:string, `is-referenced-by-count`:int, subject:array<string>>>>"""

SEMANTIC_SCHOLAR_SCHEMA = """data array<struct<
  paperId:string, title:string, abstract:string, authors:array<struct<name:string>>, year:int,
  publicationDate:string, url:string, openAccessPdf:struct<url:string>, citationCount:int,
  fieldsOfStudy:array<string>>>"""

CORE_SCHEMA = """results array<struct<
  id:string, title:string, abstract:string, authors:array<string>, publishedDate:string, doi:string,
  downloadUrl:string, sourceFulltextUrls:array<string>, publisher:string>>"""

DOAJ_SCHEMA = """results array<struct<id:string, bibjson:struct<
  title:string, abstract:string, author:array<struct<name:string>>, year:string,
  identifier:array<struct<id:string,type:string>>, link:array<struct<url:string>>,
  journal:struct<title:string>, subject:array<string>, keywords:array<string>>>>"""

PUBMED_SCHEMA = """MedlineCitation struct<PMID:string, Article:struct<
    Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string>>>,
    ArticleTitle:string, Abstract:struct<AbstractText:string>,
    AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>>>,
  PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"""

RSS_ITEM_SCHEMA = "title string, link string, description string, pubDate string, guid string, category array<string>"

ARXIV_ENTRY_SCHEMA = """id string, title string, summary string, published string,
  author array<struct<name:string>>, category array<struct<_term:string>>,
  link array<struct<_title:string,_href:string>>, doi string"""
