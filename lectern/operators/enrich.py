"""Text enrichment (T4-T7, M10, S20/S23): keyword scoring as a distributed
explode/aggregate, organisation entities, and the per-item NLP profile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions import words as W
from lectern.functions.text import KEYWORD_STOPS, TOKEN_STOPS
from lectern.functions.vectors import Tfidf, embedding_text, with_hash_embedding

MIN_KEYWORD_TEXT = 20   # fixed value: shorter stripped texts get no keywords
MIN_ENTITY_TEXT = 10    # fixed value: shorter stripped texts get no entities


def full_text(title: Column, abstract: Column) -> Column:
    """M10 text: "title. abstract" when there is an abstract, else the title."""
    a = F.coalesce(abstract, F.lit(""))
    return F.when(a != "", F.concat(F.coalesce(title, F.lit("")), F.lit(". "), a)).otherwise(
        F.coalesce(title, F.lit("")))


def _enriched(n: int):
    """T2, T4 and T6 of a batch: number of tokens, the `n` best terms with their raw scores, organisations."""
    kind = pa.struct([("tokens", pa.int32()), ("keywords", pa.list_(pa.string())), ("raw", pa.list_(pa.float64())), ("organizations", pa.list_(pa.string()))])

    @F.arrow_udf("tokens int, keywords array<string>, raw array<double>, organizations array<string>")
    def enriched(texts: pa.Array) -> pa.Array:
        out = []
        for piece in W.pieces(texts):
            own = [t or "" for t in piece.to_pylist()]
            words = W.letter_words(W.split(W.lowered([W.cleaned(t) for t in own])))
            tokens = words.where(W.not_in(words.words, TOKEN_STOPS))
            terms = words.where(W.not_in(words.words, KEYWORD_STOPS))
            fits = np.array([len(t.strip()) >= MIN_KEYWORD_TEXT for t in own], bool)
            keep = fits[terms.doc]
            many, term, raw = W.best_terms(W.Words(terms.code[keep], terms.doc[keep], terms.words, terms.n), n)
            ends = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
            out.append(pa.StructArray.from_arrays([
                pa.array(np.bincount(tokens.doc, minlength=len(own)).astype(np.int32)), pa.ListArray.from_arrays(ends, term),
                pa.ListArray.from_arrays(ends, pa.array(raw, pa.float64())), pa.array([W.organisations(t) for t in own], pa.list_(pa.string()))], fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return enriched


def with_terms(df: DataFrame, text: Column, out: str, n: int = 10) -> DataFrame:
    """Adds `out`: the `n` best terms of `text` as (keyword, score), score / best score rounded to 4 dp; `_kw`: tokens and organizations.

    All of it is one pass over Arrow batches (`functions.words`): neither texts nor terms are shuffled, and a text is cleaned and split once.
    """
    # behind a generator the counts are made once, however often they are used
    df = df.select("*", F.explode(F.array(_enriched(n)(F.coalesce(text, F.lit(""))))).alias("_kw"))
    scores = F.zip_with("_kw.keywords", "_kw.raw", lambda k, r: F.struct(k.alias("keyword"), F.round(r / F.try_element_at("_kw.raw", F.lit(1)), 4).alias("score")))
    return df.withColumn(out, scores)


def with_keywords(df: DataFrame, text: Column, out: str, n: int = 10) -> DataFrame:
    """`with_terms` without tokens and organizations."""
    return with_terms(df, text, out, n).drop("_kw")


def keywords(df: DataFrame, id_col: str, text_col: str, n: int = 10) -> DataFrame:
    """T4: top-n terms per document, rows (id, rank, keyword, score)."""
    found = with_keywords(df.select(id_col, text_col), F.col(text_col), "_found", n)
    return found.select(id_col, F.posexplode("_found").alias("_pos", "k")).select(id_col, (F.col("_pos") + 1).alias("rank"), "k.keyword", "k.score")


def merge_keyword_scores(a: DataFrame, b: DataFrame, id_col: str, wa: float = 0.6, wb: float = 0.4,
                         n: int = 10) -> DataFrame:
    """T5: weighted merge of two keyword lists by lower-cased keyword (full outer join)."""
    x = a.select(id_col, F.lower("keyword").alias("keyword"), (F.col("score") * wa).alias("sa"))
    y = b.select(id_col, F.lower("keyword").alias("keyword"), (F.col("score") * wb).alias("sb"))
    m = (x.join(y, [id_col, "keyword"], "full")
         .select(id_col, "keyword", (F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0))).alias("s")))
    w = Window.partitionBy(id_col).orderBy(F.col("s").desc(), F.col("keyword"))
    return (m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(id_col, "rank", "keyword", F.round("s", 4).alias("score")))


def entity_groups(ents: DataFrame, id_col: str) -> DataFrame:
    """Dedupe exploded entities by (label, lower(text)) per item and map labels to
    categories (persons / organizations / locations / misc)."""
    cat = (F.when(F.col("label") == "PERSON", "persons").when(F.col("label") == "ORG", "organizations")
           .when(F.col("label").isin("GPE", "LOC", "FAC"), "locations").otherwise("misc"))
    w = Window.partitionBy(id_col, "label", F.lower("text")).orderBy("pos")
    return (ents.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
            .withColumn("category", cat))


def enrich(content: DataFrame, id_col: str = "external_id", source_table: Column | None = None,
           n_keywords: int = 10, model: Tfidf | None = None) -> DataFrame:
    """M10 for a whole table: text = "title. abstract"; token count (T1-T2), top
    keywords (T4), organisation entities (T6), embedding (M1), language 'en'.  One row per
    item (the NLP profile).

    The embedding is the fitted TF-IDF `model`'s, or the hash embedding where there is none;
    embedding_model names the tier."""
    base = content.select(F.col(id_col), "title", "abstract",
                          (source_table if source_table is not None else F.lit("article")).alias("source_table"),
                          full_text(F.col("title"), F.col("abstract")).alias("_text"))
    base = with_terms(base, F.col("_text"), "keywords", n_keywords)
    prof = base.select(
        id_col, "source_table",
        F.col("_kw.tokens").alias("token_count"),
        F.struct(F.array().cast("array<struct<text:string,label:string>>").alias("persons"),
                 F.transform(F.col("_kw.organizations"),
                             lambda m: F.struct(m.alias("text"), F.lit("ORG").alias("label"))).alias("organizations"),
                 F.array().cast("array<struct<text:string,label:string>>").alias("locations"),
                 F.array().cast("array<struct<text:string,label:string>>").alias("misc")).alias("entities"),
        "title", "abstract", "keywords",
        F.lit(Tfidf.NAME if model else "hash-384").alias("embedding_model"),
        F.lit("en").alias("language"))
    text = embedding_text(F.col("title"), F.col("abstract"))
    prof = (model.vectors(prof, text, "embedding") if model else with_hash_embedding(prof, text, "embedding")).drop("title", "abstract")
    return prof
