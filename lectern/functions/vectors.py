"""Vector column functions (T24-T27).  Catalyst; hash chains and term counts in Arrow batches."""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.session import AS_OF, stored

EMBEDDING_DIM = 384  # fixed value: embedding width of the reference's encoders
HALF_LIFE_DAYS = 30  # fixed value: activity decay half-life
TERMS_HELD = 1 << 18  # terms that a task of the TF-IDF fit counts before it gives them out
CHOSEN = 1 << 14      # words whose pairs the TF-IDF fit counts alone


def decay(ts: Column, as_of: str = AS_OF, half_life: int = HALF_LIFE_DAYS) -> Column:
    """exp(-0.693 * whole_age_days / half_life)."""
    micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    days = F.floor(micros / F.lit(86400 * 1_000_000))
    return F.exp(F.lit(-0.693) * days / F.lit(float(half_life)))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equal-length arrays, in double; null when lengths differ."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                    F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def l2_normalize(v: Column) -> Column:
    """Divide by the L2 norm (sequential sum of squares); a zero vector stays as it is.

    The norm is evaluated once per row (array_repeat outside the lambda), never
    inside the per-element lambda.
    """
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))
    safe = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return F.zip_with(v, F.array_repeat(safe, F.size(v)), lambda x, n: x / n)


def hash_embedding(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """sha256 hex chain; each byte b -> b/255 - 0.5; first `dim` values; L2-normalised.

    The first block hashes the text, each next block hashes the previous hex digest.
    """
    blocks = (dim + 31) // 32
    hexes = [F.sha2(text, 256)]
    for _ in range(blocks - 1):
        hexes.append(F.sha2(hexes[-1], 256))
    pairs = F.regexp_extract_all(F.concat(*hexes), F.lit("[0-9a-f]{2}"), 0)
    vals = F.transform(F.slice(pairs, 1, dim),
                       lambda x: F.conv(x, 16, 10).cast("double") / 255.0 - 0.5)
    return l2_normalize(vals)


def with_hash_embedding(df: DataFrame, text: Column, out_col: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """T26 with the text hashed in the JVM, once; from its digest the chain and the numbers are made in Arrow batches."""
    return df.withColumn("_he_h", F.sha2(text, 256)).withColumn(out_col, _chained(dim)(F.col("_he_h"))).drop("_he_h")


def _chained(dim: int):
    """Vectors of first hex digests; the norm is a sequential sum, as in `l2_normalize`."""
    @F.arrow_udf("array<double>")
    def chained(first: pa.Array) -> pa.Array:
        digests = []
        for h in first.drop_null().to_pylist():
            whole = [h]
            for _ in range((dim + 31) // 32 - 1):
                whole.append(h := hashlib.sha256(h.encode()).hexdigest())
            digests.append(bytes.fromhex("".join(whole))[:dim])
        v = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), dim) / 255.0 - 0.5
        return lists(_normalized(v), first.is_valid().to_numpy(zero_copy_only=False))
    return chained


def _normalized(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.cumsum(v * v, axis=1)[:, -1:])
    return v / np.where(norm > 0, norm, 1.0)


def lists(v: np.ndarray, there: np.ndarray) -> pa.Array:
    """The rows of `v` as lists, null where nothing is there."""
    ends = np.concatenate([[0], np.cumsum(there) * v.shape[1]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()), mask=pa.array(~there) if not there.all() else None)


def embedding_text(title: Column, abstract: Column) -> Column:
    """M1 input: "{title}. {title}. {abstract}" stripped."""
    from lectern.functions.text import strip_ws
    t = F.coalesce(title, F.lit(""))
    return strip_ws(F.concat(t, F.lit(". "), t, F.lit(". "), F.coalesce(abstract, F.lit(""))))


class Tfidf(NamedTuple):
    """T27 (fixed: fitted on the corpus): the tier of M1 between a language model and the hash embedding.

    terms: the `n` most frequent terms of the corpus (ties by name), in alphabetical order; idf: ln((1 + docs) / (1 + df)) + 1.
    Fitted once, kept as a table, applied row by row in batches and streams alike.
    """

    terms: list[str]
    idf: list[float]
    n: int = EMBEDDING_DIM

    NAME = "tfidf-384"

    @staticmethod
    def fit(df: DataFrame, text: Column, n: int = EMBEDDING_DIM, stops: list[str] | None = None) -> Tfidf:
        """The `n` most frequent terms without counting every pair of neighbours: a pair occurs no more often than either of its words, so
        one that can be among them has two words as frequent as the n-th word (all pairs are counted where those are
        more than CHOSEN)."""
        from lectern.functions.text import KEYWORD_STOPS
        stop = sorted(set(KEYWORD_STOPS if stops is None else stops))
        texts = df.select(F.coalesce(text, F.lit("")).alias("text"))

        def counted(chosen: list[str] | None, pairs: bool) -> DataFrame:
            def count(batches):
                """(term, tf, df) of a task's documents, given out whenever there are many terms."""
                held, n_held, two = [], 0, None if chosen is None else pa.array(chosen, pa.string())
                for b in batches:
                    for piece in W.pieces(b.column(0)):
                        held.append(W.term_counts(W.term_words(W.split(W.lowered(piece.to_pylist())), stop), two, pairs))
                        n_held += held[-1].num_rows
                        if n_held > TERMS_HELD:
                            held = [W.added(held)]
                            n_held = held[0].num_rows
                            if n_held > TERMS_HELD // 2:
                                yield from held[0].to_batches(max_chunksize=1 << 16)
                                held, n_held = [], 0
                if held:
                    yield from W.added(held).to_batches(max_chunksize=1 << 16)

            each = texts.mapInArrow(count, "term string, tf long, df long")
            return each.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))

        best = lambda counts: counts.orderBy(F.col("tf").desc(), "term").limit(n).collect()  # noqa: E731  (n rows)
        words = stored(counted(None, False), "terms")
        top, docs, chosen = best(words), df.count(), None
        if len(top) == n:
            chosen = [r["term"] for r in words.where(F.col("tf") >= top[-1]["tf"]).select("term").limit(CHOSEN + 1).collect()]
            chosen = chosen if len(chosen) <= CHOSEN else None
        top = sorted(top + best(counted(chosen, True)), key=lambda r: (-r["tf"], r["term"]))[:n]
        rows = sorted(top, key=lambda r: r["term"])
        return Tfidf([r["term"] for r in rows], [math.log((1 + docs) / (1 + r["df"])) + 1 for r in rows], n)

    def save(self, spark: SparkSession, path: str) -> None:
        from lectern.operators.store import write_table
        rows = [(k, t, w, self.n) for k, (t, w) in enumerate(zip(self.terms, self.idf))]
        write_table(spark.createDataFrame(rows, "k int, term string, idf double, n int").coalesce(1), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tfidf:
        from lectern.operators.store import read_table
        rows = sorted(read_table(spark, path).collect(), key=lambda r: r["k"])
        return Tfidf([r["term"] for r in rows], [r["idf"] for r in rows], rows[0]["n"] if rows else EMBEDDING_DIM)

    def vectors(self, df: DataFrame, text: Column, out: str, stops: list[str] | None = None) -> DataFrame:
        """Adds `out`: n numbers, L2-normalised; all 0 where no term of the corpus occurs.  No shuffle."""
        from lectern.functions.text import KEYWORD_STOPS
        if not self.terms:
            return df.withColumn(out, F.array_repeat(F.lit(0.0), self.n))
        stop, n, weights = sorted(set(KEYWORD_STOPS if stops is None else stops)), self.n, np.array(self.idf)
        own = sorted({w for t in self.terms for w in t.split(" ")})
        number = {w: i for i, w in enumerate(own)}
        places = [[number[w] for w in t.split(" ")] for t in self.terms]

        @F.arrow_udf("array<double>")
        def weighed(texts: pa.Array) -> pa.Array:
            known, one, two = pa.array(own, pa.string()), np.full(len(own) + 1, -1), np.full((len(own) + 1, len(own) + 1), -1)
            for k, p in enumerate(places):
                if len(p) == 1:
                    one[p[0]] = k
                elif len(p) == 2:
                    two[p[0], p[1]] = k
            out = []
            for piece in W.pieces(texts):
                w = W.term_words(W.split(W.lowered([t or "" for t in piece.to_pylist()])), stop)
                at = pc.fill_null(pc.index_in(w.words, known), len(own)).to_numpy(zero_copy_only=False)
                a, b, doc, _ = w.pairs()
                term, doc = np.r_[one[at[w.code]], two[at[a], at[b]]], np.r_[w.doc, doc]
                v = np.bincount(doc[term >= 0] * n + term[term >= 0], minlength=w.n * n).astype(np.float64).reshape(w.n, n)
                v[:, :len(weights)] *= weights
                out.append(lists(_normalized(v), np.ones(w.n, bool)))
            return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

        return df.withColumn(out, weighed(F.coalesce(text, F.lit(""))))
