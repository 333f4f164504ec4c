"""Recommendation operators for all users at once.

Every operator is a DataFrame job; only M9 (greedy MMR over the two
engines' top-k candidates of a user) runs Python per user.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions.vectors import decay, l2_normalize
from lectern.operators.similarity import block_top_k, top_k_per
from lectern.operators.svd import Svd, truncated_svd
from lectern.session import AS_OF, stored

# ---- fixed values that must equal the reference ----
ACTION_WEIGHTS = {"save": 3.0, "view": 1.0}
SAVED_BOOST = 1.5
COLD_START_BELOW = 3
TIERS = [(5, 0.9, 0.1), (50, 0.65, 0.35)]   # (upper bound, alpha, beta); above: 0.5/0.5
MMR_LAMBDA = 0.7
SVD_RANK = 50
# ---- end of fixed values ----

MMR_ROWS = 1 << 19   # candidates in a group of users, about


def _interactions(activity: DataFrame) -> DataFrame:
    return activity.filter(F.col("activity_type").isin("save", "view"))


def interaction_matrix(activity: DataFrame) -> DataFrame:
    """A3: sparse user x item weights, save 3 / view 1, empty items skipped."""
    w = F.when(F.col("activity_type") == "save", 3.0).otherwise(1.0)
    return (_interactions(activity).filter(F.coalesce(F.col("content_id"), F.lit("")) != "")
            .groupBy("user_id", F.col("content_id").alias("external_id")).agg(F.sum(w).alias("w")))


def interaction_tiers(activity: DataFrame, users: DataFrame) -> DataFrame:
    """A4: interactions per user -> cold (< 3) or hybrid weights by tier."""
    c = _interactions(activity).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_interactions"))
    u = users.select("user_id").unionByName(c.select("user_id")).distinct()
    n = F.coalesce(F.col("n_interactions"), F.lit(0))
    (lo, a1, b1), (hi, a2, b2) = TIERS
    return (u.join(c, "user_id", "left").select(
        "user_id", n.alias("n_interactions"),
        F.when(n < COLD_START_BELOW, "cold").when(n < lo, "light").when(n > hi, "heavy").otherwise("regular")
        .alias("tier"),
        F.when(n < COLD_START_BELOW, F.lit(None)).when(n < lo, a1).when(n > hi, 0.5).otherwise(a2).alias("alpha"),
        F.when(n < COLD_START_BELOW, F.lit(None)).when(n < lo, b1).when(n > hi, 0.5).otherwise(b2).alias("beta")))


def unprocessed(content: DataFrame, profiles: DataFrame) -> DataFrame:
    """Content without an NLP profile (left anti join)."""
    return (content.join(profiles.select("external_id"), "external_id", "left_anti")
            .select("external_id", F.col("type").alias("source_table")))


def hydrate(scored: DataFrame, articles: DataFrame, scraped: DataFrame, max_abstract: int | None = None,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids found in articles, the rest from scraped content; abstract whole, or its first `max_abstract` characters;
    default source 'Unknown' / 'Scraper'.  `keep` names further columns of `scored` to return."""
    a = scored.join(_shape(articles, "Unknown", max_abstract), "external_id")
    rest = scored.join(articles.select("external_id"), "external_id", "left_anti")
    s = rest.join(_shape(scraped, "Scraper", max_abstract), "external_id")
    cols = [*keep, "external_id", "title", "abstract", "published_date", "source", "score"]
    return a.select(*cols).unionByName(s.select(*cols))


def _shape(df: DataFrame, default: str, max_abstract: int | None) -> DataFrame:
    abstract = F.coalesce("abstract", F.lit(""))
    return df.select("external_id", "title",
                     (abstract if max_abstract is None else F.substring(abstract, 1, max_abstract)).alias("abstract"),
                     F.coalesce(F.col("published_date").cast("string"), F.lit("")).alias("published_date"),
                     F.coalesce("source_name", F.lit(default)).alias("source"))


def located(scored: DataFrame, articles: DataFrame, scraped: DataFrame) -> DataFrame:
    """J2 by ids alone: the rows whose item is known, `_side` 0 (articles) or 1 (the rest, in scraped content)."""
    ids = articles.select("external_id", F.lit(0).alias("_side")).unionByName(scraped.select("external_id", F.lit(1).alias("_side")))
    return scored.join(ids.groupBy("external_id").agg(F.min("_side").alias("_side")), "external_id")


def with_content(rows: DataFrame, articles: DataFrame, scraped: DataFrame, max_abstract: int | None = None) -> DataFrame:
    """J2 for rows that `located` has seen, in whatever has been made of them since: each item's content is fetched once, by
    the last join, so that no later shuffle carries texts.  Rows without an item keep nulls and are dealt by `user_id`."""
    content = (_shape(articles, "Unknown", max_abstract).withColumn("_side", F.lit(0))
               .unionByName(_shape(scraped, "Scraper", max_abstract).withColumn("_side", F.lit(1))))
    dealt = F.coalesce("_side", -1 - F.pmod(F.xxhash64("user_id"), F.lit(1 << 20)).cast("int"))
    return rows.withColumn("_side", dealt).join(content, ["external_id", "_side"], "left").drop("_side")


# ---------------------------------------------------------------- content-based

def user_vectors(activity: DataFrame, saved: DataFrame, profiles: DataFrame, as_of: str = AS_OF,
                 history: int | None = None) -> DataFrame:
    """M3 for all users: save/view rows, weight 3/1 x decay x 1.5 when saved now, weighted
    mean of item embeddings, L2-normalised; all of a user's rows, or the latest `history`.

    The weighted sum is Spark ML's Summarizer (a JVM aggregate with map-side
    combine), so a user with a huge history is summed in parallel, not collected.
    The mean's 1/n cancels in the normalisation.
    """
    act = _interactions(activity)
    if history is not None:
        w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
        act = act.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= history)
    act = act.filter(F.coalesce(F.col("content_id"), F.lit("")) != "")
    s = saved.select("user_id", F.col("external_id").alias("content_id"), F.lit(True).alias("_saved"))
    p = profiles.filter(F.size("embedding") > 0).select(
        F.col("external_id").alias("content_id"), "embedding")
    weight = (F.when(F.col("activity_type") == "save", ACTION_WEIGHTS["save"]).otherwise(ACTION_WEIGHTS["view"])
              * decay(F.col("created_at"), as_of)
              * F.when(F.col("_saved"), SAVED_BOOST).otherwise(1.0))
    # an item's weights are added up before its vector is fetched
    weights = act.join(s, ["user_id", "content_id"], "left").groupBy("user_id", "content_id").agg(F.sum(weight).alias("w"))
    j = weights.join(p, "content_id").select("user_id", "w", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    summed = j.groupBy("user_id").agg(Summarizer.sum(F.col("v"), F.col("w")).alias("s"))
    return summed.select("user_id", l2_normalize(vector_to_array("s")).alias("user_vec"))


def seen_items(activity: DataFrame) -> DataFrame:
    """(user_id, external_id) the user saved or viewed (J9 exclusion set)."""
    return (_interactions(activity).filter(F.col("content_id").isNotNull())
            .select("user_id", F.col("content_id").alias("external_id")).distinct())


def content_recs(user_vecs: DataFrame, profiles: DataFrame, activity: DataFrame,
                 k: int) -> DataFrame:
    """M4: top-k items by user_vec . embedding, items the user saw excluded (exact)."""
    items = profiles.filter(F.size("embedding") > 0).select("external_id", "embedding")
    return _unseen_top_k(user_vecs.select("user_id", "user_vec"), "user_vec", items, "embedding", activity, k)


def _unseen_top_k(users: DataFrame, u_vec: str, items: DataFrame, i_vec: str, activity: DataFrame, k: int) -> DataFrame:
    """The k best unseen items of every user; n_seen: how many rows of `items` the user's seen items can take."""
    seen = stored(seen_items(activity), "seen")
    n_seen = seen.join(items.select("external_id"), "external_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seen"))
    q = users.join(n_seen, "user_id", "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
    cands = block_top_k(q, items, k, "user_id", "external_id", u_vec, i_vec, extra="n_seen", final=False)
    return top_k_per(cands.join(seen, ["user_id", "external_id"], "left_anti"), "user_id", "external_id", k)


def similar(profiles: DataFrame, k: int = 10) -> DataFrame:
    """M2 for every item: the k most similar other items (exact)."""
    p = profiles.filter(F.size("embedding") > 0).select("external_id", "embedding")
    q = p.select(F.col("external_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return block_top_k(q, p, k, "query_id", "external_id", "qvec", "embedding", exclude_same_id=True)


# ---------------------------------------------------------------- collaborative

def fit_svd(matrix: DataFrame, k: int = SVD_RANK) -> Svd | None:
    """M5: truncated SVD of the interaction matrix (users x items), explained variance included.

    Skips (returns None) with fewer than 10 non-zeros or when min(shape) - 1 < 2.  The factors are U S by user and V
    by item, so score(u, i) = uf . vf (the rank-k reconstruction).
    """
    cells = stored(matrix, "interactions")
    nnz, nu, ni = cells.count(), cells.select("user_id").distinct().count(), cells.select("external_id").distinct().count()
    rank = min(k, min(nu, ni) - 1)
    if nnz < 10 or rank < 2:
        return None
    return truncated_svd(cells, "user_id", "external_id", rank)


def collab_recs(factors: Svd | None, activity: DataFrame, k: int) -> DataFrame:
    """M6: top-k items by user factor . item factor, seen items excluded (exact)."""
    if factors is None:
        return seen_items(activity).limit(0).select("user_id", "external_id", F.lit(0.0).alias("score"),
                                                    F.lit(0).alias("rank"))
    user_f, item_f = factors.rows.withColumnRenamed("x", "uf"), factors.columns.withColumnRenamed("x", "vf")
    return _unseen_top_k(user_f, "uf", item_f, "vf", activity, k)


# ---------------------------------------------------------------- hybrid

def merge_scores(content: DataFrame, collab: DataFrame) -> DataFrame:
    """J8 + W6: full outer merge by (user, item), 0.0 default, max-normalise per user
    (`max or 1`), and the reference's insertion order key."""
    c = content.select("user_id", "external_id", F.col("score").alias("content"), F.col("rank").alias("c_rank"))
    k = collab.select("user_id", "external_id", F.col("score").alias("collab"), F.col("rank").alias("k_rank"))
    m = (c.join(k, ["user_id", "external_id"], "full")
         .withColumn("content", F.coalesce("content", F.lit(0.0)))
         .withColumn("collab", F.coalesce("collab", F.lit(0.0)))
         .withColumn("order_key", F.when(F.col("c_rank").isNotNull(), F.col("c_rank"))
                     .otherwise(F.col("k_rank") + 1000000)))
    w = Window.partitionBy("user_id")
    mc = F.max("content").over(w)
    mk = F.max("collab").over(w)
    return (m.withColumn("content", F.col("content") / F.when(mc == 0, 1.0).otherwise(mc))
            .withColumn("collab", F.col("collab") / F.when(mk == 0, 1.0).otherwise(mk)))


def _chosen(rel: np.ndarray, embs: list, lam: float, top_k: int) -> list[int]:
    """M9 for one user: places of the chosen candidates, which come best first; embs: a vector or None for each."""
    n = len(rel)
    have = np.array([e is not None and len(e) > 0 for e in embs], bool)
    if n <= top_k:
        return list(range(n))
    if not have.any():
        return list(range(top_k))
    # similarity of every candidate pair with equal widths, clipped at 0 (max_sim starts at 0);
    # candidates without a vector have similarity 0 to everything
    sim = np.zeros((n, n))
    dims = np.array([len(e) if h else -1 for e, h in zip(embs, have)])
    for d in set(dims[have].tolist()):
        idx = np.nonzero(dims == d)[0]
        m = np.stack([np.asarray(embs[i], dtype=np.float64) for i in idx])
        sim[np.ix_(idx, idx)] = m @ m.T
    np.maximum(sim, 0.0, out=sim)
    remaining = np.ones(n, dtype=bool)
    remaining[0] = False
    sel = [0]
    max_sim = sim[:, 0].copy()
    while len(sel) < top_k and remaining.any():
        mmr_v = lam * rel - (1 - lam) * max_sim
        mmr_v[~remaining] = -np.inf
        best = int(np.argmax(mmr_v))          # first index wins ties, as the greedy loop
        sel.append(best)
        remaining[best] = False
        np.maximum(max_sim, sim[:, best], out=max_sim)
    return sel


def mmr(cands: DataFrame, profiles: DataFrame, lam: float = MMR_LAMBDA, top_k: int = 20) -> DataFrame:
    """M9: greedy MMR re-rank per user.

    Users are dealt to groups of about MMR_ROWS candidates (the two engines' `k` of each user).  A group is sent the vector
    of each of its items once, not once for every candidate; then its users come by one after the other.
    """
    kind = dict(profiles.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"
    rows = stored(cands.select("user_id", "external_id", "score", F.col("order_key").cast("long").alias("order_key")), "candidates")
    n = rows.count()
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(n / MMR_ROWS), min(tasks, math.ceil(n / MMR_ROWS * 64)))
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int"))
    vecs = rows.select("_g", "external_id").distinct().join(profiles.select("external_id", F.col("embedding").cast(kind).alias("_vec")), "external_id")
    none = lambda t: F.lit(None).cast(t)
    both = (vecs.select("_g", F.lit(0).alias("_kind"), none("long").alias("user_id"), none("double").alias("score"), none("long").alias("order_key"), "external_id", "_vec")
            .unionAll(rows.select("_g", F.lit(1), F.col("user_id").cast("long"), "score", "order_key", "external_id", none(kind))))
    both = both.repartitionById(groups, F.col("_g")).sortWithinPartitions("_g", "_kind", "user_id", F.col("score").desc(), "order_key")

    def rerank(batches):
        vectors, at, now, users = {}, None, None, []

        def done():
            """The user's candidates; one whose item has several profiles stands for each of them."""
            own = [(s, x, v) for s, x in users for v in vectors.get(x) or [None]]
            sel = _chosen(np.array([s for s, _, _ in own], np.float64), [v for _, _, v in own], lam, top_k)
            return [(now[0], own[i][1], own[i][0], rank) for rank, i in enumerate(sel, 1)]

        types = (pa.int64(), pa.string(), pa.float64(), pa.int64())
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)],
                                                       names=["user_id", "external_id", "score", "rank"])
        for b in batches:
            out, vec = [], b.column(6)
            flat, ends = vec.flatten().to_numpy(zero_copy_only=False), vec.offsets.to_numpy() - vec.offsets[0].as_py()
            for i, (g, kind, user, score, item) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 2, 3, 5)))):
                if now is not None and (g != at or (user,) != now):
                    out += done()
                    now, users = None, []
                if g != at:
                    at, vectors = g, {}
                if kind == 0:
                    vectors.setdefault(item, []).append(flat[ends[i]:ends[i + 1]].copy())
                else:
                    now = (user,)
                    users.append((score, item))
            yield batch(out)
        if now is not None:
            yield batch(done())

    return both.mapInArrow(rerank, "user_id long, external_id string, score double, rank long")


def hybrid_scores(content: DataFrame, collab: DataFrame, tiers: DataFrame) -> DataFrame:
    """M8 scoring: alpha . content + beta . collab after normalisation, rounded to 4 dp."""
    m = merge_scores(content, collab).join(
        tiers.filter(F.col("tier") != "cold").select("user_id", "alpha", "beta"), "user_id")
    return m.withColumn("score", F.round(F.col("alpha") * F.col("content") + F.col("beta") * F.col("collab"), 4))


def popular_fallback(saved: DataFrame, k: int) -> DataFrame:
    """A2 as scores: the k most saved items (score = save count)."""
    c = saved.groupBy("external_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return c.orderBy(F.col("score").desc(), F.col("external_id")).limit(k)


def cold_start(users: DataFrame, profiles: DataFrame, saved: DataFrame, k: int = 20,
               dim: int | None = None) -> DataFrame:
    """M7: interests + research areas as query text -> hash embedding -> top-k profiles of
    equal width; users without such text (or without matching profiles) get the
    popular items.  Identical texts are scored once (a group of copies costs one query)."""
    from lectern.functions.vectors import with_hash_embedding, embedding_text, EMBEDDING_DIM
    dim = dim or EMBEDDING_DIM
    text = F.concat_ws(" ", F.concat(F.coalesce("interests", F.array().cast("array<string>")),
                                     F.coalesce("research_areas", F.array().cast("array<string>"))))
    u = users.select("user_id", text.alias("qtext"))
    has = u.filter(F.trim("qtext") != "")
    texts = with_hash_embedding(has.select("qtext").distinct(),
                                embedding_text(F.col("qtext"), F.lit("")), "qvec", dim)
    items = profiles.select("external_id", "embedding")
    scored = block_top_k(texts, items, k, "qtext", "external_id", "qvec", "embedding")
    by_text = has.join(scored, "qtext").select("user_id", "external_id", "score", "rank")
    # users whose interest path produced nothing fall back to popularity
    got = by_text.select("user_id").distinct()
    rest = u.join(got, "user_id", "left_anti")
    pop = popular_fallback(saved, k).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("external_id"))))
    # `pop` is a top-k (at most k rows, a proven bound, broadcast).  Each fallback user is
    # expanded to ranks 1..k and equi-joined with `pop` on the rank.
    fallback = (rest.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
                .join(F.broadcast(pop.withColumn("rank", F.col("rank").cast("int"))), "rank")
                .select("user_id", "external_id", "score", "rank"))
    return by_text.unionByName(fallback)
