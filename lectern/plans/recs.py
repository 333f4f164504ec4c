"""Vector and recommendation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.text import WS
from lectern.functions.vectors import embedding_text, with_hash_embedding
from lectern.operators import recs as R
from lectern.operators.svd import truncated_svd
from lectern.plans.catalog import query
from lectern.session import AS_OF, stored
from lectern.sources import tables as T


def _duck_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def _duck_vectors(name: str, source: str, keys: str, text_expr: str, dim: int = 384) -> str:
    """CTEs that end in `name` (keys, v): hash embeddings of `text_expr`, each digest and the norm a column
    of its own, so that DuckDB computes them once."""
    n = (dim + 31) // 32
    steps = [f"{name}_0 AS (SELECT {keys}, sha256({text_expr}) AS h0 FROM {source})"]
    steps += [f"{name}_{i} AS (SELECT *, sha256(h{i - 1}) AS h{i} FROM {name}_{i - 1})" for i in range(1, n)]
    pairs = f"regexp_extract_all({' || '.join(f'h{i}' for i in range(n))}, '[0-9a-f]{{2}}')"
    steps.append(f"{name}_v AS (SELECT {keys}, list_transform({pairs}[1:{dim}], lambda x: ('0x' || x)::INTEGER / 255.0 - 0.5)::DOUBLE[] AS vals "
                 f"FROM {name}_{n - 1})")
    steps.append(f"{name}_n AS (SELECT {keys}, vals, sqrt(list_dot_product(vals, vals)) AS norm FROM {name}_v)")
    steps.append(f"{name} AS (SELECT {keys}, list_transform(vals, lambda x: x / norm) AS v FROM {name}_n)")
    return ",\n".join(steps)


DOC_TEXT = _duck_strip("title || '. ' || title || '. ' || coalesce(abstract, '')")


def content_vectors(spark, sf_dir):
    """Hash embeddings (T26) of all content, the vector space of text queries (M1/M7)."""
    u = T.content_union(spark, sf_dir).select("external_id", "title", "abstract")
    return with_hash_embedding(u, embedding_text(F.col("title"), F.col("abstract")), "embedding").select(
        "external_id", "embedding")


@query("hash_embedding", views=("content_union",), sql=f"""
WITH {_duck_vectors('n', 'content_union', 'external_id', DOC_TEXT)}
SELECT external_id, CAST(d - 1 AS INTEGER) AS dim, round(x, 6) AS value
FROM (SELECT external_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM n)
""")
def hash_embedding_q(spark, sf_dir):
    """384-dim hash embedding of every content item's "title. title. abstract"."""
    v = content_vectors(spark, sf_dir)
    return v.select("external_id", F.posexplode("embedding").alias("dim", "x")).select(
        "external_id", "dim", F.round("x", 6).alias("value"))


@query("similar_items", views=("nlp_profile",), sql="""
SELECT query_id, external_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, external_id) AS rank
  FROM (SELECT q.external_id AS query_id, p.external_id,
               list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score
        FROM nlp_profile q JOIN nlp_profile p
          ON q.external_id <> p.external_id AND len(q.embedding) = len(p.embedding)
        WHERE len(p.embedding) > 0))
WHERE rank <= 10
""")
def similar_items(spark, sf_dir):
    """M2 for every profiled item: its 10 nearest items by dot product (exact, blocked)."""
    out = R.similar(T.nlp_profile(spark, sf_dir), k=10)
    return out.select("query_id", "external_id", F.round("score", 6).alias("score"), "rank")


_USER_VEC = f"""
a AS (SELECT * FROM user_activity WHERE activity_type IN ('save', 'view') AND coalesce(content_id, '') <> ''),
j AS (SELECT a.user_id,
             (CASE WHEN a.activity_type = 'save' THEN 3.0 ELSE 1.0 END)
             * exp(-0.693 * floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(a.created_at)) / 86400000000) / 30.0)
             * (CASE WHEN s.external_id IS NOT NULL THEN 1.5 ELSE 1.0 END) AS w,
             p.embedding
      FROM a JOIN nlp_profile p ON p.external_id = a.content_id AND len(p.embedding) > 0
      LEFT JOIN saved_article s ON s.user_id = a.user_id AND s.external_id = a.content_id),
e AS (SELECT user_id, w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM j),
sm AS (SELECT user_id, d, sum(w * x) AS v FROM e GROUP BY 1, 2),
nm AS (SELECT user_id, sqrt(sum(v * v)) AS n FROM sm GROUP BY 1),
uv AS (SELECT user_id, d, CASE WHEN n > 0 THEN v / n ELSE v END AS x FROM sm JOIN nm USING (user_id))
"""


@query("user_vectors", views=("user_activity", "saved_article", "nlp_profile"), sql=f"""
WITH {_USER_VEC}
SELECT user_id, CAST(d - 1 AS INTEGER) AS dim, round(x, 6) AS value FROM uv
""")
def user_vectors(spark, sf_dir):
    """M3 for all users: decayed, weighted, normalised mean of their items' embeddings."""
    uv = R.user_vectors(T.user_activity(spark, sf_dir), T.saved_article(spark, sf_dir),
                        T.nlp_profile(spark, sf_dir))
    return uv.select("user_id", F.posexplode("user_vec").alias("dim", "x")).select(
        "user_id", "dim", F.round("x", 6).alias("value"))


@query("content_recs", views=("user_activity", "saved_article", "nlp_profile"), sql=f"""
WITH {_USER_VEC},
vec AS (SELECT user_id, list(x ORDER BY d) AS v FROM uv GROUP BY 1),
seen AS (SELECT DISTINCT user_id, content_id AS external_id FROM user_activity
         WHERE activity_type IN ('save', 'view') AND content_id IS NOT NULL),
sc AS (SELECT vec.user_id, p.external_id, list_dot_product(vec.v, p.embedding::DOUBLE[]) AS score
       FROM vec JOIN nlp_profile p ON len(p.embedding) = len(vec.v)
       WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = vec.user_id AND seen.external_id = p.external_id))
SELECT user_id, external_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, external_id) AS rank FROM sc)
WHERE rank <= 100
""")
def content_recs(spark, sf_dir):
    """M4 for all users: top-100 unseen items by user vector . item embedding."""
    act = T.user_activity(spark, sf_dir)
    prof = T.nlp_profile(spark, sf_dir)
    uv = R.user_vectors(act, T.saved_article(spark, sf_dir), prof)
    out = R.content_recs(uv, prof, act, k=100)
    return out.select("user_id", "external_id", F.round("score", 6).alias("score"), "rank")


@query("cold_start_recs", views=("user_activity", "user_profile", "saved_article", "content_union"), sql=f"""
WITH cnt AS (SELECT user_id, count(*) AS n FROM user_activity WHERE activity_type IN ('save', 'view') GROUP BY 1),
cold AS (SELECT p.user_id, array_to_string(list_concat(p.interests, p.research_areas), ' ') AS qtext
         FROM user_profile p LEFT JOIN cnt USING (user_id) WHERE coalesce(cnt.n, 0) < 3),
qt AS (SELECT DISTINCT qtext FROM cold WHERE trim(qtext) <> ''),
{_duck_vectors('qv', 'qt', 'qtext', _duck_strip("qtext || '. ' || qtext || '. '"))},
{_duck_vectors('dv', 'content_union', 'external_id', DOC_TEXT)},
dots AS (SELECT qv.qtext, dv.external_id, list_dot_product(qv.v, dv.v) AS score FROM qv JOIN dv ON len(qv.v) = len(dv.v)),
sc AS (SELECT qtext, external_id, score, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY qtext ORDER BY round(score, 9) DESC, external_id) AS rank FROM dots) WHERE rank <= 20),
pop AS (SELECT external_id, CAST(count(*) AS DOUBLE) AS score FROM saved_article GROUP BY 1
        ORDER BY score DESC, external_id LIMIT 20),
popr AS (SELECT *, row_number() OVER (ORDER BY score DESC, external_id) AS rank FROM pop)
SELECT c.user_id, sc.external_id, round(sc.score, 6) AS score, sc.rank FROM cold c JOIN sc USING (qtext)
UNION ALL
SELECT c.user_id, popr.external_id, popr.score, popr.rank
FROM cold c, popr WHERE trim(c.qtext) = ''
""")
def cold_start_recs(spark, sf_dir):
    """M7 for every cold user (< 3 interactions): interest-text top-20 over content hash
    embeddings, else the 20 most saved items."""
    act = T.user_activity(spark, sf_dir)
    tiers = R.interaction_tiers(act, T.user_profile(spark, sf_dir))
    cold = T.user_profile(spark, sf_dir).join(tiers.filter(F.col("tier") == "cold").select("user_id"), "user_id")
    out = R.cold_start(cold, content_vectors(spark, sf_dir), T.saved_article(spark, sf_dir), k=20)
    return out.select("user_id", "external_id", F.round("score", 6).alias("score"), "rank")


@query("svd_spectrum", views=("user_activity",), sql="""
WITH m AS (SELECT user_id, content_id AS item, sum(CASE WHEN activity_type = 'save' THEN 3.0 ELSE 1.0 END)::DOUBLE AS w FROM user_activity
           WHERE activity_type IN ('save', 'view') AND coalesce(content_id, '') <> '' GROUP BY 1, 2),
g AS (SELECT a.item AS i, b.item AS j, sum(a.w * b.w) AS v FROM m a JOIN m b USING (user_id) GROUP BY 1, 2),
g2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2),
n AS (SELECT count(DISTINCT user_id) AS users, count(DISTINCT item) AS items, sum(w * w) AS trace FROM m)
SELECT users, items, round(trace, 3) AS trace1,
       round((SELECT sum(v * v) FROM g) / (trace * trace), 9) AS trace2,
       round((SELECT sum(g2.v * g.v) FROM g2 JOIN g ON g2.i = g.i AND g2.j = g.j) / (trace * trace * trace), 9) AS trace3, 1.0 AS explained
FROM n
""")
def svd_spectrum(spark, sf_dir):
    """M5: every singular value s of the interaction matrix A, held against the traces of the powers of A'A
    (the sums of s^2, s^4 and s^6), and the explained variance of all of them together."""
    m = stored(R.interaction_matrix(T.user_activity(spark, sf_dir)), "interactions")
    n = m.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("external_id").alias("items")).first()
    svd = truncated_svd(m, "user_id", "external_id", min(n["users"], n["items"]))
    s2 = [v * v for v in svd.values]
    trace = sum(s2)
    row = (n["users"], n["items"], round(trace, 3), round(sum(v * v for v in s2) / trace ** 2, 9), round(sum(v ** 3 for v in s2) / trace ** 3, 9), round(svd.explained, 9))
    return spark.createDataFrame([row], "users long, items long, trace1 double, trace2 double, trace3 double, explained double")


@query("collab_recs")
def collab_recs(spark, sf_dir):
    """M5 + M6: rank-50 truncated SVD of the interaction matrix; top-100 unseen items per
    user by reconstructed score.  (SVD is checked against numpy in tests/.)"""
    act = T.user_activity(spark, sf_dir)
    factors = R.fit_svd(R.interaction_matrix(act), k=50)
    out = R.collab_recs(factors, act, k=100)
    return out.select("user_id", "external_id", F.round("score", 6).alias("score"), "rank")


_TIERS = """
cnt AS (SELECT user_id, count(*) AS n FROM user_activity WHERE activity_type IN ('save', 'view') GROUP BY 1),
tier AS (SELECT user_id, CASE WHEN n < 5 THEN 0.9::DOUBLE WHEN n > 50 THEN 0.5::DOUBLE ELSE 0.65::DOUBLE END AS alpha,
                CASE WHEN n < 5 THEN 0.1::DOUBLE WHEN n > 50 THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END AS beta FROM cnt WHERE n >= 3)"""

#: content engine (top 100), popularity engine (top 100 unseen items by the weight of all users) and their merge
_MERGED = f"""{_USER_VEC},
vec AS (SELECT user_id, list(x ORDER BY d) AS v FROM uv GROUP BY 1),
seen AS (SELECT DISTINCT user_id, content_id AS external_id FROM user_activity
         WHERE activity_type IN ('save', 'view') AND content_id IS NOT NULL),
sc AS (SELECT vec.user_id, p.external_id, list_dot_product(vec.v, p.embedding::DOUBLE[]) AS score
       FROM vec JOIN nlp_profile p ON len(p.embedding) = len(vec.v)
       WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = vec.user_id AND seen.external_id = p.external_id)),
content AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, external_id) AS rank FROM sc QUALIFY rank <= 100),
wt AS (SELECT content_id AS external_id, sum(CASE WHEN activity_type = 'save' THEN 3.0 ELSE 1.0 END)::DOUBLE AS score FROM user_activity
       WHERE activity_type IN ('save', 'view') AND coalesce(content_id, '') <> '' GROUP BY 1),
popular AS (SELECT vec.user_id, wt.external_id, wt.score,
                   row_number() OVER (PARTITION BY vec.user_id ORDER BY round(wt.score, 9) DESC, wt.external_id) AS rank
            FROM vec, wt WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = vec.user_id AND seen.external_id = wt.external_id) QUALIFY rank <= 100),
{_TIERS},
met AS (SELECT coalesce(c.user_id, p.user_id) AS user_id, coalesce(c.external_id, p.external_id) AS external_id,
               coalesce(c.score, 0.0) AS c, coalesce(p.score, 0.0) AS p, coalesce(c.rank, p.rank + 1000000) AS order_key
        FROM content c FULL JOIN popular p ON c.user_id = p.user_id AND c.external_id = p.external_id),
scaled AS (SELECT user_id, external_id, order_key,
                  c / coalesce(nullif(max(c) OVER (PARTITION BY user_id), 0), 1) AS content,
                  p / coalesce(nullif(max(p) OVER (PARTITION BY user_id), 0), 1) AS collab FROM met),
merged AS (SELECT s.*, round(alpha * content + beta * collab, 4) AS score FROM scaled s JOIN tier USING (user_id))"""


def merged(spark, sf_dir, second):
    """Scores of the content engine and of `second` (user vectors, profiles, activity) merged for every warm user."""
    act, prof, saved = T.user_activity(spark, sf_dir), T.nlp_profile(spark, sf_dir), T.saved_article(spark, sf_dir)
    tiers = R.interaction_tiers(act, T.user_profile(spark, sf_dir))
    uv = stored(R.user_vectors(act, saved, prof), "user-vectors")
    return R.hybrid_scores(R.content_recs(uv, prof, act, k=100), second(uv, prof, act), tiers)


def _popular(uv, prof, act):
    weights = R.interaction_matrix(act).groupBy("external_id").agg(F.sum("w").alias("w"))
    one = uv.select("user_id", F.array(F.lit(1.0)).alias("user_vec"))
    return R.content_recs(one, weights.select("external_id", F.array("w").alias("embedding")), act, k=100)


@query("merged_scores", views=("user_activity", "saved_article", "nlp_profile"), sql=f"""
WITH {_MERGED}
SELECT user_id, external_id, round(content, 6) AS content, round(collab, 6) AS collab, order_key, score FROM merged
""")
def merged_scores(spark, sf_dir):
    """J8 + W6 + A4 for all warm users: two engines' top 100 merged, scaled to each user's best and blended by tier
    (content, and unseen items by the weight of all users, which SQL can state)."""
    return merged(spark, sf_dir, _popular).select(
        "user_id", "external_id", F.round("content", 6).alias("content"), F.round("collab", 6).alias("collab"),
        F.col("order_key").cast("bigint").alias("order_key"), "score")


@query("mmr_rerank", views=("user_activity", "saved_article", "nlp_profile"), sql=f"""
WITH RECURSIVE {_MERGED},
placed AS (SELECT m.user_id, m.external_id, m.score, p.embedding::DOUBLE[] AS e,
                  row_number() OVER (PARTITION BY m.user_id ORDER BY m.score DESC, m.order_key) AS pos FROM merged m LEFT JOIN nlp_profile p USING (external_id)),
state AS (
  SELECT 0 AS step, user_id, external_id, score, e, pos, 0.0::DOUBLE AS near, NULL::BIGINT AS rank FROM placed
  UNION ALL
  SELECT s.step + 1, s.user_id, s.external_id, s.score, s.e, s.pos, greatest(s.near, coalesce(list_dot_product(s.e, b.e), 0.0)),
         CASE WHEN s.pos = b.pos THEN s.step + 1 ELSE s.rank END
  FROM state s JOIN (
    SELECT user_id, pos, e FROM state WHERE rank IS NULL
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY 0.7::DOUBLE * score - 0.3::DOUBLE * near DESC, pos) = 1) b ON b.user_id = s.user_id
  WHERE s.step < 10)
SELECT user_id, external_id, score, rank FROM state WHERE step = 10 AND rank IS NOT NULL
""")
def mmr_rerank(spark, sf_dir):
    """M9 + W10: the merged candidates of every warm user re-ranked greedily for diversity, first 10."""
    return R.mmr(merged(spark, sf_dir, _popular), T.nlp_profile(spark, sf_dir), top_k=10).select("user_id", "external_id", "score", "rank")


def hybrid(spark, sf_dir, top_k: int = 20):
    act, prof, saved, users = (f(spark, sf_dir) for f in (T.user_activity, T.nlp_profile, T.saved_article, T.user_profile))
    second = lambda uv, prof, act: R.collab_recs(R.fit_svd(R.interaction_matrix(act)), act, k=100)
    warm = R.mmr(merged(spark, sf_dir, second), prof, top_k=top_k)
    tiers = R.interaction_tiers(act, users)
    cold = users.join(tiers.filter(F.col("tier") == "cold").select("user_id"), "user_id")
    cold_recs = R.cold_start(cold, content_vectors(spark, sf_dir), saved, k=top_k)
    return warm.unionByName(cold_recs.select("user_id", "external_id", "score", F.col("rank").cast("long")))


@query("hybrid_recs")
def hybrid_recs(spark, sf_dir):
    """M8 + M9 + M7 for every user: adaptive content/collaborative blend with MMR
    diversity for warm users, cold start for the rest; 20 per user."""
    return hybrid(spark, sf_dir, 20).select("user_id", "external_id", F.round("score", 6).alias("score"), "rank")


def respond(spark, sf_dir, recs):
    """Hydrated recommendations (title, abstract, date, source) with each user's strategy; a user without any has one row
    of strategy no_data.  Users meet ids; texts are fetched last."""
    articles, scraped = T.article(spark, sf_dir), T.scraped_content(spark, sf_dir)
    users = T.user_profile(spark, sf_dir).select("user_id", (F.size("interests") + F.size("research_areas") > 0).alias("told"))
    tiers = R.interaction_tiers(T.user_activity(spark, sf_dir), T.user_profile(spark, sf_dir))
    found = R.located(recs.select("user_id", "external_id", "rank", "score"), articles, scraped)
    s = tiers.select("user_id", "tier").join(users, "user_id", "left").join(found, "user_id", "left")
    strategy = (F.when(F.col("external_id").isNull(), "no_data").when(F.col("tier") != "cold", "hybrid")
                .when(F.col("told"), "cold_start").otherwise("popular"))
    s = R.with_content(s.withColumn("strategy", strategy), articles, scraped)
    return s.select("user_id", "strategy", "rank", "external_id", "title", "abstract", "published_date", "source", "score")


@query("similar_response", views=("nlp_profile", "article", "scraped_content"), sql="""
WITH top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, external_id) AS rank
  FROM (SELECT q.external_id AS query_id, p.external_id, list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score
        FROM nlp_profile q JOIN nlp_profile p ON q.external_id <> p.external_id AND len(q.embedding) = len(p.embedding)
        WHERE len(p.embedding) > 0)) WHERE rank <= 10),
content AS (
  SELECT external_id, title, abstract, published_date, source_name, 0 AS side FROM article
  UNION ALL SELECT external_id, title, abstract, published_date, source_name, 1 FROM scraped_content WHERE external_id NOT IN (SELECT external_id FROM article))
SELECT query_id, external_id, rank, title, coalesce(abstract, '') AS abstract, coalesce(CAST(published_date AS VARCHAR), '') AS published_date,
       coalesce(source_name, CASE side WHEN 0 THEN 'Unknown' ELSE 'Scraper' END) AS source, round(score, 6) AS score
FROM top JOIN content USING (external_id)
""")
def similar_response(spark, sf_dir):
    """M2 as answered: the 10 nearest items of every profiled item, hydrated."""
    top = R.similar(T.nlp_profile(spark, sf_dir), k=10)
    out = R.hydrate(top, T.article(spark, sf_dir), T.scraped_content(spark, sf_dir), keep=("query_id", "rank"))
    return out.withColumn("score", F.round("score", 6))


@query("blend_response", views=("user_activity", "saved_article", "nlp_profile", "article", "scraped_content", "user_profile"), sql=f"""
WITH {_MERGED},
best AS (SELECT user_id, external_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, order_key) AS rank FROM merged QUALIFY rank <= 20),
content_rows AS (
  SELECT external_id, title, abstract, published_date, source_name, 0 AS side FROM article
  UNION ALL SELECT external_id, title, abstract, published_date, source_name, 1 FROM scraped_content WHERE external_id NOT IN (SELECT external_id FROM article)),
found AS (SELECT b.user_id, b.rank, b.external_id, title, coalesce(abstract, '') AS abstract, coalesce(CAST(published_date AS VARCHAR), '') AS published_date,
                 coalesce(source_name, CASE side WHEN 0 THEN 'Unknown' ELSE 'Scraper' END) AS source, b.score FROM best b JOIN content_rows USING (external_id)),
people AS (SELECT user_id FROM user_profile UNION SELECT user_id FROM cnt)
SELECT user_id, CASE WHEN f.external_id IS NULL THEN 'no_data' ELSE 'hybrid' END AS strategy,
       f.rank, f.external_id, f.title, f.abstract, f.published_date, f.source, f.score
FROM people LEFT JOIN found f USING (user_id)
""")
def blend_response(spark, sf_dir):
    """M11 as answered, over scores that SQL can state: every user's 20 best merged items hydrated, with the strategy."""
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("order_key"))
    best = merged(spark, sf_dir, _popular).withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    return respond(spark, sf_dir, best.select("user_id", "external_id", "score", "rank"))


@query("recommendation_response")
def recommendation_response(spark, sf_dir):
    """The hydrated response of every user (hybrid, cold_start, popular or no_data)."""
    return respond(spark, sf_dir, hybrid(spark, sf_dir, 20))


@query("recommendation_summary", views=("user_activity", "user_profile", "nlp_profile"), sql=f"""
WITH {_TIERS},
seen AS (SELECT DISTINCT user_id, content_id AS external_id FROM user_activity WHERE activity_type IN ('save', 'view') AND content_id IS NOT NULL),
known AS (SELECT external_id FROM nlp_profile WHERE len(embedding) > 0 UNION SELECT external_id FROM seen WHERE external_id <> ''),
warm AS (SELECT t.user_id, (SELECT count(*) FROM known) - count(s.external_id) AS open FROM tier t LEFT JOIN seen s ON s.user_id = t.user_id GROUP BY 1)
SELECT p.user_id, CASE WHEN w.user_id IS NOT NULL THEN CASE WHEN w.open > 0 THEN 'hybrid' ELSE 'no_data' END
                       WHEN len(interests) + len(research_areas) > 0 THEN 'cold_start' ELSE 'popular' END AS strategy,
       CASE WHEN w.user_id IS NOT NULL THEN least(20, w.open) ELSE 20 END AS count
FROM user_profile p LEFT JOIN warm w USING (user_id)
""")
def recommendation_summary(spark, sf_dir):
    """The response of every user in short: strategy (hybrid / cold_start / popular, or no_data
    when nothing is recommended) and the number of items."""
    recs = hybrid(spark, sf_dir, 20).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    tiers = R.interaction_tiers(T.user_activity(spark, sf_dir), T.user_profile(spark, sf_dir))
    told = (F.size("interests") + F.size("research_areas") > 0).alias("told")
    s = T.user_profile(spark, sf_dir).select("user_id", told).join(tiers.select("user_id", "tier"), "user_id", "left").join(recs, "user_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    strategy = (F.when(n == 0, "no_data").when(F.col("tier") != "cold", "hybrid").when(F.col("told"), "cold_start").otherwise("popular"))
    return s.select("user_id", strategy.alias("strategy"), n.alias("count"))
