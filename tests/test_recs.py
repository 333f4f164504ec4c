"""Recommendation operators against numpy / plain-Python brute force."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import monitor as M
from lectern.operators import recs as R
from lectern.operators.similarity import block_top_k, plan_cells
from lectern.operators.svd import truncated_svd


def test_block_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    Q = rng.normal(size=(37, 8))
    I = rng.normal(size=(53, 8))
    I[5] = I[4]  # exact tie
    q = spark.createDataFrame([(int(i), Q[i].tolist(), int(i % 3)) for i in range(len(Q))],
                              "qid long, qv array<double>, extra long")
    it = spark.createDataFrame([(f"i{j:03d}", I[j].tolist()) for j in range(len(I))], "iid string, iv array<double>")
    got = block_top_k(q, it, 5, "qid", "iid", "qv", "iv", block_rows=10).collect()
    got = {(r.qid, r.rank): r.iid for r in got}
    S = Q @ I.T
    for i in range(len(Q)):
        order = sorted(range(len(I)), key=lambda j: (-round(S[i, j], 9), f"i{j:03d}"))[:5]
        for rank, j in enumerate(order, 1):
            assert got[(i, rank)] == f"i{j:03d}"


def test_bounds_prune_and_stay_exact(spark):
    """Forty clusters: few pairs are scored, and the answer is the brute-force one (extra, unequal lengths, nulls included)."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(40, 16)) * 3
    I = np.concatenate([c + rng.normal(size=(30, 16)) * 0.05 for c in centres])
    Q = np.concatenate([c + rng.normal(size=(4, 16)) * 0.05 for c in centres])
    items = [(f"i{j:04d}", v.tolist()) for j, v in enumerate(I)] + [("short", [9.0, 9.0]), ("null", None), ("hole", [None] + [1.0] * 15), ("empty", [])]
    it = spark.createDataFrame(items, "iid string, iv array<double>").repartition(5)
    q = spark.createDataFrame([(j, v.tolist(), j % 4) for j, v in enumerate(Q)] + [(900, [1.0, 2.0], 0), (901, [], 0), (902, None, 0), (903, [1.0] * 3, 0)],
                              "qid long, qv array<double>, extra long")
    args = (5, "qid", "iid", "qv", "iv")
    S = Q @ I.T
    got = {}
    for r in block_top_k(q, it, *args, extra="extra", block_rows=30, final=False).collect():
        got.setdefault(r.qid, set()).add(r.iid)
    for j in range(len(Q)):
        best = [f"i{i:04d}" for i in sorted(range(len(I)), key=lambda i: (-round(S[j, i], 9), i))[:5 + j % 4]]
        assert set(best) <= got[j]
    assert got.pop(900) == {"short"} and set(got) == set(range(len(Q)))
    item_rows, query_rows = plan_cells(q, it, *args, block_rows=30)
    key = ["_dim", "_cell", "_part"]
    pairs = query_rows.join(item_rows.groupBy(*key).count(), key).agg(F.sum("count")).first()[0]
    assert pairs < 0.2 * len(Q) * len(I)
    blocks = {tuple(r[:3]): r["count"] for r in item_rows.groupBy(*key).count().collect()}
    assert sum(blocks.values()) == len(I) + 1 and max(blocks.values()) < 90 and any(part > 0 for _, _, part in blocks)


def test_block_top_k_of_nothing(spark):
    q = spark.createDataFrame([(1, [1.0])], "qid long, qv array<double>")
    it = spark.createDataFrame([], "iid string, iv array<double>")
    assert block_top_k(q, it, 3, "qid", "iid", "qv", "iv").count() == 0
    assert block_top_k(q.limit(0), it.union(spark.createDataFrame([("a", [1.0])], "iid string, iv array<double>")), 3, "qid", "iid", "qv", "iv").count() == 0


def test_mmr_by_hand(spark):
    """Best first; then 0.7 * score - 0.3 * greatest similarity to what is chosen.

    a (1.0) first.  b is like a: 0.63 - 0.3 = 0.33; c is orthogonal: 0.35; d has no vector: 0.14; e is opposite: 0.28.
    c second.  b 0.33, e 0.28 (below 0 counts as 0), d 0.14: b third.
    """
    cands = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.9, 2), (1, "c", 0.5, 3), (1, "d", 0.2, 4), (1, "e", 0.4, 5),
                                   (2, "a", 0.3, 1), (2, "c", 0.4, 2)], "user_id long, external_id string, score double, order_key long")
    prof = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("e", [-1.0, 0.0])],
                                 "external_id string, embedding array<double>")
    got = {(r.user_id, r["rank"]): r.external_id for r in R.mmr(cands, prof, 0.7, 3).collect()}
    assert got == {(1, 1): "a", (1, 2): "c", (1, 3): "b", (2, 1): "c", (2, 2): "a"}


def test_svd_reconstruction(spark):
    rng = np.random.default_rng(11)
    rows = []
    for u in range(12):
        for j in rng.choice(9, size=4, replace=False):
            rows.append((u, f"doc:{j}", float(rng.choice([1.0, 3.0, 4.0]))))
    m = spark.createDataFrame(rows, "user_id long, external_id string, w double")
    svd = R.fit_svd(m, k=5)
    U = {r.user_id: np.array(r.x) for r in svd.rows.collect()}
    V = {r.external_id: np.array(r.x) for r in svd.columns.collect()}
    users = sorted(U)
    items = sorted(V)
    A = np.zeros((len(users), len(items)))
    for u, i, w in rows:
        A[users.index(u), items.index(i)] += w
    u_, s_, vt = np.linalg.svd(A, full_matrices=False)
    rec = (u_[:, :5] * s_[:5]) @ vt[:5]
    mine = np.array([[U[u] @ V[i] for i in items] for u in users])
    assert np.abs(rec - mine).max() < 1e-8


def explained(A, k):
    u, s, _ = np.linalg.svd(A, full_matrices=False)
    return (u[:, :k] * s[:k]).var(axis=0).sum() / A.var(axis=0).sum()


def test_svd_by_blocks_narrower_than_the_matrix(spark):
    """A block of k + 4 vectors against 70 columns: several cycles, with a user and an item that hold a third of all cells."""
    rng = np.random.default_rng(12)
    A = np.round(rng.random((90, 70)) ** 6 * 5) + np.outer(np.arange(90) % 7, np.arange(70) % 5)
    A[3], A[:, 5] = 1 + np.arange(70) % 3, 2
    rows = [(u, f"i{j}", float(A[u, j])) for u in range(90) for j in range(70) if A[u, j]]
    m = spark.createDataFrame(rows, "user_id long, external_id string, w double").repartition(7)
    got = truncated_svd(m, "user_id", "external_id", 8, oversample=4)
    u, s, vt = np.linalg.svd(A, full_matrices=False)
    assert got.cycles > 1 and got.residual <= 1e-7
    assert np.allclose(got.values, s[:8], rtol=1e-9)
    U = {r.user_id: np.array(r.x) for r in got.rows.collect()}
    V = {r.external_id: np.array(r.x) for r in got.columns.collect()}
    mine = np.array([[U[a] @ V[f"i{j}"] for j in range(70)] for a in range(90)])
    assert np.abs(mine - (u[:, :8] * s[:8]) @ vt[:8]).max() < 1e-6
    assert abs(got.explained - explained(A, 8)) < 1e-9


def test_svd_of_low_rank_and_no_weight(spark):
    m = spark.createDataFrame([(u, f"i{j}", float((u + 1) * (j + 2))) for u in range(6) for j in range(5)], "user_id long, external_id string, w double")
    got = truncated_svd(m, "user_id", "external_id", 3)
    assert len(got.values) == 1 and abs(got.explained - 1) < 1e-12
    assert truncated_svd(m.withColumn("w", F.lit(0.0)), "user_id", "external_id", 3) is None
    assert truncated_svd(m.limit(0), "user_id", "external_id", 3) is None


def test_svd_skips_tiny(spark):
    m = spark.createDataFrame([(1, "a", 1.0), (2, "b", 3.0)], "user_id long, external_id string, w double")
    assert R.fit_svd(m) is None


def test_interaction_tiers_boundaries(spark):
    counts = {1: 2, 2: 3, 3: 4, 4: 5, 5: 50, 6: 51}
    rows, eid = [], 0
    for u, n in counts.items():
        for _ in range(n):
            rows.append((eid, u, "view", "doc:1", dt.datetime(2024, 1, 1)))
            eid += 1
    act = spark.createDataFrame(rows, "id long, user_id long, activity_type string, content_id string, created_at timestamp")
    users = spark.createDataFrame([(7,)], "user_id long")
    t = {r.user_id: (r.tier, r.alpha, r.beta) for r in R.interaction_tiers(act, users).collect()}
    assert t[1] == ("cold", None, None) and t[7] == ("cold", None, None)
    assert t[2] == ("light", 0.9, 0.1) and t[3] == ("light", 0.9, 0.1)
    assert t[4] == ("regular", 0.65, 0.35) and t[5] == ("regular", 0.65, 0.35)
    assert t[6] == ("heavy", 0.5, 0.5)


def test_success_ema_equals_sequential_fold(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for k in range(6):
        n = int(rng.integers(1, 60))
        oks = rng.random(n) < 0.6
        r = 0.0
        for i, ok in enumerate(oks):
            r = ((r * 9 + 100) / 10 if r else 100.0) if ok else (r * 9 / 10 if r else 0.0)
            rows.append((k * 1000 + i, k, "success" if ok else "failed",
                         dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(i * 7))))
        expected[k] = r
    runs = spark.createDataFrame(rows, "id long, scraper_config_id long, status string, started_at timestamp")
    got = {r.scraper_config_id: r.success_rate for r in M.success_ema(runs).collect()}
    for k, v in expected.items():
        assert abs(got[k] - v) < 1e-9, (k, got[k], v)


def test_success_ema_of_a_hot_source_and_of_long_failures(spark):
    """Source 1 holds a third of all rows over 200 slices; source 2 fails 8,000 times in a row: a double then stands at
    2e-323, not at 0, so the next success gives 10 as in the fold."""
    rows = spark.range(24_000).selectExpr("id", "case when id % 3 = 0 then 1 when id < 100 then 3 else 2 end as scraper_config_id",
                                          "case when id % 3 = 0 and id % 7 < 4 or id = 100 or id = 23999 then 'success' else 'failed' end as status",
                                          "timestamp_seconds(1700000000 + id div 5) as started_at")
    want = {}
    for i in range(24_000):
        k = 1 if i % 3 == 0 else 3 if i < 100 else 2
        ok = i % 3 == 0 and i % 7 < 4 or i in (100, 23_999)
        r = want.get(k, 0.0)
        want[k] = ((r * 9 + 100) / 10 if r else 100.0) if ok else (r * 9 / 10 if r else 0.0)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.scraper_config_id: r.success_rate for r in M.success_ema(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and want[3] == 0 and round(want[2], 9) == 10


def test_sessions_stitched_over_slices(spark):
    """A third of all requests is one source's; sessions go on over many of the 60 slices, gaps of just 60 s end them."""
    rng = np.random.default_rng(4)
    base = dt.datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(700):
        t += float(rng.choice([0, 5, 59.999999, 60, 61, 300], p=[0.1, 0.55, 0.2, 0.05, 0.05, 0.05]))
        rows.append((1, base + dt.timedelta(seconds=t)))
    rows += [(int(k), base + dt.timedelta(seconds=int(s))) for k, s in zip(rng.integers(2, 9, 1300), rng.integers(0, 20_000, 1300))]
    rows += [(None, base), (None, base + dt.timedelta(seconds=30))]
    want = []
    for k in {r[0] for r in rows}:
        own = sorted(x for j, x in rows if j == k)
        for i, x in enumerate(own):
            if not i or (x - own[i - 1]).total_seconds() >= 60:
                want.append([k, x, 0])
            want[-1][2] += 1
    df = spark.createDataFrame(rows, "src long, started_at timestamp")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r.src, r.session_start, r.used) for r in M.quota_session(df, "src", 30, 60).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str)


def test_quota_sliding_buckets_are_exact(spark):
    rng = np.random.default_rng(9)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, int(rng.integers(0, 3)), base + dt.timedelta(seconds=float(rng.uniform(0, 1000))))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id long, src long, started_at timestamp")
    got = {r.id: r.used for r in M.quota_sliding(df, "src", 30, seconds=60, bucket_seconds=100).collect()}
    for i, s, t in rows:
        want = sum(1 for _, s2, t2 in rows if s2 == s and t - dt.timedelta(seconds=60) < t2 <= t)
        assert got[i] == want


def test_candidates_do_not_grow_with_the_blocks(spark, monkeypatch):
    """Few selected items make weak thresholds: still a query keeps `k` + extra candidates in all, not in each of 40 blocks,
    and of 200 equal scores those with the least ids."""
    from lectern.operators import similarity
    monkeypatch.setattr(similarity, "SELECTED", 8)
    monkeypatch.setattr(similarity, "PER_CELL", 1)
    rng = np.random.default_rng(3)
    I, Q = rng.normal(size=(400, 8)), rng.normal(size=(30, 8))
    I[100:300] = Q[0] * 9
    it = spark.createDataFrame([(f"i{j:03d}", I[j].tolist()) for j in range(400)], "iid string, iv array<double>").repartition(7)
    q = spark.createDataFrame([(i, Q[i].tolist(), i % 3) for i in range(30)], "qid long, qv array<double>, extra long")
    rows = block_top_k(q, it, 5, "qid", "iid", "qv", "iv", extra="extra", block_rows=10, final=False).collect()
    S = Q @ I.T
    for i in range(30):
        best = sorted(range(400), key=lambda j: (-round(S[i, j], 9), j))[:5 + i % 3]
        mine = {r.iid for r in rows if r.qid == i}
        assert {f"i{j:03d}" for j in best} <= mine and len(mine) <= 3 * len(best)
    assert {f"i{100 + j}" for j in range(5)} <= {r.iid for r in rows if r.qid == 0}


def test_grid_shuffles_in_proportion():
    """Ten times the queries and items: groups grow by their memory alone, far below the hundredfold of all pairs."""
    from lectern.operators.similarity import KEPT, _grid

    def copies(n_q, n_i):
        g, s = _grid(n_q, 140, 512, n_i, 256, 48)
        assert n_q * 140 / g <= KEPT
        return g * n_i * 300 + s * n_q * 6000
    assert copies(540_000, 600_000) < 10 * copies(90_000, 100_000) < 100e9
    assert _grid(125, 20, 3072, 500_000, 3072, 48)[0] == 1  # few queries: the items travel once


def test_mmr_sends_a_vector_once_to_a_group(spark):
    """Vectors are joined to the distinct items of a group of users; two profiles of an item stand for a candidate each."""
    cands = spark.createDataFrame([(u, f"i{j}", 1.0 - j / 100, j) for u in range(50) for j in range(30)], "user_id long, external_id string, score double, order_key long")
    prof = spark.createDataFrame([(f"i{j}", [float(j % 3), 1.0]) for j in [*range(30), 0]], "external_id string, embedding array<double>")
    out = R.mmr(cands, prof, 0.7, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Aggregate [_g" in plan
    rows = out.collect()
    assert len(rows) == 150 and {r.external_id for r in rows if r["rank"] == 1} == {"i0"}
    assert len({tuple(sorted((x["rank"], x.external_id) for x in rows if x.user_id == u)) for u in range(50)}) == 1


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_response_fetches_texts_last(spark, monkeypatch):
    """Nothing below the last join holds a text but the content itself; an item of both tables is answered from articles, one
    of neither is left out, and a user without any has one row."""
    from lectern.plans import recs as P
    content = "external_id string, title string, abstract string, published_date date, source_name string"
    tables = {
        "article": spark.createDataFrame([("a", "A", "text a", dt.date(2024, 1, 2), None), ("b", "B", None, None, "src1"), ("b", "B2", "x", None, "src2")], content),
        "scraped_content": spark.createDataFrame([("a", "other", "other", None, "src11"), ("c", "C", "text c", None, None), (None, "N", "n", None, "src12")], content),
        "user_profile": spark.createDataFrame([(1, ["x"], []), (2, [], []), (3, ["y"], ["z"])], "user_id long, interests array<string>, research_areas array<string>"),
        "user_activity": spark.createDataFrame([(i, 4, "view", "a", dt.datetime(2024, 1, 1)) for i in range(3)], "id long, user_id long, activity_type string, content_id string, created_at timestamp"),
    }
    for name, df in tables.items():
        monkeypatch.setattr(P.T, name, lambda *a, df=df: df)
    recs = spark.createDataFrame([(1, "a", 0.9, 1), (1, "gone", 0.8, 2), (2, "c", 4.0, 1), (2, "b", 3.0, 2), (3, None, 0.5, 1), (4, "a", 0.7, 1)],
                                 "user_id long, external_id string, score double, rank int")
    out = P.respond(spark, None, recs)
    joins = [n for n in _nodes(out._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert not any("abstract" in j.output().toString() for j in joins[1:])
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, "cold_start", 1, "a", "A", "text a", "2024-01-02", "Unknown", 0.9),
        (2, "popular", 1, "c", "C", "text c", "", "Scraper", 4.0),
        (2, "popular", 2, "b", "B", "", "", "src1", 3.0), (2, "popular", 2, "b", "B2", "x", "", "src2", 3.0),
        (3, "no_data", None, None, None, None, None, None, None),
        (4, "hybrid", 1, "a", "A", "text a", "2024-01-02", "Unknown", 0.7)]


def test_svd_keeps_the_blocks_of_one_cycle(spark):
    from lectern.session import ensure_checkpoint_dir
    from lectern.sources.files import folders
    rng = np.random.default_rng(12)
    m = spark.createDataFrame([(u, f"i{j}", float(rng.random() ** 4)) for u in range(60) for j in range(50)], "user_id long, external_id string, w double")
    count = lambda: sum(f.startswith("svd-") for f in folders(spark, ensure_checkpoint_dir(spark)))
    before = count()
    got = truncated_svd(m, "user_id", "external_id", 4, oversample=3)
    assert got.cycles > 3 and count() - before <= 4
    assert got.rows.count() == 60 and got.columns.count() == 50


def test_selected_items_reach_the_driver_once(spark, monkeypatch):
    """The selection is sorted by tasks and read back; it never comes to the driver as every partition's best.  It is the rows with the
    least hashes, and no more than wanted of an id that all rows bear."""
    from lectern.operators import similarity as S
    monkeypatch.setattr(S, "SELECTED", 50)
    monkeypatch.setattr(S, "PER_CELL", 1)
    it = spark.range(3000).selectExpr("concat('i', id) as iid", "array(cast(id as double), null, 1.0d) as iv").repartition(30)
    it = it.withColumn("iv", F.when(F.col("iid").endswith("7"), F.col("iv")).otherwise(F.array(F.lit(1.0), F.lit(2.0))))
    collected, collect = [], type(it).collect
    monkeypatch.setattr(type(it), "collect", lambda df: collected.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    _, cells, n = S._cells(it, "iid", "iv", 2048)
    assert n == 3000 and collected and not any("TakeOrdered" in p for p in collected)
    chosen = S._selected(it.select(F.col("iid").alias("_iid"), F.col("iv").alias("_vec")), n, 50)
    least = [r.iid for r in collect(it.orderBy(F.xxhash64("iid")).limit(50))]
    assert chosen.column("_iid").to_pylist() == least and cells.copies == 1
    assert [x.shape for x in cells.selected.values()] == [(sum(not i.endswith("7") for i in least), 2)]
    same = it.select(F.lit("one").alias("_iid"), F.col("iv").alias("_vec"))
    assert S._selected(same, 3000, 50).num_rows in (0, 50)
