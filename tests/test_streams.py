"""Streams: replayed and interrupted batches, and any number of files per batch."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators.store import read_table, write_table
from lectern.session import AS_OF
from lectern.streaming import streams as X


def events(spark, path, files=3):
    """Events in `files` files, the later files holding earlier times; the first file's ids come again in the last."""
    t = dt.datetime(2024, 1, 30)
    kinds = ["view", "purchase", "error", "signup"]
    rows = [(i, t + dt.timedelta(minutes=(i * 37) % 4000), i % 5, kinds[i % 4], "{\"k\": %d}" % (i % 7)) for i in range(90)]
    cut = len(rows) // files
    parts = [rows[k * cut:(k + 1) * cut] for k in range(files)][::-1]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, props string").coalesce(1) \
            .write.mode("append").parquet(path)
    return rows


def as_set(df, *cols):
    rows = [tuple(r) for r in df.select(*cols).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def landed_events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    return path, events(spark, path)


@pytest.mark.parametrize("max_files", [None, 1])
def test_counts_and_library_whatever_the_batches(spark, landed_events, max_files):
    path, rows = landed_events
    want = {}
    for i, ts, u, kind, _ in rows:
        w = want.setdefault((u, ts.replace(minute=0)), [0, 0])
        w[0] += 1
        w[1] += kind == "error"
    got = as_set(X.stream_run_health(spark, path, max_files=max_files), "api_config_id", "window_start", "runs", "failed")
    assert got == {(u, w, a, b) for (u, w), (a, b) in want.items()}
    quota = as_set(X.stream_quota(spark, path, limit=3, max_files=max_files), "api_config_id", "window_start", "used", "remaining")
    assert quota == {(u, w, a, max(0, 3 - a)) for (u, w), (a, _) in want.items()}
    last = {}
    for i, ts, u, kind, props in rows:
        if kind in ("purchase", "error"):
            key = (u, f"doc:{i % 7}")
            last[key] = max(last.get(key, (dt.datetime.min, -1, "")), (ts, i, kind))
    saved = as_set(X.stream_library(spark, path, max_files=max_files), "user_id", "external_id", "saved_at")
    assert saved == {(*key, ts) for key, (ts, _, kind) in last.items() if kind == "purchase"}
    acts = as_set(X.stream_activity(spark, path, max_files=max_files), "id")
    assert acts == {(r[0],) for r in rows}


def test_api_health_over_the_streamed_log(spark, landed_events):
    path, _ = landed_events
    cfg = spark.createDataFrame([(k, f"s{k}", True, 1) for k in range(7)], "id long, name string, is_active boolean, fetch_interval_hours int")
    got = as_set(X.stream_api_health(spark, path, cfg, AS_OF, max_files=1), "source_id", "issue")
    assert {(5, "no_recent_runs"), (6, "no_recent_runs")} <= got


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "profiles")
    batch = spark.createDataFrame([(f"doc:{i}", f"title {i}", "graph networks and graph learning") for i in range(6)],
                                  "external_id string, title string, abstract string")
    sink = X.enrich_sink(out, batch.schema)
    sink(batch.limit(4), 0)
    sink(batch, 1)
    first = as_set(spark.read.parquet(out), "external_id", "batch")
    assert sorted(x for x, _ in first) == [f"doc:{i}" for i in range(6)]
    sink(batch.where("external_id in ('doc:4', 'doc:5')"), 1)
    for _ in range(2):
        sink(batch.limit(4), 0)
    assert {x for x, _ in as_set(spark.read.parquet(out), "external_id", "batch")} == {f"doc:{i}" for i in range(6)}


def test_a_batch_that_stopped_half_way_is_not_seen(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    X.batch_sink(out)(df, 0)
    (tmp_path / "t" / "batch=1" / "_temporary").mkdir(parents=True)  # what a dead writer leaves
    assert as_set(X.landed(spark, out, df.schema), "id", "batch") == {(1, 0)}
    X.batch_sink(out)(df.selectExpr("id + 1 as id", "v"), 1)
    assert as_set(X.landed(spark, out, df.schema), "id", "batch") == {(1, 0), (2, 1)}


def test_only_a_missing_folder_counts_as_empty(spark, tmp_path):
    schema = StructType().add("id", "long")
    assert X.landed(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "bad" / "batch=0").mkdir(parents=True)
    (tmp_path / "bad" / "batch=0" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        X.landed(spark, str(tmp_path / "bad"), schema).count()


def test_folders_are_merged_and_a_replay_changes_nothing(spark, tmp_path):
    """40 batches of which every fifth reading would open 40 folders: with merging every 4, at most 5 and the merged one."""
    def added(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))
    table = X.Batches(str(tmp_path / "t"), added, every=4)
    sink = X.batch_sink(table)
    batch = lambda i: spark.createDataFrame([(i % 3, 1), (7, i)], "k long, n long").coalesce(1)
    schema = batch(0).schema
    want = {}
    for i in range(14):
        sink(batch(i), i)
        if i % 6 == 5:
            sink(batch(i), i)  # executed again
        for k, n in ((i % 3, 1), (7, i)):
            want[k] = want.get(k, 0) + n
        assert {r.k: r.n for r in added(X.landed(spark, table, schema)).collect()} == want
        assert len(X.landed(spark, table, schema).inputFiles()) <= 2 * 5 + 1
    now = X.read_pointer(spark, f"{table.out}/_current")
    assert now["upto"] == 11 and table.fresh(spark, now["upto"]) == [12, 13]
    for old in (0, 5, 11):
        sink(batch(old), old)  # long merged
    table.compact(spark, 12, schema)
    sink(batch(12), 12)
    assert {r.k: r.n for r in added(X.landed(spark, table, schema)).collect()} == want
    assert len([f for f in X.folders(spark, table.out) if f.startswith("merged-")]) <= 2
    # a merge that died before the switch is not seen
    batch(0).withColumn("batch", F.lit(0)).write.parquet(f"{table.out}/merged-13-dead")
    assert {r.k: r.n for r in added(X.landed(spark, table, schema)).collect()} == want


def test_streams_merged_on_the_way_equal_streams_that_are_not(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    events(spark, path, files=9)
    whole = [as_set(X.stream_library(spark, path), "user_id", "external_id", "saved_at"), as_set(X.stream_activity(spark, path), "id"),
             as_set(X.stream_run_health(spark, path), "api_config_id", "window_start", "runs", "failed")]
    monkeypatch.setattr(X, "EVERY", 2)
    merged = [as_set(X.stream_library(spark, path, max_files=1), "user_id", "external_id", "saved_at"), as_set(X.stream_activity(spark, path, max_files=1), "id"),
              as_set(X.stream_run_health(spark, path, max_files=1), "api_config_id", "window_start", "runs", "failed")]
    assert merged == whole


def test_a_rebuild_that_dies_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(ValueError):
        read_table(spark, path)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    write_table(rows(1, 2), path)
    opened = read_table(spark, path)
    write_table(rows(3), path)
    assert as_set(read_table(spark, path), "id") == {(3,)} and as_set(opened, "id") == {(1,), (2,)}
    rows(9).write.parquet(f"{path}/v3-dead")  # written, not switched to
    with pytest.raises(Exception):
        write_table(rows(4).selectExpr("raise_error('lost') as id"), path)
    assert as_set(read_table(spark, path), "id") == {(3,)}
    write_table(rows(5).withColumn("p", F.lit(1)), path, ["p"])
    assert as_set(read_table(spark, path), "id") == {(5,)} and len(X.folders(spark, path)) == 2
