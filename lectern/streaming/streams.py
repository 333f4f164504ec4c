"""Structured Streaming forms of the periodic jobs.

Every stream reads a file source (new files of a landing folder) and writes each
micro-batch through `foreachBatch` into a folder of its own, `batch=<id>`.  A batch
that is executed again replaces its own folder and nothing else, and no batch reads
what it wrote itself, so replays and crashes between writes change nothing.  The
table is what the folders give when they are merged on reading: by key for upserts,
by sum for counts.  Every `EVERY` batches the folders are merged into one and an
atomic pointer names it and the last batch in it (`Batches`), so a read opens a bounded
number of folders however many batches there were; a batch that is executed again
after that is in the merged folder already and is left out.  Batches hold what they add,
reduced by key in the JVM; there is no streaming state to grow, no complete-mode rewrite,
and a late row counts whenever it comes.  `max_files` bounds a micro-batch (None: all files that are there).

`run_available` drives a stream with `trigger(availableNow=True)`: everything landed
so far is processed, then the query stops - the scheduler's periodic job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.vectors import Tfidf
from lectern.session import ensure_checkpoint_dir
from lectern.sources.files import delete, folders, read_pointer, write_pointer


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (spark.checkpoint.dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_available(writer, checkpoint: str) -> None:
    """Run a DataStreamWriter over all currently available input, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def file_glob(path: str) -> str:
    """A file source watches a folder or a glob; a single landed file becomes a glob
    matching just it (its folder then is the watched location)."""
    return path if any(ch in path for ch in "*?[") else path[:-1] + "[" + path[-1] + "]"


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(file_glob(path))


def events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    ev = file_stream(spark, path, max_files)
    return ev.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in ev.columns else ev


EVERY = 16


def batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch={batch_id}"


class Batches:
    """The folders of a stream's table.

    merge: rows of any batches (with their number in `batch`) -> the rows that stand for them, same columns; merging
    merged rows again with later ones must give what merging all at once gives.
    """

    def __init__(self, out: str, merge: Callable[[DataFrame], DataFrame], every: int | None = None):
        self.out, self.merge, self.every = out, merge, every or EVERY

    def _now(self, spark: SparkSession) -> dict:
        return read_pointer(spark, f"{self.out}/_current") or {"upto": -1, "merged": None}

    def fresh(self, spark: SparkSession, upto: int) -> list[int]:
        """Batches behind the merged ones."""
        return sorted(n for f in folders(spark, self.out) if f.startswith("batch=") and (n := int(f[6:])) > upto)

    def write(self, df: DataFrame, batch_id: int) -> None:
        """The batch's own folder; then, if it is time, all batches before this one are merged.  (This one may come again.)"""
        spark = df.sparkSession
        now = self._now(spark)
        if batch_id <= now["upto"]:
            return
        df.write.mode("overwrite").parquet(batch_folder(self.out, batch_id))
        if batch_id - 1 - now["upto"] >= self.every:
            self.compact(spark, batch_id - 1, df.schema)

    def compact(self, spark: SparkSession, upto: int, schema: StructType) -> None:
        now = self._now(spark)
        rows = self.merge(self.read(spark, schema).where(F.col("batch") <= upto))
        name = f"merged-{upto}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.out}/{name}")
        write_pointer(spark, f"{self.out}/_current", {"upto": upto, "merged": name})
        for f in folders(spark, self.out):  # what the pointer before this one named stays for those who read it
            if f.startswith("merged-") and f not in (name, now["merged"]) or f.startswith("batch=") and int(f[6:]) <= now["upto"]:
                delete(spark, f"{self.out}/{f}")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The rows of the merged folder and of the batches behind it, with their `batch`."""
        whole = StructType([f for f in schema if f.name != "batch"]).add("batch", "long")
        now = self._now(spark)
        paths = [batch_folder(self.out, n) for n in self.fresh(spark, now["upto"])]
        df = spark.read.schema(whole).option("basePath", self.out).parquet(*paths) if paths else spark.createDataFrame([], whole)
        return df.unionByName(spark.read.schema(whole).parquet(f"{self.out}/{now['merged']}")) if now["merged"] else df


def first_of(key: str) -> Callable[[DataFrame], DataFrame]:
    """Merging rule: of the rows of a key the one of the earliest batch."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*")
    return merge


def batch_sink(out: str | Batches, reduce: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes `reduce(batch)` to the batch's own folder (and has folders merged, given `Batches`)."""
    def sink(df: DataFrame, batch_id: int) -> None:
        if isinstance(out, Batches):
            out.write(reduce(df), batch_id)
        else:
            reduce(df).write.mode("overwrite").parquet(batch_folder(out, batch_id))
    return sink


def landed(spark: SparkSession, out: str | Batches, schema: StructType) -> DataFrame:
    """All batches written to `out`, with their `batch` number; empty if there is none yet."""
    return (out if isinstance(out, Batches) else Batches(out, lambda rows: rows)).read(spark, schema)


def _run(df: DataFrame, sink: Callable[[DataFrame, int], None], folder: str) -> None:
    run_available(df.writeStream.foreachBatch(sink), f"{folder}/ckpt")


# ---------------------------------------------------------------- X1

def stream_activity(spark: SparkSession, events_path: str, max_files: int | None = None) -> DataFrame:
    """Events -> validated activity rows (user and type required), one row per event id
    however often it is delivered.  Returns the table."""
    from lectern.sources.tables import _ACT
    d = work_dir(spark, "activity")
    ev = events_stream(spark, events_path, max_files)
    k = F.get_json_object("props", "$.k").cast("bigint")
    atype = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in _ACT.items()])
    act = (ev.select(F.col("event_id").alias("id"), "user_id", atype.alias("activity_type"),
                     F.when(atype == "search", F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("doc:"), k.cast("string"))).alias("content_id"),
                     F.col("ts").alias("created_at"))
           .filter(F.col("user_id").isNotNull() & F.col("activity_type").isNotNull()))
    out = Batches(f"{d}/out", first_of("id"))
    _run(act, batch_sink(out, lambda b: b.dropDuplicates(["id"])), d)
    return first_of("id")(landed(spark, out, act.schema)).drop("batch")


# ---------------------------------------------------------------- X3 / X5

def _fetch_log(ev: DataFrame) -> DataFrame:
    """Events as runs of the fetch log (see sources.tables.api_fetch_log)."""
    return ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("api_config_id"), F.col("ts").alias("started_at"),
                     F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))


def _windowed(runs: DataFrame, window: str) -> DataFrame:
    return (runs.groupBy("api_config_id", F.window("started_at", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("runs"),
                 F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).cast("bigint").alias("failed"))
            .select("api_config_id", F.col("w.start").alias("window_start"), "runs", "failed"))


def run_counts(spark: SparkSession, events_path: str, name: str, window: str, max_files: int | None) -> DataFrame:
    """Runs and failures per source and event-time window: each batch adds its own counts."""
    d = work_dir(spark, name)
    runs = _fetch_log(events_stream(spark, events_path, max_files))

    def added(rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("runs", "failed")]
        return rows.groupBy("api_config_id", "window_start").agg(*sums, F.max("batch").alias("batch"))

    out = Batches(f"{d}/out", added)
    _run(runs, batch_sink(out, lambda b: _windowed(b, window)), d)
    return added(landed(spark, out, _windowed(spark.createDataFrame([], runs.schema), window).schema)).drop("batch")


def stream_run_health(spark: SparkSession, events_path: str, window: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """Runs and failed runs per source per event-time window."""
    return run_counts(spark, events_path, "run-health", window, max_files)


def stream_api_health(spark: SparkSession, events_path: str, cfg: DataFrame, as_of: str, max_files: int | None = None) -> DataFrame:
    """X5 with the health rules (A10): the fetch log grows by micro-batches, each run once, and the
    rules are evaluated over it."""
    from lectern.operators.monitor import api_health
    d = work_dir(spark, "api-health")
    ev = events_stream(spark, events_path, max_files)
    runs = _fetch_log(ev).withColumn("articles_saved", F.when(F.col("status") == "success", F.lit(0)).otherwise(0))
    out = Batches(f"{d}/out", first_of("id"))
    _run(runs, batch_sink(out), d)
    log = first_of("id")(landed(spark, out, runs.schema)).drop("batch")
    return api_health(cfg, log, as_of)


def stream_quota(spark: SparkSession, events_path: str, limit: int = 500, window: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """X3a as a stream: requests per source per tumbling window and the remaining quota."""
    c = run_counts(spark, events_path, "quota", window, max_files)
    return c.select("api_config_id", "window_start", F.col("runs").alias("used"),
                    F.greatest(F.lit(0), F.lit(limit) - F.col("runs")).alias("remaining"))


# ---------------------------------------------------------------- X4

def _latest(rows: DataFrame) -> DataFrame:
    """The latest save / remove event of each (user, item): max_by, combined map-side."""
    return (rows.groupBy("user_id", "external_id")
            .agg(F.max(F.struct("last_at", "last_id", "last_type")).alias("m")).select("user_id", "external_id", "m.*"))


def stream_library(spark: SparkSession, events_path: str, max_files: int | None = None) -> DataFrame:
    """Library state.  A batch is reduced to its latest event per (user, item); reading
    reduces the batches alike, so events may come in any order."""
    d = work_dir(spark, "library")
    ev = events_stream(spark, events_path, max_files)
    k = F.get_json_object("props", "$.k").cast("bigint")
    typ = F.when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "error", "remove_save")
    act = (ev.select("user_id", F.concat(F.lit("doc:"), k.cast("string")).alias("external_id"),
                     F.col("ts").alias("last_at"), F.col("event_id").alias("last_id"), typ.alias("last_type"))
           .filter(F.col("last_type").isNotNull()))
    out = Batches(f"{d}/out", lambda rows: _latest(rows).withColumn("batch", F.lit(0).cast("long")))
    _run(act, batch_sink(out, _latest), d)
    return (_latest(landed(spark, out, act.schema)).filter(F.col("last_type") == "save")
            .select("user_id", "external_id", F.col("last_at").alias("saved_at")))


# ---------------------------------------------------------------- X2 / X6

def enrich_sink(out: str | Batches, schema: StructType, model: Tfidf | None = None) -> Callable[[DataFrame, int], None]:
    """Profiles of the batch's items that no earlier batch has; the batch's own folder is not
    looked at, so that a replay makes the same profiles again."""
    from lectern.operators.enrich import enrich
    table = out if isinstance(out, Batches) else Batches(out, first_of("external_id"))

    def process(batch: DataFrame, batch_id: int) -> None:
        done = landed(batch.sparkSession, table, StructType([schema["external_id"]])).filter(F.col("batch") != batch_id)
        todo = batch.join(done.select("external_id"), "external_id", "left_anti").dropDuplicates(["external_id"])
        table.write(enrich(todo, "external_id", F.lit("article"), model=model), batch_id)
    return process


def stream_enrich(spark: SparkSession, documents_path: str, max_files: int | None = None, model_path: str | None = None) -> DataFrame:
    """New content files -> profiles for items without one (anti join against the
    profile table); vectors by the saved TF-IDF model, or hashes without one (M1)."""
    from lectern.operators.enrich import enrich
    d = work_dir(spark, "enrich")
    docs = file_stream(spark, documents_path, max_files)
    content = docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("external_id"),
                          F.trim(F.substring("text", 1, 60)).alias("title"), F.col("text").alias("abstract"))
    out = Batches(f"{d}/profiles", first_of("external_id"))
    model = Tfidf.load(spark, model_path) if model_path else None
    _run(content, enrich_sink(out, content.schema, model), d)
    return landed(spark, out, enrich(spark.createDataFrame([], content.schema), "external_id", F.lit("article")).schema)


def stream_ingest(spark: SparkSession, landed_dir: str, max_files: int | None = None) -> DataFrame:
    """Landed OpenAlex payload files (one JSON page per line) -> S1 -> S6 -> S18 upsert by
    external_id: per column the latest batch that gives a value."""
    from lectern.operators.store import upsert
    from lectern.sources.normalizers import normalize_openalex
    from lectern.sources.payloads import OPENALEX_SCHEMA
    d = work_dir(spark, "ingest")
    reader = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    raw = reader.text(landed_dir)
    items = raw.select(F.explode(F.from_json("value", OPENALEX_SCHEMA)["results"]).alias("item"))
    arts = normalize_openalex(items)

    def upserted(rows: DataFrame) -> DataFrame:
        table, _ = upsert(spark.createDataFrame([], arts.schema), rows, ["external_id"], "batch", "not_null")
        # what is merged comes before every later batch
        return table.drop("op").withColumn("batch", F.lit(-1).cast("long"))

    out = Batches(f"{d}/out", upserted)
    _run(arts, batch_sink(out), d)
    return upserted(landed(spark, out, arts.schema)).drop("batch")
