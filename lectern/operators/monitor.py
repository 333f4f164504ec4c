"""Run logs, health and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.operators.slices import numbered
from lectern.session import AS_OF, stored


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def run_stats(runs: DataFrame, key: str = "scraper_config_id", items: str = "items_found") -> DataFrame:
    """Per source total/ok/failed runs, success % and mean items per successful run."""
    ok = F.col("status") != "failed"
    return (runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.sum(F.when(ok, 1).otherwise(0)).cast("bigint").alias("successful_runs"),
        F.sum(F.when(ok, 0).otherwise(1)).cast("bigint").alias("failed_runs"),
        F.sum(F.when(ok, F.col(items)).otherwise(0)).cast("bigint").alias("total_items"))
        .withColumn("success_rate", F.col("successful_runs") / F.col("total_runs") * 100)
        .withColumn("avg_items_per_run",
                    F.when(F.col("successful_runs") > 0,
                           F.col("total_items") / F.col("successful_runs")).otherwise(0.0)))


def success_ema(runs: DataFrame, key: str = "scraper_config_id") -> DataFrame:
    """The order-dependent success-rate fold, as a scan of affine maps over range slices.

    Fold per source in run order: success r -> (9r+100)/10 (100 when r == 0),
    failure r -> 9r/10.  Before the first success r stays 0 and the first success
    sets 100; from there every run is the affine map r -> 0.9 r + 10 s.  (Failures
    never lead back to 0: in doubles 9r/10 stops falling at 2e-323.)  A run of n
    rows therefore is r -> 0.9^n r + c: each slice of a source (`slices.numbered`) is
    summed up into its (n, c), and a window over a source's slices, one row each, puts the maps together.
    """
    ok = (F.col("status") != "failed").cast("int")
    rows = numbered(runs.select(F.col(key).alias("k"), "started_at", "id", ok.alias("s")), ["k", "started_at", "id"])
    own = rows.groupBy(F.col("k").alias("_k"), F.col("_slice").alias("_at")).agg(F.max("_n").alias("last"))
    first = rows.where("s = 1").groupBy(F.col("k").alias("_f")).agg(F.min("_n").alias("first"))
    placed = rows.join(own, F.col("k").eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_at"))).drop("_k", "_at")
    placed = placed.join(first, F.col("k").eqNullSafe(F.col("_f"))).where(F.col("_n") >= F.col("first"))
    gain = F.when(F.col("_n") == F.col("first"), F.lit(100.0)).otherwise(F.col("s") * 10.0)
    maps = placed.groupBy("k", "_slice").agg(F.count(F.lit(1)).alias("n"), F.sum(gain * F.pow(F.lit(0.9), F.col("last") - F.col("_n"))).alias("c"))
    later = Window.partitionBy("k").orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    rate = maps.groupBy(F.col("k").alias("_k")).agg(F.sum(F.col("c") * F.pow(F.lit(0.9), F.col("later"))).alias("success_rate"))
    return (rows.select("k").distinct().join(rate, F.col("k").eqNullSafe(F.col("_k")), "left")
            .select(F.col("k").alias(key), F.coalesce(F.col("success_rate"), F.lit(0.0)).alias("success_rate")))


def source_totals(runs: DataFrame, cfg: DataFrame, key: str = "api_config_id") -> DataFrame:
    """Per source fetched total, request count, last fetch and next fetch."""
    t = runs.groupBy(key).agg(
        F.sum(F.when(F.col("status") == "success", F.col("articles_saved")).otherwise(0))
        .cast("bigint").alias("total_fetched"),
        F.count(F.lit(1)).alias("total_requests"),
        F.max("started_at").alias("last_fetch"))
    c = cfg.select(F.col("id").alias(key), "name", "is_active", "fetch_interval_hours")
    return (c.join(t, key, "left")
            .withColumn("total_fetched", F.coalesce("total_fetched", F.lit(0)).cast("bigint"))
            .withColumn("total_requests", F.coalesce("total_requests", F.lit(0)).cast("bigint"))
            .withColumn("next_fetch", F.col("last_fetch") + F.make_interval(hours=F.col("fetch_interval_hours"))))


def due_sources(totals: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """active and (never fetched or as_of >= last_fetch + interval)."""
    return totals.filter(F.col("is_active") & (F.col("last_fetch").isNull() | (_ts(as_of) >= F.col("next_fetch"))))


def api_health(cfg: DataFrame, runs: DataFrame, as_of: str = AS_OF, key: str = "api_config_id") -> DataFrame:
    """A10 (intent): per active source, over the last 24 h: no runs -> warning; 3+ failed
    among the latest 5 -> critical; next_fetch older than 2 h -> warning (only when there
    are recent runs).  One row per issue: (source_id, name, issue, severity)."""
    now = _ts(as_of)
    recent = runs.filter((F.col("started_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("started_at") <= now))
    w = Window.partitionBy(key).orderBy(F.col("started_at").desc(), F.col("id").desc())
    latest5 = (recent.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 5)
               .groupBy(key).agg(F.count(F.lit(1)).alias("n_recent"),
                                 F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("n_failed")))
    totals = source_totals(runs, cfg, key)
    s = (totals.filter(F.col("is_active")).join(latest5, key, "left")
         .withColumn("n_recent", F.coalesce("n_recent", F.lit(0))))
    issue = lambda when, name, severity: F.when(when, F.struct(name.alias("issue"), F.lit(severity).alias("severity")))
    issues = F.array(issue(F.col("n_recent") == 0, F.lit("no_recent_runs"), "warning"),
                     issue(F.col("n_failed") >= 3, F.concat(F.col("n_failed").cast("string"), F.lit("_failures_in_last_5")), "critical"),
                     issue((F.col("n_recent") > 0) & (F.col("next_fetch") < now - F.expr("INTERVAL 2 HOURS")), F.lit("overdue"), "warning"))
    # the rules are asked of each source once, not in a pass for each rule
    return (s.select(F.col(key).alias("source_id"), "name", F.explode(F.array_compact(issues)).alias("i"))
            .select("source_id", "name", "i.issue", "i.severity"))


def scraper_health(cfg: DataFrame, runs: DataFrame, as_of: str, key: str = "scraper_config_id") -> DataFrame:
    """A11 (intent): active scrapers that are stale (> 7 days since last run), have a
    success rate < 50 % over 5+ runs, or had an error in the last 24 h."""
    now = _ts(as_of)
    st = run_stats(runs, key)
    last = runs.groupBy(key).agg(
        F.max("started_at").alias("last_run"),
        F.max(F.when((F.col("status") == "failed") & (F.coalesce(F.col("error_message"), F.lit("")) != ""),
                     F.col("started_at"))).alias("last_error_at"))
    c = (cfg.filter(F.col("is_active")).select(F.col("id").alias(key), "name")
         .join(st, key, "left").join(last, key, "left"))
    stale = c.filter(F.col("last_run") < now - F.expr("INTERVAL 7 DAYS")).select(key, "name", F.lit("stale").alias("issue"))
    low = c.filter((F.col("success_rate") < 50) & (F.col("total_runs") >= 5)).select(
        key, "name", F.lit("low_success_rate").alias("issue"))
    err = c.filter(F.col("last_error_at") >= now - F.expr("INTERVAL 24 HOURS")).select(
        key, "name", F.lit("recent_error").alias("issue"))
    return stale.unionByName(low).unionByName(err).withColumnRenamed(key, "scraper_id")


def batch_summary(runs: DataFrame, batch: Column) -> DataFrame:
    """Per batch, sources ok / failed and total saved."""
    return (runs.groupBy(batch.alias("batch")).agg(
        F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).cast("bigint").alias("sources_ok"),
        F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).cast("bigint").alias("sources_failed"),
        F.sum(F.when(F.col("status") == "success", F.col("articles_saved")).otherwise(0)).cast("bigint")
        .alias("total_saved")))


def retain(log: DataFrame, as_of: str = AS_OF, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept rows, deleted rows) for retention of `days` before as_of."""
    cut = _ts(as_of) - F.make_interval(days=F.lit(days))
    return log.filter(F.col("started_at") >= cut), log.filter(F.col("started_at") < cut)


def run_log(counts: DataFrame, source_col: str, started_at: Column, error: Column | None = None) -> DataFrame:
    """One run-log row per source from upsert counts (saved/updated/skipped)."""
    g = counts.groupBy(source_col).agg(
        F.sum("saved").cast("bigint").alias("articles_saved"),
        F.sum("updated").cast("bigint").alias("articles_updated"),
        F.sum("skipped").cast("bigint").alias("articles_skipped"))
    g = g.withColumn("articles_found", F.col("articles_saved") + F.col("articles_updated") + F.col("articles_skipped"))
    return (g.withColumn("started_at", started_at)
            .withColumn("status", F.when(error.isNotNull() if error is not None else F.lit(False), "failed")
                        .otherwise("success"))
            .withColumn("error_message", error if error is not None else F.lit(None).cast("string")))


def nlp_coverage(articles: DataFrame, scraped: DataFrame, profiles: DataFrame) -> DataFrame:
    """Processed, total, unprocessed (>= 0), coverage % (1 dp, 0 when empty)."""
    # one aggregation over the tagged union of the three tables (no join of the counts)
    tagged = (articles.select(F.lit("a").alias("_t"))
              .unionByName(scraped.select(F.lit("s").alias("_t")))
              .unionByName(profiles.select(F.lit("p").alias("_t"))))
    c = tagged.agg(F.count(F.when(F.col("_t") == "a", 1)).alias("total_articles"),
                   F.count(F.when(F.col("_t") == "s", 1)).alias("total_scraped"),
                   F.count(F.when(F.col("_t") == "p", 1)).alias("nlp_processed"))
    total = F.col("total_articles") + F.col("total_scraped")
    return c.select(
        F.col("nlp_processed"), total.alias("total_content"),
        F.greatest(F.lit(0), total - F.col("nlp_processed")).alias("unprocessed"),
        F.when(total > 0, F.round(F.col("nlp_processed") / total * 100, 1)).otherwise(0.0).alias("coverage"))


# ---------------------------------------------------------------- X3 quotas (batch form)

def quota_tumbling(requests: DataFrame, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """Requests per source per fixed window; remaining = max(0, limit - used)."""
    return (requests.groupBy(key, F.window("started_at", f"{seconds} seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("used"))
            .select(key, F.col("w.start").alias("window_start"), "used",
                    F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining")))


def quota_session(requests: DataFrame, key: str, limit: int, gap_seconds: int = 60) -> DataFrame:
    """Counter whose TTL renews on every request = session window with the gap.

    Sessions are found inside each range slice of a source (`slices.numbered`).  Only a slice's first and last
    session can go on in a neighbour; these, two rows a slice at most, are stitched where the gap between them is
    too short to end a session.
    """
    gap = gap_seconds * 1_000_000
    rows = numbered(requests.select(F.col(key).alias("k"), F.col("started_at").cast("timestamp").alias("t")), ["k", "t"])
    us = lambda c: F.unix_micros(F.col(c))
    inside = Window.partitionBy("k", "_slice").orderBy("_n")
    new = F.coalesce((us("t") - F.lag(us("t")).over(inside) >= gap).cast("int"), F.lit(1))
    found = (rows.withColumn("_new", new).withColumn("_nth", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("k", "_slice", "_nth").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("used")))
    found = stored(found.withColumn("_many", F.max("_nth").over(Window.partitionBy("k", "_slice"))), "sessions")
    edge = (F.col("_nth") == 1) | (F.col("_nth") == F.col("_many"))
    along = Window.partitionBy("k").orderBy("_slice", "_nth")
    starts = F.coalesce(((F.col("_nth") > 1) | (us("start") - F.lag(us("end")).over(along) >= gap)).cast("int"), F.lit(1))
    stitched = (found.where(edge).withColumn("_starts", starts)
                .withColumn("_id", F.sum("_starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy("k", "_id").agg(F.min("start").alias("start"), F.sum("used").alias("used")))
    whole = found.where(~edge).select("k", "start", "used").unionByName(stitched.select("k", "start", "used"))
    return whole.select(F.col("k").alias(key), F.col("start").alias("session_start"), "used",
                        F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"))


def quota_sliding(requests: DataFrame, key: str, limit: int, seconds: int = 60,
                  bucket_seconds: int = 86400) -> DataFrame:
    """At each request, requests of the same source in (ts - seconds, ts].

    A hot source is split by time buckets: the range window runs per (source, bucket),
    and the requests of a bucket's last `seconds` are copied into the next bucket as
    context rows (counted, not emitted), so every window is complete and exact.
    """
    assert bucket_seconds >= seconds
    us, b_us = seconds * 1_000_000, bucket_seconds * 1_000_000
    own = (requests.withColumn("_ts", F.unix_micros(F.col("started_at").cast("timestamp")))
           .withColumn("_b", F.floor(F.col("_ts") / F.lit(b_us)))
           .withColumn("_own", F.lit(True)))
    ctx = (own.filter(F.col("_ts") > (F.col("_b") + 1) * F.lit(b_us) - F.lit(us))
           .withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_b").orderBy("_ts").rangeBetween(-us + 1, 0)
    return (own.unionByName(ctx)
            .withColumn("used", F.count(F.lit(1)).over(w))
            .filter(F.col("_own"))
            .withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))
            .drop("_ts", "_b", "_own"))
