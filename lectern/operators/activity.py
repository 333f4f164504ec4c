"""User activity operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.session import AS_OF


def toggle_state(activity: DataFrame, on: str = "save", off: str = "remove_save") -> DataFrame:
    """The last of on/off per (user, item) wins; keep the items whose last event is `on`.

    One aggregation on (user_id, content_id) with map-side partial max_by, no
    group is collected.  Output: user_id, external_id, saved_at.
    """
    ev = activity.filter(F.col("activity_type").isin(on, off) & F.col("content_id").isNotNull())
    last = (ev.groupBy("user_id", "content_id")
            .agg(F.max_by("activity_type", F.struct("created_at", "id")).alias("last_type"),
                 F.max(F.when(F.col("activity_type") == on, F.col("created_at"))).alias("saved_at")))
    return (last.filter(F.col("last_type") == on)
            .select("user_id", F.col("content_id").alias("external_id"), "saved_at"))


def latest_n(df: DataFrame, key: str | list[str], ts: str, n: int, tie: str = "id") -> DataFrame:
    """Latest n rows per key (window group limit: Spark pushes the rank limit
    below the shuffle as a per-partition top-n)."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def recent_searches(activity: DataFrame, n: int = 10) -> DataFrame:
    """Distinct trimmed queries per user, newest first, n per user."""
    q = (activity.filter(F.col("activity_type") == "search")
         .withColumn("query", F.trim(F.col("query")))
         .filter(F.col("query") != "")
         .groupBy("user_id", "query").agg(F.max("created_at").alias("last_at")))
    w = Window.partitionBy("user_id").orderBy(F.col("last_at").desc(), F.col("query"))
    return q.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def saved_subset(ids: DataFrame, saved: DataFrame) -> DataFrame:
    """Which (user, item) pairs of `ids` are currently saved (left semi join)."""
    return ids.join(saved.select("user_id", "external_id"), ["user_id", "external_id"], "left_semi")


def flag_saved(activity: DataFrame, saved: DataFrame) -> DataFrame:
    """Mark activities whose item the user currently saves."""
    s = saved.select("user_id", F.col("external_id").alias("content_id"), F.lit(True).alias("is_saved"))
    return (activity.join(s, ["user_id", "content_id"], "left")
            .withColumn("is_saved", F.coalesce(F.col("is_saved"), F.lit(False))))


def exclude_seen(cands: DataFrame, activity: DataFrame) -> DataFrame:
    """Drop candidates the user saved or viewed (left anti on (user, item))."""
    seen = (activity.filter(F.col("activity_type").isin("save", "view") & F.col("content_id").isNotNull())
            .select("user_id", F.col("content_id").alias("external_id")).distinct())
    return cands.join(seen, ["user_id", "external_id"], "left_anti")


def with_profile(users: DataFrame, profiles: DataFrame, saved: DataFrame) -> DataFrame:
    """User rows with profile columns and their saved count."""
    counts = saved.groupBy("user_id").agg(F.count(F.lit(1)).alias("saved_count"))
    return (users.join(profiles, "user_id", "left").join(counts, "user_id", "left")
            .withColumn("saved_count", F.coalesce(F.col("saved_count"), F.lit(0)).cast("bigint")))


def distinct_entities(activity: DataFrame) -> DataFrame:
    """Distinct users and items among save/view interactions (exact)."""
    i = activity.filter(F.col("activity_type").isin("save", "view"))
    return i.agg(F.countDistinct("user_id").alias("n_users"),
                 F.countDistinct(F.when(F.col("content_id") != "", F.col("content_id"))).alias("n_items"))


def age_bucket(ts: Column, as_of: str = AS_OF) -> Column:
    """<1 min 'just now', minutes, hours, days (<7), else the date."""
    secs = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)
    return (F.when(secs < 60, F.lit("just now"))
            .when(secs < 3600, F.concat((F.floor(secs / 60)).cast("string"), F.lit(" min ago")))
            .when(secs < 86400, F.concat((F.floor(secs / 3600)).cast("string"), F.lit(" h ago")))
            .when(secs < 7 * 86400, F.concat((F.floor(secs / 86400)).cast("string"), F.lit(" d ago")))
            .otherwise(F.date_format(ts, "yyyy-MM-dd")))
