"""Plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(df: DataFrame, n: int = 50, col: str = "categories") -> DataFrame:
    """A1: explode the list, skip empty values, count, top n (count desc, name)."""
    c = (df.select(F.explode(col).alias("category"))
         .filter(F.col("category").isNotNull() & (F.col("category") != ""))
         .groupBy("category").agg(F.count(F.lit(1)).alias("n")))
    return c.orderBy(F.col("n").desc(), F.col("category")).limit(n)


def popular(saved: DataFrame, k: int | None = None, by: tuple[str, ...] = ("external_id",)) -> DataFrame:
    """A2: save counts per item, most saved first; top k when given (the feature)."""
    c = saved.groupBy(*by).agg(F.count(F.lit(1)).alias("save_count"))
    if k is None:
        return c
    return c.orderBy(F.col("save_count").desc(), *[F.col(b) for b in by]).limit(k)


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """Counts for each facet and the grand total in one GROUPING SETS pass."""
    sets = [[F.col(f)] for f in facets] + [[]]
    return df.groupingSets(sets, *[F.col(f) for f in facets]).agg(F.count(F.lit(1)).alias("n")).select(*facets, "n")


def date_drilldown(df: DataFrame, col: str, unit: str = "month") -> DataFrame:
    """Counts per year/month/day of a date column (nulls skipped)."""
    return (df.filter(F.col(col).isNotNull())
            .groupBy(F.trunc(F.col(col), unit).alias("period"))
            .agg(F.count(F.lit(1)).alias("n")))


def date_levels(df: DataFrame, col: str) -> DataFrame:
    """The whole drill-down of a date column in one GROUPING SETS pass: counts per year, month and day
    (level, period = first day of it, n); nulls skipped."""
    first = {u: F.date_trunc(u, F.col(col)).cast("date").alias(u) for u in ("year", "month", "day")}
    days = df.filter(F.col(col).isNotNull()).select(*first.values())
    sets = [[F.col(u)] for u in first]
    counted = days.groupingSets(sets, *[F.col(u) for u in first]).agg(F.count(F.lit(1)).alias("n"))
    level = F.coalesce(*[F.when(F.col(u).isNotNull(), u) for u in first])
    return counted.select(level.alias("level"), F.coalesce(*first).alias("period"), "n")
