"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import configure, ensure_checkpoint_dir

SPACES = " \t\n\x0b\f\r"
WORD = "[^" + SPACES + "]+"
BATCH_BYTES = 8 << 20
FILTER_BITS = 1 << 25  # of a bitmap of hashes: at most half a million rows of 64 bits


def prepare(spark: SparkSession) -> None:
    """Session defaults, and Arrow batches bounded by bytes (texts can be long)."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows, else as it is
    (the join is then a shuffle join).  `df` must be cheap to count: stored or tiny."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def collapsed(text: Column, separators: str, upper: str = "", lower: str = "") -> Column:
    """`text` (null: empty) with every separator turned into a space, runs of them into one, none at the ends.

    `upper` is mapped to `lower` on the way.  The regular expression only has work at doubled spaces.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), upper + separators, lower + " " * len(separators))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def spaces_plus_one(line: Column) -> Column:
    """Words of a collapsed text.  Without a branch, so that Spark makes `line` once."""
    return (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + (line != "").cast("int")).cast("long")


def word_count(text: Column) -> Column:
    """Number of words split at ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bitmap(hashes: DataFrame, label: str) -> DataFrame:
    """(_w, _bits): the hashes (column h) as a bitmap of FILTER_BITS, in rows of 64 bits; stored.

    It has at most FILTER_BITS / 64 rows, whatever the size of `hashes`, and is
    broadcast for that reason.  The fuller it is, the more other hashes hit it: it
    only ever spares a shuffle, an exact join decides.
    """
    place = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    return stored(hashes.select(F.shiftright(place, 6).alias("_w"), bit.alias("b")).groupBy("_w").agg(F.bit_or("b").alias("_bits")), label)


def marked(rows: DataFrame, h: Column, marks: DataFrame) -> DataFrame:
    """Adds _marked: whether the bitmap holds the hash h (it may hold others too)."""
    place = F.pmod(h, F.lit(FILTER_BITS))
    rows = rows.withColumn("_w", F.shiftright(place, 6)).withColumn("_bit", place.bitwiseAND(63).cast("int"))
    rows = rows.join(F.broadcast(marks), "_w", "left")
    return rows.withColumn("_marked", F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))).drop("_w", "_bit", "_bits")
