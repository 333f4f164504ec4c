"""Upserts by key (S18-S20, S23) over immutable tables.

Plain Parquet has no MERGE, so an upsert is one full outer join of the current
table with the (per-key reduced) batch, written as a new table version
(`write_table`; a table format with MERGE can use `mergeInto`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.files import delete, folders, read_pointer, write_pointer

MODES = ("not_null", "truthy", "replace")


def _present(c: Column, dtype: str, mode: str) -> Column:
    """Whether a batch value counts as given: not null, or (truthy mode) also not ''/0/[]."""
    if mode != "truthy":
        return c.isNotNull()
    if dtype == "string":
        return c.isNotNull() & (c != "")
    if dtype.startswith("array"):
        return c.isNotNull() & (F.size(c) > 0)
    if dtype in ("int", "bigint", "double", "float", "smallint"):
        return c.isNotNull() & (c != 0)
    if dtype == "boolean":
        return c.isNotNull() & c
    return c.isNotNull()


def upsert(base: DataFrame, batch: DataFrame, key: list[str], seq: str, mode: str = "not_null",
           insert_defaults: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge `batch` into `base` by `key`; returns (table, counts).

    Batch rows are applied in `seq` order: per key and column the last given value
    wins (`replace`: the last row wins whole).  Rows without a key are skipped.
    Counts follow the row-by-row semantics: a new key's first row is saved, every
    other row of the batch is an update.  One shuffle on the key (map-side
    partial max_by), one join.
    """
    assert mode in MODES
    insert_defaults = insert_defaults or {}
    cols = [c for c in base.columns if c not in key]
    has_key = F.lit(True)
    for k in key:
        has_key = has_key & F.coalesce(F.col(k).cast("string") != "", F.lit(False))
    keyed = batch.filter(has_key)
    dtypes = dict(batch.dtypes)
    if mode == "replace":
        aggs = [F.max_by(F.col(c), F.col(seq)).alias(c) for c in cols if c in dtypes]
    else:
        aggs = [F.max_by(F.col(c), F.when(_present(F.col(c), dtypes[c], mode), F.col(seq))).alias(c)
                for c in cols if c in dtypes]
    reduced = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    b = base.withColumn("_in_base", F.lit(True))
    j = b.alias("o").join(reduced.alias("n"), key, "full")
    out_cols = []
    for c in cols:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}") if c in dtypes else F.lit(None)
        if mode == "replace":
            merged = F.when(F.col("n._rows").isNotNull(), new).otherwise(old)
        else:
            merged = F.coalesce(new, old)
        if c in insert_defaults:
            merged = F.when(F.col("o._in_base").isNull(), F.coalesce(merged, insert_defaults[c])).otherwise(merged)
        out_cols.append(merged.alias(c))
    op = (F.when(F.col("o._in_base").isNull(), "saved")
          .when(F.col("n._rows").isNotNull(), "updated").otherwise("unchanged"))
    table = j.select(*key, *out_cols, op.alias("op"), F.coalesce(F.col("n._rows"), F.lit(0)).alias("_rows"))
    # one aggregation over the merged rows and the batch rows tagged apart (no join of counts)
    merged_rows = table.select(F.col("op"), F.col("_rows"), F.lit(True).alias("_has_key"))
    batch_rows = batch.select(F.lit("batch").alias("op"), F.lit(0).alias("_rows"), has_key.alias("_has_key"))
    counts = merged_rows.unionByName(batch_rows).agg(
        F.sum(F.when(F.col("op") == "saved", 1).otherwise(0)).cast("bigint").alias("saved"),
        F.sum(F.when(F.col("op") == "saved", F.col("_rows") - 1).when(F.col("op") == "batch", 0)
              .otherwise(F.col("_rows"))).cast("bigint").alias("updated"),
        F.sum(F.when((F.col("op") == "batch") & ~F.col("_has_key"), 1).otherwise(0)).cast("bigint").alias("skipped"))
    return table.drop("_rows"), counts


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a whole new version of the table at `path` and switch to it; returns the version's name.

    A version is a folder of its own, the switch an atomic replacement of the pointer file.  Readers keep the version
    they opened; a writer that dies before the switch leaves the old table as it was.  The version before
    the current one stays for readers that opened it, older ones are removed.
    """
    spark = df.sparkSession
    pointer = f"{path}/_current"
    old = read_pointer(spark, pointer) or {"number": 0, "version": None}
    version = f"v{old['number'] + 1}-{uuid.uuid4().hex[:12]}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path}/{version}")
    write_pointer(spark, pointer, {"number": old["number"] + 1, "version": version})
    for name in folders(spark, path):
        if name not in (version, old["version"]):
            delete(spark, f"{path}/{name}")
    return version


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table's current version."""
    now = read_pointer(spark, f"{path}/_current")
    if now is None:
        raise ValueError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{now['version']}")
