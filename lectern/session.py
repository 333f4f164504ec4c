"""Session construction and cluster-facing helpers.

Everything here is plain SparkSession configuration.  On a cluster the
session is created by the platform; ``get_session`` and ``configure`` only
fill in the settings that are unset, so cluster values win, with one exception:
the tables' times are UTC, so ``configure`` sets the session time zone to UTC.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Fixed clock used by every operator that would otherwise call now().
AS_OF = "2024-01-31 00:00:00"
# The scrape log (derived from `orders`) lives in another era; its clock.
SCRAPE_AS_OF = "2001-08-02 00:00:00"

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "false",
}


def get_session(master: str | None = None, cpus: int | None = None,
                app: str = "lectern") -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
          .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEM", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Apply engine defaults that a cluster session left unset, and the UTC time zone."""
    for k, v in _DEFAULTS.items():
        if k == "spark.ui.enabled":
            continue
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    except Exception:
        pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint directory from ``spark.checkpoint.dir``.

    A cluster names a shared folder there.  Only in local mode (tests), where the driver's
    disk is every task's disk, is a scratch folder made when it is unset.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="lectern-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as a table in the shared checkpoint folder and read back.

    Like a checkpoint it cuts the lineage; unlike one it also forgets the plan's size estimates, which grow
    with every join of an iteration.
    """
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`stored`, and the folder, for a loop that deletes what it has gone past."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
