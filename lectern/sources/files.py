"""A pointer file that is switched atomically, on whatever file system Spark's paths name (Hadoop FileSystem)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(conf)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in `path`; none if it is missing."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_pointer(spark: SparkSession, path: str, value: dict) -> None:
    """Readers see the old pointer or the new one, never none or half of one."""
    jvm = spark._jvm
    tmp, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(tmp, True)
    stream.write(bytearray(json.dumps(value), "utf-8"))
    stream.close()
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    p, _ = _path(spark, path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(tmp, p, overwrite)
