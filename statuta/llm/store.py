"""Lineage cuts that outlive executors: tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a session on one machine (as in tests) gets a temporary
    one; on a cluster that would lose data, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="statuta-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back; removed by drop(), or when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/statuta-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that table() wrote; only when all that reads them has been written itself."""
    for df in tables:
        _drop(df.sparkSession, df.stored_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may already be gone
        pass
