"""Tables of JSON Lines that are written as a whole or not at all: a manifest of files comes last, and readers go by it alone."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.sources import jsonl

MANIFEST = "file string, lines long, bytes long, digest string"


def _described(lines: DataFrame) -> DataFrame:
    """(file, lines, bytes, digest) of text files: the digest is a sum over all lines, so it needs no order and is summed in the tasks first."""
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.xxhash64("value").cast("decimal(38,0)").alias("h"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.max("bytes").alias("bytes"), F.sum("h").cast("string").alias("digest"))


def write(rows: DataFrame, path: str) -> str:
    """Write rows as JSON Lines below path and give the run's name.

    The files go to a folder of their own, then a manifest that names each with its lines, bytes and digest is written; until
    its job is committed, nothing that reads the path sees the run. An earlier run stays readable meanwhile, and a write
    that breaks off, or whose tasks ran twice, leaves at most files that no manifest names. An empty table is a run without files.
    """
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    jsonl.write(rows, f"{path}/data-{run}")
    files = _described(rows.sparkSession.read.text(f"{path}/data-{run}"))
    files.write.json(f"{path}/manifest-{run}")
    return run


def runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed runs of a path, the latest last; only a folder of manifests with its mark of success counts."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(s.getPath().getParent().getName().removeprefix("manifest-") for s in found or [])


def manifest(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """(file, lines, bytes, digest) as written with the latest run, or the one named; an error where none is committed."""
    known = runs(spark, path)
    if not known or run is not None and run not in known:
        raise FileNotFoundError(f"no committed run {run or ''} in {path}")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest-{run or known[-1]}")


def read(spark: SparkSession, path: str, schema: str, run: str | None = None) -> DataFrame:
    """Rows of the files that a run's manifest names, and of no others. Their names pass the driver, as those of any table's files do."""
    files = [r.file for r in manifest(spark, path, run).select("file").collect()]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def verify(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """(file, lines, bytes, ok): whether each file of a manifest still is as it was written; false for a file that is gone or changed."""
    said = manifest(spark, path, run)
    name = run or runs(spark, path)[-1]
    there = _described(spark.read.text(f"{path}/data-{name}")).select("file", *(F.col(c).alias(f"now_{c}") for c in ("lines", "bytes", "digest")))
    same = [F.col(c) == F.col(f"now_{c}") for c in ("lines", "bytes", "digest")]
    return said.join(there, "file", "left").select("file", "lines", "bytes", F.coalesce(same[0] & same[1] & same[2], F.lit(False)).alias("ok"))
