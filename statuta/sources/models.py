"""Process models as a source: XML files in, a row for each process, files that cannot be read set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.strings import once
from statuta.operators import process as K


def read_models(spark: SparkSession, path: str, row_tag: str = "process") -> tuple[DataFrame, DataFrame]:
    """(p, file) of every process in the files below path, and (file, reason) of the files that are set apart.

    Elements of any prefix count; a file may hold several processes and is parsed where it lies, one task having as many
    files as fit. A file that is empty or no well-formed XML, or that holds no process, or one without an id, is set apart
    whole, with none of its processes kept, since what was read of it may lack parts. The schema is fixed, so files are read
    once for each result and never to find types. A file is a row, so it is as large as one can be.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"), F.col("_metadata.file_path").alias("file"))
    return split_models(files, row_tag)


def split_models(files: DataFrame, row_tag: str = "process") -> tuple[DataFrame, DataFrame]:
    """read_models() of (xml, file) rows that are there already; null texts are set apart as empty."""
    body = K.model_schema().removeprefix("process ")
    whole = F.from_xml("xml", f"{row_tag} array<{body}>, _corrupt string", {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = files.withColumn("_m", once(F.when(F.regexp_like("xml", F.lit(r"\S")), whole)))
    held = F.coalesce(F.col(f"_m.{row_tag}"), F.array().cast(f"array<{body}>"))
    reason = F.when(F.col("_m").isNull(), "empty").when(F.col("_m._corrupt").isNotNull(), "not_well_formed").when(F.size(held) == 0, "no_process").when(F.exists(held, lambda p: p["_id"].isNull()), "process_without_id")
    judged = parsed.select("file", held.alias("_held"), reason.alias("reason"))
    good = judged.where("reason is null").select("file", F.explode("_held").alias("p"))
    return good.select("p", "file"), judged.where("reason is not null").select("file", "reason")
