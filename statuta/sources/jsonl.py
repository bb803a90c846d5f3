"""JSON Lines in and out: blank lines and lines that begin with # are passed over, broken ones set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.plans.lineage import cut


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of text files."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, no) of text files, no being the number of the line in its file, from 1.

    A split knows the place of its lines among its own; the number of lines in the splits of the file before it is added. One
    row a split is broadcast, and no line is shuffled.
    """
    at = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), at.alias("block"), F.monotonically_increasing_id().alias("n"))
    splits = cut(lines.groupBy("file", "block").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("lines")))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = splits.select("file", "block", (before - F.col("first") + 1).alias("add"))
    return lines.join(F.broadcast(ahead), ["file", "block"]).select("line", "file", (F.col("n") + F.col("add")).alias("no"))


def content(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor a comment."""
    return lines.where(~F.regexp_like("line", F.lit(r"^\s*(#.*)?$")))


def parse(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the lines that hold a JSON object of the schema, and the lines that don't, with what else they carry."""
    kept = content(lines).withColumn("ok", F.try_parse_json("line").isNotNull() & F.regexp_like("line", F.lit(r"^\s*\{")))
    good = kept.where("ok").withColumn("row", F.from_json("line", schema)).select("row.*")
    return good, kept.where("not ok").drop("ok")


def read_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that hold one JSON object each, a row a file; with a schema, nothing is inferred."""
    return spark.read.json(path, schema=schema, multiLine=True)


LEXICON = "categories MAP<STRING, STRUCT<markers: ARRAY<STRING>, classifications: MAP<STRING, ARRAY<STRING>>>>"


def lexicon_entries(objects: DataFrame, json_col: str = "value") -> DataFrame:
    """The rows of objects with category, klass and marker of each lexicon entry, in place of its JSON text.

    A category lists its markers, klass being null, or the markers of each of its classes, as the modalities do.
    """
    keep = [c for c in objects.columns if c != json_col]
    each = objects.select(*keep, F.explode(F.from_json(json_col, LEXICON)["categories"]).alias("category", "entry"))
    plain = F.transform(F.coalesce("entry.markers", F.array().cast("array<string>")), lambda m: F.struct(F.lit(None).cast("string").alias("klass"), m.alias("marker")))
    classes = F.flatten(F.transform(F.map_entries(F.coalesce("entry.classifications", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(e["value"], lambda m: F.struct(e["key"].alias("klass"), m.alias("marker")))))
    return each.select(*keep, "category", F.explode(F.concat(plain, classes)).alias("m")).select(*keep, "category", "m.klass", "m.marker")


def lexicon_rows(spark: SparkSession, path: str) -> DataFrame:
    """(category, klass, marker) of lexicon files, one JSON object a file."""
    return lexicon_entries(spark.read.text(path, wholetext=True))


def write(rows: DataFrame, path: str) -> None:
    """One JSON object a line in the order of columns, null fields kept, text as it is in UTF-8."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def manifest(rows: DataFrame, name: str) -> DataFrame:
    """One JSON summary of a table: its name, rows and columns."""
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(F.to_json(F.struct(F.lit(name).alias("name"), "rows", F.array(*map(F.lit, rows.columns)).alias("columns"))).alias("manifest"))
