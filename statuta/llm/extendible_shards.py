"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash. Beginning with one bucket, only buckets above the byte limit split
on one more bit, until every shard fits; what equal hashes keep together beyond the last bit is cut in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm import store

#: Bits of the hash that the directory may use: 32 of the key, then 31 of the text.
MAX_BITS = 63


def bits_of(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of the MD5 of a value as text, as a number; null hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")


def prefix_hash(key: Column, text: Column) -> Column:
    """63 bits: those of the key lead, so rows of one key part only where they don't fit one shard."""
    return bits_of(key, 8) * (1 << 31) + F.shiftright(bits_of(text, 8), 1)


#: Buckets of so many leading bits and fewer are at most 2^11 - 1 and are broadcast; deeper ones hold few cells each.
TOP_BITS = 10
#: Parts of a bucket's cells in the deep directory, where many rows of one key share their leading bits.
SALTS = 16


def directory(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """(cell, depth): how many bits the bucket of each cell has, from (cell, bytes) with distinct cells of `bits` bits.

    A leaf is a bucket that fits and whose parent, one bit shorter, does not: what splitting oversized buckets one bit at
    a time ends with. Sums of buckets are partially aggregated; cells then meet their leaf, those of the few shortest
    buckets by a broadcast and others by a join on (bucket, salt), so that no task gets all cells of a large bucket.
    """
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("bucket", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = store.table(levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("n")))
    above = sums.where(F.col("n") > limit).select(F.col("depth").alias("d"), F.col("bucket").alias("b"))
    fits = sums.where(F.col("n") <= limit).select("depth", "bucket")
    below = fits.join(above, (F.col("depth") - 1 == F.col("d")) & (F.shiftright("bucket", 1) == F.col("b")), "left_semi")
    leaves = store.table(below.unionByName(fits.where("depth = 0")))
    keyed = levels.select("cell", "depth", "bucket").withColumn("salt", F.pmod(F.xxhash64("cell"), F.lit(SALTS)).cast("int"))
    short = keyed.where(F.col("depth") <= TOP_BITS).join(F.broadcast(leaves.where(F.col("depth") <= TOP_BITS)), ["depth", "bucket"])
    salted = leaves.where(F.col("depth") > TOP_BITS).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    deep = keyed.where(F.col("depth") > TOP_BITS).join(salted, ["depth", "bucket", "salt"])
    return short.select("cell", "depth").unionByName(deep.select("cell", "depth"))


def shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20) -> DataFrame:
    """Per row: key, bytes (of its text in UTF-8), depth, shard (the bucket's bits, then -n where a bucket was cut) and
    shard_bytes.

    No shard exceeds limit bytes but one that is a single longer row (rows cut in order have equal hashes, so but for a
    collision equal lengths). Null and empty texts have 0 bytes and null keys
    hash as the empty text. Rows of one key share a bucket while they fit, then part by bits of their texts; repeated
    rows that don't fit are numbered and cut. Extra columns are ignored; an empty table gives an empty result.
    """
    return assigned(docs, key_col, text_col, limit).select(F.col("key").alias(key_col), "bytes", "depth", "shard", "shard_bytes")


def assigned(docs: DataFrame, key_col: str, text_col: str, limit: int, *carried: Column) -> DataFrame:
    """The rows of shards, with the key as key and further columns carried along with each row."""
    rows = store.table(docs.select(*carried, F.col(key_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), prefix_hash(F.col(key_col), F.col(text_col)).alias("hash")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(30, int(total // limit).bit_length() + 6)
    cell = F.shiftright("hash", MAX_BITS - bits)
    found = store.table(directory(rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")), bits, limit))
    placed = rows.withColumn("cell", cell).join(found, "cell", "left").drop("cell")
    fits, over = placed.where("depth is not null"), placed.where("depth is null").drop("depth")
    deep = directory(over.groupBy(F.col("hash").alias("cell")).agg(F.sum("bytes").alias("bytes")), MAX_BITS, limit)
    over = over.join(deep.withColumnRenamed("cell", "hash"), "hash", "left")
    numbered = _numbered(over.where("depth is null"))
    cut = numbered.withColumn("cut", F.floor(F.col("no") / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))))).cast("string")).withColumn("depth", F.lit(MAX_BITS)).drop("no")
    whole = fits.unionByName(over.where("depth is not null")).withColumn("cut", F.lit(None).cast("string")).unionByName(cut)
    name = F.lpad(F.conv(F.expr(f"shiftright(hash, {MAX_BITS} - depth)").cast("string"), 10, 2), F.col("depth"), F.lit("0"))
    named = whole.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.concat(name, F.coalesce(F.concat(F.lit("-"), "cut"), F.lit("")))))
    sizes = named.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return named.join(sizes, "shard")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with no, from 0 among those of one hash, in two steps: rows of one hash are dealt over many tasks and numbered
    there, behind the totals of the tasks before."""
    if not rows.limit(1).count():
        return rows.withColumn("no", F.lit(0).cast("long"))
    dealt = store.table(rows.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")))
    inner, outer = Window.partitionBy("hash", "deal").orderBy("bytes", F.col("key").cast("string")), Window.partitionBy("hash").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("hash", "deal").agg(F.count(F.lit(1)).alias("n")).select("hash", "deal", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("ahead"))
    within = dealt.withColumn("no", F.row_number().over(inner) - 1)
    return within.join(ahead, ["hash", "deal"]).withColumn("no", F.col("no") + F.col("ahead")).select(*rows.columns, "no")


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20) -> None:
    """Write docs as Parquet, one folder a shard, each row once into the shard that shards() gives it."""
    found = assigned(docs, key_col, text_col, limit, F.struct(*docs.columns).alias("row"))
    found.select("row.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
