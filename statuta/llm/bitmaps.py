"""Bitmaps of hashed keys that tell, where rows are read, which of them may have a partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bitmap has at most so many bits (32 MB); beyond, it lets through more rows, and never fewer.
MOST_BITS = 28


def _flagged(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with _bits, the part of the bitmap of keys' long column that the row's key may lie in."""
    slots = 1 << min(MOST_BITS, max(20, (16 * keys.count()).bit_length()))
    slot = lambda: F.pmod(F.xxhash64(key), F.lit(slots))
    bitmap = keys.select(slot().alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("_bits"))
    return rows.withColumn("_slot", slot()).withColumn("_bucket", F.expr("bitmap_bucket_number(_slot)")).join(F.broadcast(bitmap), "_bucket", "left")


def _on() -> Column:
    spot = F.expr("bitmap_bit_position(_slot)")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), spot % 8)) % 2 == 1, F.lit(False))


def split(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose key is, but for a few more, in keys (a stored table with the same column), and all other rows.

    A null key is treated as a value. rows must have no column _slot, _bucket or _bits.
    """
    flagged = _flagged(rows, keys, key)
    return flagged.where(_on()).select(*rows.columns), flagged.where(~_on()).select(*rows.columns)


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in keys (a stored table of that column alone), without shuffling the others."""
    return split(rows, keys, key)[0].join(keys, key, "left_semi")
