"""Mixing sources to target weights by blocks of words.

The words of each source, its documents in order of id, are packed into blocks of a fixed length. The output is dealt in
shards of a fixed number of block slots; each shard draws how many of its slots each source gets, as a multinomial. Weights
are in slots, not words, since the last block of a source is partly filled. All draws of a source together are held to
its quota: a last shard makes up what they left short, and slots beyond the quota, those of the last shards, are empty. Slot k of a source is block perm(k mod blocks) of pass k div blocks, where perm is a keyed pseudorandom
permutation of the source's block indexes, and slots meet blocks by joining on (source, index).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm import store

#: ASCII blanks that part words.
BLANKS = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, 0 for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets of sources from (source, source_size): one row a source.

    Sources in code-point order, null last, weigh 1, 2, 3 and so on again and share the sum of all sizes. A target stops
    at max_epochs times its source's size and the excess is shared again by weight until none is above: sorted by
    size over weight, those that stop are a prefix, so one running sum finds them. There is a row a source, so
    the windows over all of them see counts, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (1 + (F.row_number().over(order) - 1) % 3).cast("double"))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("rest", F.col("all_size") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    w = w.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("stops", max_epochs * F.col("source_size") * F.col("rest_weight") <= F.col("weight") * F.col("rest"))
    w = w.withColumn("open_rest", F.min(F.when(~F.col("stops"), F.struct((-F.col("rest_weight")).alias("order"), "rest", "rest_weight"))).over(everything))  # the first that does not stop
    share = F.col("open_rest.rest") / F.col("open_rest.rest_weight")
    target = F.when(F.col("stops") | F.col("open_rest").isNull(), F.col("source_size") * F.lit(float(max_epochs))).otherwise(F.col("weight") * share)
    return w.select("source", "source_size", "weight", target.alias("target"))


def placed(docs: DataFrame, size: Column, id_col: str, source_col: str, bucket_rows: int = 20_000) -> DataFrame:
    """(id, source, size, copy key, start): where each row's words start among the words of its source.

    A running sum in two steps: within (source, bucket), where rows are put into buckets by a hash of the id, and over
    the totals of a source's buckets, so that a source of any size is spread over many tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("tie"))
    rows = store.table(rows)
    buckets = max(1, -(-rows.count() // bucket_rows)) * 8
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy("source", "bucket").orderBy(F.col("id").asc_nulls_last(), "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inner))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("total").over(outer), F.lit(0)))
    joined = rows.alias("r").join(totals.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.bucket") == F.col("t.bucket")))
    return joined.select("id", F.col("r.source").alias("source"), "size", "tie", (F.col("ahead") + F.col("upto") - F.col("size")).alias("start"))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 applied to index: a four-round Feistel network that walks until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2)
    mask = (np.uint64(1) << half.astype(np.uint64)) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    h, limit, k = half.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> h[todo], out[todo] & mask[todo]
            for r in range(4):
                x = (right + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ k[todo]
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask[todo])
            out[todo] = (left << h[todo]) | right
            todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def quotas(sources: DataFrame, max_epochs: int, seed: int) -> DataFrame:
    """sources with expected, the slots whose words come to the target on average, and quota, that number rounded at random.

    A slot gives source_size / blocks words on average, which is less than a block.
    """
    expected = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    chance = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    quota = F.least(F.floor(F.col("expected") + chance + 1e-9).cast("long"), max_epochs * F.col("blocks"))
    return sources.withColumn("expected", expected).withColumn("quota", quota)


def draws(shards: DataFrame, slots: int, seed: int) -> DataFrame:
    """Per shard and source the slots drawn, from (shard, n, weights array<double>): (shard, k, c)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = []
            for shard, n, weights in zip(part["shard"], part["n"], part["weights"], strict=True):
                p = np.asarray(weights, float)
                c = np.random.default_rng([seed, int(shard)]).multinomial(int(n), p / p.sum())
                k = np.flatnonzero(c)
                found.append(pd.DataFrame({"shard": shard, "k": k, "c": c[k]}))
            yield pd.concat(found) if found else pd.DataFrame({"shard": [], "k": [], "c": []})

    return shards.mapInPandas(run, "shard long, k int, c long")


def topped_up(drawn: DataFrame, sources: DataFrame, shard: int) -> DataFrame:
    """drawn (shard, k, c) and, in one more shard, the slots that each source's draws fall short of its quota."""
    got = drawn.groupBy("k").agg(F.sum("c").alias("got"))
    short = sources.join(got, "k", "left").select(F.lit(shard).cast("long").alias("shard"), "k", (F.col("quota") - F.coalesce("got", F.lit(0))).alias("c"))
    return drawn.unionByName(short.where("c > 0"))


def first_slots(drawn: DataFrame, run: int = 1024) -> DataFrame:
    """drawn (shard, k, c) with from, the number of a source's slots in all shards before.

    A running sum in two steps, within runs of shards and over the totals of runs, so that no task holds all shards of a
    source.
    """
    inner = Window.partitionBy("k", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("run", F.floor(F.col("shard") / run))
    ahead = drawn.groupBy("k", "run").agg(F.sum("c").alias("c")).select("k", "run", F.coalesce(F.sum("c").over(outer), F.lit(0)).alias("ahead"))
    within = drawn.withColumn("within", F.coalesce(F.sum("c").over(inner), F.lit(0)))
    return within.join(ahead, ["k", "run"]).select("shard", "k", "c", (F.col("ahead") + F.col("within")).alias("from"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = 64, slots: int = 4096, max_epochs: int = 3, seed: int = 7) -> dict[str, DataFrame]:
    """The mix as tables: docs (id, source, size, tie, start), sources, uses (source, index, epoch), pieces.

    uses has a row for each block slot of the output; pieces has the part of each row's words in each block it touches.
    A block is used at most max_epochs times. The same rows give the same mix in any order and any partitioning. Rows
    without words take no part. block is in words, slots in blocks a shard.
    """
    spark = docs.sparkSession
    rows = docs.select(id_col, source_col, F.col(text_col).alias("text"))
    at = store.table(placed(rows, n_words(F.col("text")), id_col, source_col))
    sizes = at.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = store.table(source_targets(sizes, max_epochs).withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long")).transform(lambda x: quotas(x, max_epochs, seed)))
    sums = sources.agg(F.sum("expected").alias("t"), F.sort_array(F.collect_list(F.struct("k", "expected"))).alias("w"))  # one number a source
    total = sums.select(F.ceil(F.col("t")).cast("long").alias("all"), F.transform("w", lambda x: F.try_divide(x["expected"], F.col("t"))).alias("weights")).where("all > 0")
    count = total.select("all").first()
    n_shards = -(-count[0] // slots) if count else 0
    shards = spark.range(n_shards).withColumnRenamed("id", "shard").crossJoin(F.broadcast(total)).select("shard", F.least(F.lit(slots).cast("long"), F.col("all") - F.col("shard") * slots).alias("n"), "weights")
    # a row a shard and source: written, as what follows reads the draws four times over and would hold their plan as often
    drawn = store.table(draws(shards, slots, seed))
    numbered = store.table(first_slots(topped_up(drawn, sources, n_shards))).join(sources.select("k", "source", "blocks", "quota"), "k")
    slot = numbered.select("shard", "k", "source", "blocks", F.explode(F.sequence("from", F.col("from") + F.col("c") - 1)).alias("slot")).where("slot < quota")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            n, s = part["blocks"].to_numpy(), part["slot"].to_numpy()
            with np.errstate(over="ignore"):
                key = (part["k"].to_numpy().astype(np.uint64) + np.uint64(seed)) * np.uint64(0xD1342543DE82EF95)
            yield pd.DataFrame({"shard": part["shard"], "k": part["k"], "index": permuted(s % n, n, key), "epoch": s // n})

    uses = slot.select("shard", "k", "slot", "blocks").mapInPandas(place, "shard long, k int, index long, epoch long")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = at.where("size > 0").join(sources.select(F.col("source").alias("s"), "k"), F.col("source").eqNullSafe(F.col("s"))).select("id", "tie", "k", "size", "start", F.explode(F.sequence(first, last)).alias("index"))
    pieces = pieces.withColumn("from", F.greatest(F.col("start"), F.col("index") * block) - F.col("start")).withColumn("n", F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block) - F.col("start") - F.col("from"))
    return {"docs": at, "sources": sources, "uses": uses, "pieces": pieces.select("id", "tie", "k", "size", "start", "index", "from", "n")}


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, size (words), source_size, target (its source's), taken (words that the mix takes, repeats counted).

    Each source's taken words are its target on average, and off by less than two blocks: one for the rounding of slots, one
    for the partly filled last block. Sources that stop at max_epochs are taken whole as often; no row exceeds that. Null texts have size 0 and take nothing; a null source is a source, the last. Rows that
    repeat an id are placed one by one; with equal texts too, they share what is taken evenly. Extra columns are
    ignored and an empty table gives an empty result.
    """
    m = mix(docs, id_col, source_col, text_col, **options)
    used = m["uses"].groupBy("k", "index").agg(F.count(F.lit(1)).alias("times"))
    got = m["pieces"].join(used, ["k", "index"]).groupBy("id", "tie", "start", "k").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    rows = m["docs"].alias("d").join(m["sources"].alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("id", "tie", "start", "k", "size", "source_size", "target")
    keys = ["tie", "start", "k"]
    named = rows.where("size > 0").join(got.drop("id"), keys, "left").unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return named.select(F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """Rows of docs as the mix takes them, with the columns of docs.

    A row stands once for each pass (of max_epochs at most) that takes blocks of it: with its whole text as it is where
    the pass takes all of it, else with the taken words, in order, joined by one space; chars_col follows the text.
    Rows of which nothing is taken go: null and empty texts do. Repeated rows are placed one by one; columns may have any
    names; an empty table gives an empty one.
    """
    m = mix(docs, id_col, source_col, text_col, **options)
    parts = m["pieces"].join(m["uses"].select("k", "index", "epoch"), ["k", "index"]).groupBy("id", "tie", "start", "k", "epoch", "size").agg(F.sum("n").alias("words"), F.sort_array(F.collect_list(F.struct("from", "n"))).alias("cuts"))
    plan = parts.select(F.col("id").alias("plan_id"), F.col("tie").alias("plan_tie"), "start", "epoch", F.when(F.col("words") < F.col("size"), F.col("cuts")).alias("cuts"))
    # written, so that the driver never holds the plan of the mix and that of its documents as one
    plan = store.table(plan.withColumn("plan_copy", F.row_number().over(Window.partitionBy("plan_id", "plan_tie", "epoch").orderBy("start"))))
    # the row travels as one struct, so its columns may have any names
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tie"))
    numbered = packed.withColumn("copy", F.row_number().over(Window.partitionBy("id", "tie").orderBy(F.lit(1))))
    hit = numbered.join(plan, numbered["id"].eqNullSafe(plan["plan_id"]) & (numbered["tie"] == plan["plan_tie"]) & (numbered["copy"] == plan["plan_copy"]))
    old = F.col("row").getField(text_col)
    # an array of one array, so that a text is split once and not once a cut
    split_once = F.array(F.split(F.btrim(old, F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    chosen = F.transform(split_once, lambda words: F.concat_ws(" ", F.flatten(F.transform("cuts", lambda c: F.slice(words, (c["from"] + 1).cast("int"), c["n"].cast("int"))))))[0]
    out = hit.select("row", F.when(F.col("cuts").isNull(), old).otherwise(chosen).alias("text"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col("row").getField(c).alias(c) for c in docs.columns])
