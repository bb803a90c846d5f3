"""Similarity join of texts as token sets: rules meet the processes that are like them, none being named beforehand.

Two sets of a Jaccard similarity of t or more share so many tokens that, each set's tokens being sorted from the rarest on,
their first |A| - ceil(t|A|) + 1 tokens have one in common. So an inverted index of these prefixes alone gives every pair,
and frequent tokens are seldom in it. Postings of a token that is frequent all the same are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import strings as S
from statuta.plans.lineage import cut

#: Postings of one token that meet in one task, of the right side.
DEAL = 1024


def token_sets(rows: DataFrame, text_col: str) -> DataFrame:
    """(text, tokens): the distinct lower-cased texts that hold a token, with their distinct tokens."""
    low = rows.select(F.lower(text_col).alias("text")).distinct()
    return low.withColumn("tokens", S.tokens(F.col("text"))).where(F.size("tokens") > 0)


def _least(share: float, size: Column) -> Column:
    """ceil(share * size), never above it for a rounding error."""
    return F.ceil(F.lit(share) * size - 1e-9)


def prefixes(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(text, size, token, place): of every set the tokens of its prefix, place being that in the order from the rarest token on, from 0.

    Sets are taken apart and put in order by a window over each, so a long text spills and needs no row of its own size.
    """
    each = sets.select("text", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(frequency, "token")
    place = F.row_number().over(Window.partitionBy("text").orderBy("n", "token")) - 1
    placed = each.select("text", "size", "token", place.alias("place"))
    return placed.where(F.col("place") <= F.col("size") - _least(threshold, F.col("size")))


def similar_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_text, right_text, similarity) of the texts of two token_sets() tables with a Jaccard of `threshold` (above 0) or more.

    A pair is made only where prefixes share a token, sizes allow the similarity, and the tokens behind the shared one could
    make up the overlap that it needs (the first token that both share always passes). Pairs made by several tokens are made
    one by a partial aggregate; then the whole sets are compared. The result is exact.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    left, right = cut(left), cut(right)
    both = left.select(F.explode("tokens").alias("token")).unionAll(right.select(F.explode("tokens").alias("token")))
    frequency = cut(both.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    a = prefixes(left, frequency, threshold).select("token", F.col("text").alias("left_text"), F.col("size").alias("m"), F.col("place").alias("i"))
    b = cut(prefixes(right, frequency, threshold)).select("token", F.col("text").alias("right_text"), F.col("size").alias("n"), F.col("place").alias("j"))
    # a token's right postings are dealt to so many parts, each of which the left ones visit
    parts = b.groupBy("token").count().select("token", F.ceil(F.col("count") / DEAL).cast("int").alias("parts"))
    a = a.join(parts, "token").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = b.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("right_text"), F.col("parts")).cast("int"))
    needed = _least(threshold / (1 + threshold), F.col("m") + F.col("n"))
    fits = (F.least("m", "n") >= F.lit(threshold) * F.greatest("m", "n") - 1e-9) & (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= needed)
    # few postings make many pairs, so the number of tasks is set: by their bytes alone they would be put together in one
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (side.drop("parts").repartition(tasks, "token", "part") for side in (a, b))
    pairs = a.join(b, ["token", "part"]).where(fits).select("left_text", "right_text").distinct()
    whole = pairs.join(left.select(F.col("text").alias("left_text"), F.col("tokens").alias("x")), "left_text").join(right.select(F.col("text").alias("right_text"), F.col("tokens").alias("y")), "right_text")
    return whole.select("left_text", "right_text", S.jaccard(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold)


def best_processes(rules: DataFrame, named: DataFrame, text_col: str, threshold: float = 0.3) -> DataFrame:
    """(rule_id, best, best_name, process_id, alike) of every rule with a text: the most similar name of all processes.

    rules (rule_id and the text column) name no process; named is (process_id, name), tasks or lanes. best is the highest
    similarity, best_name the first lower-cased name that reaches it, process_id the smallest of the processes that have
    this name, alike the number of distinct names at the threshold or above. Where no name is as similar as the threshold,
    best is 0, alike 0 and the others null: the rule's action is in no process, or its actor in no lane. Rules whose text is
    null or blank are passed over, as are names without a token; repeated rules come out repeated.
    """
    asked = rules.select("rule_id", F.lower(text_col).alias("left_text")).where(F.size(S.tokens(F.col("left_text"))) > 0)
    found = similar_texts(token_sets(rules, text_col), token_sets(named, "name"), threshold)
    best = found.groupBy("left_text").agg(F.min(F.struct((-F.col("similarity")).alias("n"), "right_text")).alias("b"), F.count(F.lit(1)).alias("alike"))
    best = best.select("left_text", (-F.col("b.n")).alias("best"), F.col("b.right_text").alias("best_name"), "alike")
    holders = named.groupBy(F.lower("name").alias("best_name")).agg(F.min("process_id").alias("process_id"))
    known = best.join(holders, "best_name")
    out = asked.join(known, "left_text", "left")
    return out.select("rule_id", F.coalesce("best", F.lit(0.0)).alias("best"), "best_name", "process_id", F.coalesce("alike", F.lit(0)).alias("alike"))

