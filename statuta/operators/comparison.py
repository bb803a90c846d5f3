"""Comparison of runs and analysis of their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.plans.lineage import cut


def unpivot(wide: DataFrame, keys: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(keys, values, name, value)


def run_delta(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric both values and second - first to six places; null and not available where one is missing."""
    x = a.unpivot([], metrics, "metric", "value_a")
    y = b.unpivot([], metrics, "metric", "value_b")
    both = x.join(y, "metric", "full_outer")
    return both.withColumn("delta", F.round(F.col("value_b") - F.col("value_a"), 6)).withColumn("available", F.col("value_a").isNotNull() & F.col("value_b").isNotNull())


def field_delta(a: DataFrame, b: DataFrame, metrics: list[str], outer: bool = False) -> DataFrame:
    """Per field the differences of metrics. Missing values count as 0; with outer, over the union of fields, as null."""
    x = a.select("field", *[F.col(m).alias(f"{m}_a") for m in metrics])
    y = b.select("field", *[F.col(m).alias(f"{m}_b") for m in metrics])
    both = x.join(y, "field", "full_outer" if outer else "inner")
    value = (lambda c: F.col(c)) if outer else (lambda c: F.coalesce(F.col(c), F.lit(0.0)))
    return both.withColumns({f"{m}_delta": F.round(value(f"{m}_b") - value(f"{m}_a"), 6) for m in metrics})


def nway_table(metrics: DataFrame, names: list[str], runs: list[str], fallback: str | None = None) -> DataFrame:
    """A row a metric and a column a run, from (run, metrics...); a missing value is that of the fallback metric, or 0 without one."""
    if fallback:
        metrics = metrics.withColumns({n: F.coalesce(n, fallback, F.lit(0.0)) for n in names})
    return metrics.unpivot(["run"], names, "metric", "value").groupBy("metric").pivot("run", runs).agg(F.first("value"))


def nway_fields(fields: DataFrame, runs: list[str]) -> DataFrame:
    """Per field and run the strict F1 (0 where it is missing) and exact/gold counts as text, from field metrics."""
    of = lambda run, value: F.max(F.when(F.col("run") == run, value))
    told = F.concat_ws("/", F.coalesce("exact_count", F.lit(0)), F.coalesce("applicable_count", F.lit(0)))
    each = [x for r in runs for x in (F.coalesce(of(r, F.col("strict_f1")), F.lit(0.0)).alias(f"{r}_strict_f1"), F.coalesce(of(r, told), F.lit("0/0")).alias(f"{r}_exact"))]
    return fields.groupBy("field").agg(*each)


def failure_shift(failures: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Per failure category how many more keys the second run has."""
    by_run = by_category(failures, key).groupBy("category").agg(F.count_if(F.col("run") == first).alias("n_first"), F.count_if(F.col("run") == second).alias("n_second"))
    return by_run.withColumn("shift", F.col("n_second") - F.col("n_first"))


def best_run(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Per metric the run of the largest value, ties to the first name."""
    long = metrics.unpivot(["run"], names, "metric", "value").where("value is not null")
    order = Window.partitionBy("metric").orderBy(F.desc("value"), "run")
    return long.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("metric", "run", "value")


def label_shift(labelled: DataFrame, first: str, second: str) -> DataFrame:
    """Per field and label how many more the second run has."""
    by_run = labelled.groupBy("field", "label").agg(F.count_if(F.col("run") == first).alias("n_first"), F.count_if(F.col("run") == second).alias("n_second"))
    return by_run.withColumn("shift", F.col("n_second") - F.col("n_first"))


def label_transition(labelled: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Counts of (field, label in first, label in second) over samples that both runs have."""
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("label")))
    both = labelled.where(F.col("run").isin(first, second)).groupBy(key, "field").agg(of(first).alias("label_first"), of(second).alias("label_second"))
    return both.where("label_first is not null and label_second is not null").groupBy("field", "label_first", "label_second").agg(F.count(F.lit(1)).alias("n"))


def mismatch_audit(labelled: DataFrame, key: str) -> DataFrame:
    """Per key with a mismatch (gold and prediction differ once trimmed and lower-cased): how many, and one of five classes."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    bad = labelled.where(norm("gold") != norm("pred"))
    per = bad.groupBy("run", key).agg(F.count(F.lit(1)).alias("mismatches"), F.max(F.col("pred").isNull()).alias("no_pred"), F.max(F.col("gold").isNull()).alias("no_gold"), F.count_if(F.col("label") == "wrong").alias("wrong"), F.count_if(F.col("label") == "partial").alias("part"))
    kind = F.when(F.col("no_pred") & ~F.col("no_gold"), "pred_missing_fields_gold_has_values").when(F.col("no_gold") & ~F.col("no_pred"), "pred_too_verbose").when((F.col("wrong") > 0) & (F.col("part") > 0), "mixed_errors").when(F.col("wrong") > 0, "semantic_mismatch").otherwise("partial_match_or_format_diff")
    return per.select("run", key, "mismatches", kind.alias("classification"))


def error_taxonomy(failures: DataFrame, key: str) -> DataFrame:
    """Per run and category how many keys have it, and the smallest of them; the inversion itself is by_category."""
    return by_category(failures, key).groupBy("run", "category").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def by_category(failures: DataFrame, key: str) -> DataFrame:
    """(run, category, key) of every failure: the inverted taxonomy as rows, which no group needs to hold whole."""
    return failures.select("run", key, F.explode("failures").alias("category"))


def sorted_ids(failures: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """(run, category, chunk, ids) of every failure: the inverted taxonomy as sorted lists of distinct keys, cut into chunks of `size`.

    The chunks of a category in order are its whole list. Keys are dealt to ranges by (run, category, key), counts of the
    ranges before a range tell where its keys stand, and a list is gathered by chunk alone, so that no task holds a category.
    """
    each = by_category(failures, key).where(F.col("category").isNotNull() & F.col(key).isNotNull()).distinct()
    dealt = cut(each.repartitionByRange("run", "category", key).withColumn("part", F.spark_partition_id()))
    of = ["run", "category", "part"]
    before = F.coalesce(F.sum("count").over(Window.partitionBy("run", "category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = dealt.groupBy(*of).count().select(*of, before.alias("ahead"))
    place = F.row_number().over(Window.partitionBy(*of).orderBy(key)) + F.col("ahead") - 1
    placed = dealt.join(ahead, of).select("run", "category", key, F.floor(place / size).cast("long").alias("chunk"))
    return placed.groupBy("run", "category", "chunk").agg(F.sort_array(F.collect_list(key)).alias("ids"))
