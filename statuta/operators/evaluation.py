"""Scores of predictions against gold, set-wise over long tables (run, id, field, gold, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import strings as S

LABELS = ["exact", "partial", "missing", "wrong", "not_applicable"]


def _modality_label(gold: Column, pred: Column, both_empty: str) -> Column:
    g, p = F.lower(F.trim(F.coalesce(gold, F.lit("")))), F.lower(F.trim(F.coalesce(pred, F.lit(""))))
    return F.when((g == "") & (p == ""), both_empty).when(g == p, "exact").when(p == "", "missing").otherwise("wrong")


def _labelled(pairs: DataFrame, normal, exact_at_one: bool, containment: bool, both_empty: str) -> DataFrame:
    """pairs with label. Normal forms and similarity are columns of their own, so each is computed once a row, and the
    similarity only where the forms differ."""
    gold, pred = F.coalesce("gold", F.lit("")), F.coalesce("pred", F.lit(""))
    text = (F.col("field") != "modality") & (gold != "") & (pred != "")
    rows = pairs.withColumns({"_g": F.when(text, normal(gold)), "_p": F.when(text, normal(pred))})
    rows = rows.withColumns({"_tg": F.when(F.col("_g") != F.col("_p"), S.tokens(F.col("_g"))), "_tp": F.when(F.col("_g") != F.col("_p"), S.tokens(F.col("_p")))})
    rows = rows.withColumn("_s", S.jaccard(F.col("_tg"), F.col("_tp")))
    exact = F.col("_g") == F.col("_p")
    partial = F.col("_s") >= 0.5
    if exact_at_one:
        exact = exact | (F.col("_s") == 1.0)
    if containment:
        partial = partial | F.contains("_g", F.col("_p")) | F.contains("_p", F.col("_g"))
    label = F.when(F.col("field") == "modality", _modality_label(F.col("gold"), F.col("pred"), both_empty)).when((gold == "") & (pred == ""), "not_applicable").when(pred == "", "missing").when(gold == "", "wrong").when(exact, "exact").when(partial, "partial").otherwise("wrong")
    return rows.withColumn("label", label).drop("_g", "_p", "_tg", "_tp", "_s")


def label_v1(pairs: DataFrame) -> DataFrame:
    """label by the first rules: two absent modalities are exact, and a text that contains the other is partial."""
    return _labelled(pairs, lambda c: S.without_marks(c, False), False, True, "exact")


def label_v2(pairs: DataFrame) -> DataFrame:
    """label by the second rules: two absent values are not applicable, equal token sets are exact, no containment."""
    return _labelled(pairs, S.without_marks, True, False, "not_applicable")


def label_counts(labelled: DataFrame, *by: str) -> DataFrame:
    """Counts of each label by the given columns, zero cells included."""
    return labelled.groupBy(*by).agg(*[F.count_if(F.col("label") == x).alias(f"{x}_count") for x in LABELS])


def metrics(counts: DataFrame) -> DataFrame:
    """Strict and lenient precision, recall and F1, and exact accuracy, from label counts; to four places.

    What was predicted where gold is absent stands in the denominator of recall too.
    """
    e, p, w, m = (F.col(f"{x}_count") for x in ("exact", "partial", "wrong", "missing"))
    said, due = e + p + w, e + p + w + m
    sp, sr, lp, lr = S.ratio(e, said), S.ratio(e, due), S.ratio(e + p, said), S.ratio(e + p, due)
    named = {"applicable_count": due, "strict_precision": sp, "strict_recall": sr, "strict_f1": S.f1(sp, sr), "lenient_precision": lp, "lenient_recall": lr, "lenient_f1": S.f1(lp, lr), "exact_accuracy": S.ratio(e, due)}
    return counts.withColumns({k: v if k == "applicable_count" else F.round(v, 4) for k, v in named.items()})


def evaluate_v2(pairs: DataFrame) -> DataFrame:
    """Per run and field the metrics of the second rules; field is null in the row over all fields (micro average).

    Labels are counted by run and field once; the rows over all fields are sums of these few.
    """
    counts = label_counts(label_v2(pairs), "run", "field")
    rolled = counts.rollup("run", "field").agg(*[F.sum(f"{x}_count").alias(f"{x}_count") for x in LABELS])
    return metrics(rolled.where(F.col("run").isNotNull()))


def report_v2(pairs: DataFrame, rates: list[str]) -> DataFrame:
    """One row a run: the micro rates and the macro rates, from one pass over the metrics."""
    found, own = evaluate_v2(pairs), F.col("field").isNotNull()
    ratio = S.ratio(F.sum(F.when(own, F.col("exact_count"))), F.sum(F.when(own, F.col("applicable_count"))))
    macro = {f"macro_{x}": F.round(F.avg(F.when(own, F.col(x))), 4) for x in ("strict_f1", "lenient_f1")} | {"overall_exact_accuracy": F.round(ratio, 4)}
    return found.groupBy("run").agg(*[F.max(F.when(~own, F.col(r))).alias(r) for r in rates], *[v.alias(k) for k, v in macro.items()])


def macro_v2(fields: DataFrame) -> DataFrame:
    """Per run the mean over fields of the rounded F1, and overall exact accuracy."""
    return fields.where(F.col("field").isNotNull()).groupBy("run").agg(F.round(F.avg("strict_f1"), 4).alias("macro_strict_f1"), F.round(F.avg("lenient_f1"), 4).alias("macro_lenient_f1"), F.round(S.ratio(F.sum("exact_count"), F.sum("applicable_count")), 4).alias("overall_exact_accuracy"))


def failure_categories(labelled: DataFrame, keys: list[str], schema_valid: Column, error: Column) -> DataFrame:
    """Per key the sorted distinct failure categories of its labels, of an invalid schema and of a runtime error."""
    bad = F.when(F.col("field").isin("actor", "action"), F.when(F.col("label") == "missing", F.concat("field", F.lit("_missing")))).otherwise(F.when(F.col("label").isin("wrong", "missing"), F.concat("field", F.lit("_wrong"))))
    each = labelled.withColumn("bad", F.array_compact(F.array(bad, F.when(~schema_valid, "schema_invalid"), F.nullif(error, F.lit("")))))
    return each.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bad")))).alias("failures"))


def field_confusion(pairs: DataFrame) -> DataFrame:
    """tp, fp and fn of each row: equal normal forms, differing ones (both), one side alone."""
    g, p = S.words_only(F.col("gold")), S.words_only(F.col("pred"))
    has_g, has_p = F.col("gold").isNotNull(), F.col("pred").isNotNull()
    same = has_g & has_p & (g == p)
    return pairs.withColumns({"tp": same.cast("int"), "fp": (has_p & ~F.coalesce(same, F.lit(False))).cast("int"), "fn": (has_g & ~F.coalesce(same, F.lit(False))).cast("int")})


def prf(confusion: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of summed tp, fp and fn by the given columns; by none, over all."""
    sums = confusion.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    p, r = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(S.f1(p, r), 4)})


def align_clauses(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Clauses of both sides by source and place: a full join within the sources of gold.

    gold and pred have (source_id, seg_idx, text); matched where both sides have the place.
    """
    own = pred.join(gold.select("source_id").distinct(), "source_id", "left_semi")
    g, p = gold.withColumnRenamed("text", "gold_text"), own.withColumnRenamed("text", "pred_text")
    return g.join(p, ["source_id", "seg_idx"], "full_outer").withColumn("matched", F.col("gold_text").isNotNull() & F.col("pred_text").isNotNull())


def clause_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Clause rates by counts: of each source of gold, the lesser of both numbers of clauses is matched.

    gold and pred have (source_id, ...), one row a clause. One row: n_gold, n_pred, n_matched, precision, recall and f1.
    """
    g = gold.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_g"))
    p = pred.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_p"))
    each = g.join(p, "source_id", "left").select("n_g", F.coalesce("n_p", F.lit(0)).alias("n_p"))
    one = each.agg(F.sum("n_g").alias("n_gold"), F.sum("n_p").alias("n_pred"), F.sum(F.least("n_g", "n_p")).alias("n_matched"))
    precision, recall = S.ratio(F.col("n_matched"), F.col("n_pred")), S.ratio(F.col("n_matched"), F.col("n_gold"))
    return one.select("*", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(S.f1(precision, recall), 4).alias("f1"))


def clause_fields(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Rates of fields over clauses of both sides aligned by source and place, and over all fields where field is null.

    gold and pred have (source_id, seg_idx, field, text). A clause that one side alone has is missing or extra in all its fields.
    """
    own = pred.join(gold.select("source_id").distinct(), "source_id", "left_semi")
    both = gold.withColumnRenamed("text", "gold").join(own.withColumnRenamed("text", "pred"), ["source_id", "seg_idx", "field"], "full_outer")
    counts = field_confusion(both).groupBy("field").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return prf(counts.unionByName(counts.withColumn("field", F.lit(None).cast("string"))), "field")


def batch_failures(failures: DataFrame, valid: Column) -> DataFrame:
    """Per run how many samples have each failure category, and as schema_valid how many are valid."""
    each = failures.select("run", F.explode(F.concat("failures", F.when(valid, F.array(F.lit("schema_valid"))).otherwise(F.array().cast("array<string>")))).alias("category"))
    return each.groupBy("run", "category").agg(F.count(F.lit(1)).alias("n"))
