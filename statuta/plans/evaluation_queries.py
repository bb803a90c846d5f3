"""Queries of text scalars, evaluation and comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import strings as S
from statuta.operators import comparison as C
from statuta.operators import evaluation as E
from statuta.plans.corpora import corpus, with_parts


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def norm_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _conversations(spark, sf_dir)
    return t.select("conv_id", "turn", S.clean_field(F.col("text")).alias("cleaned"), S.clean_field(F.col("text"), lower=True).alias("lowered"))


def norm_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus(spark, sf_dir, "rules")
    padded = F.concat(F.lit("  "), F.when(F.col("rule_id") % 3 == 0, F.concat(F.lit("No person "), "marker")).otherwise(F.upper("marker")), F.lit("."))
    return r.select(S.canonical_modality(padded).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


def norm_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", S.words_only(F.col("text")).alias("words"))


def norm_eval_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", S.without_marks(F.col("text")).alias("words"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus(spark, sf_dir, "predictions").where("field <> 'modality'")
    g, q = (S.tokens(S.without_marks(F.coalesce(F.col(c), F.lit("")))) for c in ("gold", "pred"))
    return p.select("run", "rule_id", "field", S.jaccard(g, q).alias("jaccard"))


def trim_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _conversations(spark, sf_dir).select("conv_id", "turn", S.trim_span(F.concat("text", F.lit(" ;. ")), F.col("turn")).alias("s"))
    return t.select("conv_id", "turn", F.col("s.text").alias("kept"), "s.span_start", "s.span_end")


def field_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.field_confusion(corpus(spark, sf_dir, "predictions"))
    return c.groupBy("run", "field").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])


def field_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prf(E.field_confusion(corpus(spark, sf_dir, "predictions")), "run", "field")


def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prf(E.field_confusion(corpus(spark, sf_dir, "predictions")), "run")


def label_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_v1(corpus(spark, sf_dir, "predictions")).select("run", "rule_id", "field", "label")


def label_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_v2(corpus(spark, sf_dir, "predictions")).select("run", "rule_id", "field", "label")


def evaluate_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_counts(E.label_v1(corpus(spark, sf_dir, "predictions")), "run", "field")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = E.label_v1(corpus(spark, sf_dir, "predictions"))
    error = F.when(F.col("rule_id") % 17 == 0, "timeout")
    return E.failure_categories(labelled, ["run", "rule_id"], F.col("rule_id") % 19 != 0, error)


def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir).select("run", "rule_id", F.array_join("failures", ",").alias("failures"))


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.error_taxonomy(_failures(spark, sf_dir), "rule_id")


COUNTS = ["exact_count", "partial_count", "missing_count", "wrong_count", "not_applicable_count"]
RATES = ["strict_precision", "strict_recall", "strict_f1", "lenient_precision", "lenient_recall", "lenient_f1", "exact_accuracy"]


def field_metrics_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evaluate_v2(corpus(spark, sf_dir, "predictions")).where("field is not null")


def micro_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evaluate_v2(corpus(spark, sf_dir, "predictions")).where("field is null").drop("field")


def macro_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro_v2(E.evaluate_v2(corpus(spark, sf_dir, "predictions")))


def evaluate_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: micro rates and macro rates of every run in one row each."""
    return E.report_v2(corpus(spark, sf_dir, "predictions"), RATES)


def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    micro = evaluate_v2(spark, sf_dir)
    names = [*RATES, "macro_strict_f1", "macro_lenient_f1"]
    return C.run_delta(micro.where("run = 'a'").select(*names), micro.where("run = 'b'").select(*names), names)


def field_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = field_metrics_v2(spark, sf_dir)
    return C.field_delta(f.where("run = 'a'"), f.where("run = 'b'"), ["exact_accuracy", "strict_f1", "lenient_f1"])


def field_delta_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = field_metrics_v2(spark, sf_dir)
    return C.field_delta(f.where("run = 'a' and field <> 'actor'"), f.where("run = 'b' and field <> 'exception'"), ["strict_f1"], outer=True)


def nway_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate_v2(spark, sf_dir).withColumn("strict_f1", F.when(F.col("run") != "b", F.col("strict_f1")))  # b reports no strict_f1
    return C.nway_table(found.select("run", *RATES), RATES, ["a", "b"], "lenient_f1")


def nway_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nway_fields(field_metrics_v2(spark, sf_dir), ["a", "b"])


def failure_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.failure_shift(_failures(spark, sf_dir), "rule_id", "a", "b")


def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted taxonomy: every sample of every category."""
    return C.by_category(_failures(spark, sf_dir), "rule_id")


def error_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted taxonomy: the sorted samples of every category, in chunks."""
    found = C.sorted_ids(_failures(spark, sf_dir), "rule_id")
    return found.select("run", "category", "chunk", F.size("ids").alias("n"), F.md5(F.array_join("ids", ",").cast("binary")).alias("ids"))


def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batch_failures(_failures(spark, sf_dir), F.col("rule_id") % 19 != 0)


def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_run(evaluate_v2(spark, sf_dir).select("run", *RATES), RATES)


def label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_shift(E.label_v2(corpus(spark, sf_dir, "predictions")), "a", "b")


def label_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_transition(E.label_v2(corpus(spark, sf_dir, "predictions")), "rule_id", "a", "b")


def mismatch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mismatch_audit(E.label_v2(corpus(spark, sf_dir, "predictions")), "rule_id").groupBy("run", "classification").agg(F.count(F.lit(1)).alias("n"), F.sum("mismatches").alias("mismatches"))


def source_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.label_v2(corpus(spark, sf_dir, "predictions"))
    each = p.groupBy("run", "rule_id").agg(F.sort_array(F.collect_list(F.struct("fidx", "field", "label", "gold", "pred"))).alias("d"))  # six fields
    told = lambda x: F.concat(x["field"], F.lit("="), x["label"], F.lit(":"), F.coalesce(x["gold"], F.lit("-")), F.lit(">"), F.coalesce(x["pred"], F.lit("-")))
    return each.select("run", "rule_id", F.array_join(F.transform("d", told), ";").alias("detail"))


QUERIES = {f.__name__: f for f in (norm_field, norm_modality, norm_eval, norm_eval_b, jaccard_pairs, trim_span, field_confusion, field_prf, micro_prf, label_v1, label_v2, evaluate_v1, failure_categories, error_taxonomy, error_lists, field_metrics_v2, micro_v2, macro_v2, evaluate_v2, run_delta, field_delta, field_delta_outer, nway_table, nway_fields, best_run, label_shift, failure_shift, failure_rows, batch_failures, label_transition, mismatch_audit, source_detail)}

P = with_parts("predictions")
_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_B = "trim(regexp_replace(regexp_replace(trim(lower({0})), '\\s+', ' ', 'g'), '[.,;:!?\"''()-]', '', 'g'))"
_B1 = "regexp_replace(regexp_replace(trim(lower({0})), '\\s+', ' ', 'g'), '[.,;:!?\"''()-]', '', 'g')"
_A = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOK = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''))"


def _jac(g: str, p: str) -> str:
    a, b = _TOK.format(g), _TOK.format(p)
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


_L2 = f"""
, n AS (SELECT *, coalesce(gold, '') = '' AS ng, coalesce(pred, '') = '' AS np, {_B.format("coalesce(gold, '')")} AS g, {_B.format("coalesce(pred, '')")} AS p FROM predictions)
, j AS (SELECT *, {_jac('g', 'p')} AS s FROM n)
, labels AS (SELECT run, rule_id, fidx, field, gold, pred, CASE WHEN ng AND np THEN 'not_applicable' WHEN np THEN 'missing' WHEN ng THEN 'wrong'
  WHEN field = 'modality' THEN CASE WHEN gold = pred THEN 'exact' ELSE 'wrong' END
  WHEN g = p OR s = 1 THEN 'exact' WHEN s >= 0.5 THEN 'partial' ELSE 'wrong' END AS label FROM j)
"""
_L1 = f"""
, n AS (SELECT *, coalesce(gold, '') = '' AS ng, coalesce(pred, '') = '' AS np, {_B1.format("coalesce(gold, '')")} AS g, {_B1.format("coalesce(pred, '')")} AS p FROM predictions)
, j AS (SELECT *, {_jac('g', 'p')} AS s FROM n)
, labels AS (SELECT run, rule_id, fidx, field, gold, pred, CASE WHEN ng AND np THEN CASE WHEN field = 'modality' THEN 'exact' ELSE 'not_applicable' END WHEN np THEN 'missing' WHEN ng THEN 'wrong'
  WHEN field = 'modality' THEN CASE WHEN gold = pred THEN 'exact' ELSE 'wrong' END
  WHEN g = p THEN 'exact' WHEN contains(g, p) OR contains(p, g) OR s >= 0.5 THEN 'partial' ELSE 'wrong' END AS label FROM j)
"""
_CELLS = ", ".join(f"count(*) FILTER (label = '{x}') AS {x}_count" for x in E.LABELS)


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END)"


def _hm(p: str, r: str) -> str:
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END)"


def _metrics(by: str) -> str:
    e, ep = "exact_count", "exact_count + partial_count"
    said, due = f"{ep} + wrong_count", f"{ep} + wrong_count + missing_count"
    return f"""c AS (SELECT {by}, {_CELLS} FROM labels GROUP BY {by}),
r AS (SELECT *, {due} AS applicable_count, {_div(e, said)} AS sp, {_div(e, due)} AS sr, {_div(ep, said)} AS lp, {_div(ep, due)} AS lr FROM c),
m AS (SELECT {by}, {', '.join(COUNTS)}, applicable_count, round(sp, 4) AS strict_precision, round(sr, 4) AS strict_recall, round({_hm('sp', 'sr')}, 4) AS strict_f1,
  round(lp, 4) AS lenient_precision, round(lr, 4) AS lenient_recall, round({_hm('lp', 'lr')}, 4) AS lenient_f1, round(sr, 4) AS exact_accuracy FROM r)"""


_FIELDS = f"{P}{_L2}, {_metrics('run, field')}"
_MACRO = "SELECT run, round(avg(strict_f1), 4) AS macro_strict_f1, round(avg(lenient_f1), 4) AS macro_lenient_f1, round(sum(exact_count)::DOUBLE / sum(applicable_count), 4) AS overall_exact_accuracy FROM m GROUP BY run"
_EVAL = f"{P}{_L2}, {_metrics('run, field')}, macro AS ({_MACRO}), {_metrics('run').replace('c AS', 'c1 AS').replace('FROM c)', 'FROM c1)').replace('r AS', 'r1 AS').replace('FROM r)', 'FROM r1)').replace('m AS', 'm1 AS')}, whole AS (SELECT m1.run, {', '.join('m1.' + x for x in RATES)}, macro_strict_f1, macro_lenient_f1, overall_exact_accuracy FROM m1 JOIN macro ON m1.run = macro.run)"
_LONG = f"l AS (UNPIVOT (SELECT run, {', '.join(RATES)} FROM whole) ON {', '.join(RATES)} INTO NAME metric VALUE value)"
_CONF = f"""{P}, n AS (SELECT *, {_A.format('gold')} AS g, {_A.format('pred')} AS p FROM predictions),
k AS (SELECT run, field, (gold IS NOT NULL AND pred IS NOT NULL AND g = p)::INT AS tp, (pred IS NOT NULL AND NOT (gold IS NOT NULL AND g = p))::INT AS fp,
  (gold IS NOT NULL AND NOT (pred IS NOT NULL AND g = p))::INT AS fn FROM n)"""


def _prf(by: str) -> str:
    return f"""{_CONF}, s AS (SELECT {by}, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM k GROUP BY {by}), q AS (SELECT *, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r FROM s)
SELECT {by}, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round({_hm('p', 'r')}, 4) AS f1 FROM q"""


_FAIL = f"""{P}{_L1}, f AS (SELECT run, rule_id, CASE WHEN field IN ('actor', 'action') THEN CASE WHEN label = 'missing' THEN concat(field, '_missing') END WHEN label IN ('wrong', 'missing') THEN concat(field, '_wrong') END AS category FROM labels
  UNION SELECT run, rule_id, 'schema_invalid' FROM labels WHERE rule_id % 19 = 0 UNION SELECT run, rule_id, 'timeout' FROM labels WHERE rule_id % 17 = 0)"""

SQL = {
    "norm_field": f"SELECT conv_id, turn, trim({_CLEAN}, '.,;:!?\"''') AS cleaned, trim(lower({_CLEAN}), '.,;:!?\"''') AS lowered FROM conversations",
    "norm_modality": f"""{with_parts('rules')}, t AS (SELECT trim(lower(trim(CASE WHEN rule_id % 3 = 0 THEN concat('No person ', marker) ELSE marker END || '.')), '.,;:!?"''') AS m FROM rules),
u AS (SELECT CASE m WHEN 'no person shall' THEN 'shall not' ELSE m END AS m FROM t)
SELECT m AS marker, count(*) AS n FROM u GROUP BY m""",
    "norm_eval": f"SELECT conv_id, turn, {_A.format('text')} AS words FROM conversations",
    "norm_eval_b": f"SELECT conv_id, turn, {_B.format('text')} AS words FROM conversations",
    "jaccard_pairs": f"""{P}, n AS (SELECT *, {_B.format("coalesce(gold, '')")} AS g, {_B.format("coalesce(pred, '')")} AS p FROM predictions WHERE field <> 'modality') SELECT run, rule_id, field, {_jac('g', 'p')} AS jaccard FROM n""",
    "trim_span": "SELECT conv_id, turn, rtrim(text, '.,;:!? \t') AS kept, turn::INT AS span_start, (turn + length(rtrim(text, '.,;:!? \t')))::INT AS span_end FROM conversations",
    "field_confusion": f"{_CONF} SELECT run, field, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM k GROUP BY ALL",
    "field_prf": _prf("run, field"),
    "micro_prf": _prf("run"),
    "label_v1": f"{P}{_L1} SELECT run, rule_id, field, label FROM labels",
    "label_v2": f"{P}{_L2} SELECT run, rule_id, field, label FROM labels",
    "evaluate_v1": f"{P}{_L1} SELECT run, field, {_CELLS} FROM labels GROUP BY ALL",
    "failure_categories": f"{_FAIL} SELECT run, rule_id, coalesce(string_agg(category, ',' ORDER BY category), '') AS failures FROM f GROUP BY ALL",
    "error_taxonomy": f"{_FAIL} SELECT run, category, count(*) AS n, min(rule_id) AS first_id, max(rule_id) AS last_id FROM f WHERE category IS NOT NULL GROUP BY ALL",
    "field_metrics_v2": f"{_FIELDS} SELECT * FROM m",
    "micro_v2": f"{P}{_L2}, {_metrics('run')} SELECT * FROM m",
    "macro_v2": f"{_FIELDS} {_MACRO}",
    "evaluate_v2": f"{_EVAL} SELECT * FROM whole",
    "run_delta": f"""{_EVAL}, l AS (UNPIVOT (SELECT run, {', '.join(RATES)}, macro_strict_f1, macro_lenient_f1 FROM whole) ON {', '.join(RATES)}, macro_strict_f1, macro_lenient_f1 INTO NAME metric VALUE value)
SELECT metric, x.value AS value_a, y.value AS value_b, round(y.value - x.value, 6) AS delta, true AS available FROM (SELECT * FROM l WHERE run = 'a') x JOIN (SELECT * FROM l WHERE run = 'b') y USING (metric)""",
    "field_delta": f"{_FIELDS} SELECT x.field, " + ", ".join(f"x.{c} AS {c}_a, y.{c} AS {c}_b, round(y.{c} - x.{c}, 6) AS {c}_delta" for c in ("exact_accuracy", "strict_f1", "lenient_f1")) + " FROM m x JOIN m y ON x.field = y.field WHERE x.run = 'a' AND y.run = 'b'",
    "field_delta_outer": f"{_FIELDS} SELECT coalesce(x.field, y.field) AS field, x.strict_f1 AS strict_f1_a, y.strict_f1 AS strict_f1_b, round(y.strict_f1 - x.strict_f1, 6) AS strict_f1_delta FROM (SELECT * FROM m WHERE run = 'a' AND field <> 'actor') x FULL JOIN (SELECT * FROM m WHERE run = 'b' AND field <> 'exception') y ON x.field = y.field",
    "nway_fields": f"{_FIELDS} SELECT field, " + ", ".join(f"coalesce(max(strict_f1) FILTER (run = '{r}'), 0.0) AS {r}_strict_f1, coalesce(max(exact_count || '/' || applicable_count) FILTER (run = '{r}'), '0/0') AS {r}_exact" for r in "ab") + " FROM m GROUP BY field",
    "failure_shift": f"{_FAIL} SELECT category, count(*) FILTER (run = 'a') AS n_first, count(*) FILTER (run = 'b') AS n_second, count(*) FILTER (run = 'b') - count(*) FILTER (run = 'a') AS shift FROM f WHERE category IS NOT NULL GROUP BY category",
    "error_lists": f"{_FAIL}, d AS (SELECT run, category, rule_id, row_number() OVER (PARTITION BY run, category ORDER BY rule_id) - 1 AS no FROM (SELECT DISTINCT run, category, rule_id FROM f WHERE category IS NOT NULL)) SELECT run, category, no // 10000 AS chunk, count(*)::INT AS n, md5(string_agg(rule_id::VARCHAR, ',' ORDER BY rule_id)) AS ids FROM d GROUP BY ALL",
    "failure_rows": f"{_FAIL} SELECT run, rule_id, category FROM f WHERE category IS NOT NULL",
    "batch_failures": f"{_FAIL} SELECT run, category, count(*) AS n FROM f WHERE category IS NOT NULL GROUP BY ALL UNION ALL SELECT run, 'schema_valid', count(DISTINCT rule_id) FROM predictions WHERE rule_id % 19 <> 0 GROUP BY run",
    "nway_table": f"{_EVAL.replace('m1.strict_f1', 'CASE WHEN m1.run = CHR(98) THEN m1.lenient_f1 ELSE m1.strict_f1 END AS strict_f1', 1)}, {_LONG} SELECT metric, max(value) FILTER (run = 'a') AS a, max(value) FILTER (run = 'b') AS b FROM l GROUP BY metric",
    "best_run": f"{_EVAL}, {_LONG} SELECT metric, run, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, run) AS rn FROM l) WHERE rn = 1",
    "label_shift": f"{P}{_L2} SELECT field, label, count(*) FILTER (run = 'a') AS n_first, count(*) FILTER (run = 'b') AS n_second, count(*) FILTER (run = 'b') - count(*) FILTER (run = 'a') AS shift FROM labels GROUP BY field, label",
    "label_transition": f"{P}{_L2} SELECT x.field, x.label AS label_first, y.label AS label_second, count(*) AS n FROM labels x JOIN labels y ON x.rule_id = y.rule_id AND x.field = y.field WHERE x.run = 'a' AND y.run = 'b' GROUP BY ALL",
    "mismatch_audit": f"""{P}{_L2}, a AS (SELECT run, rule_id, count(*) AS mismatches, bool_or(pred IS NULL) AS np, bool_or(gold IS NULL) AS ng, count(*) FILTER (label = 'wrong') AS w, count(*) FILTER (label = 'partial') AS pa
  FROM labels WHERE lower(trim(coalesce(gold, ''))) <> lower(trim(coalesce(pred, ''))) GROUP BY ALL)
SELECT run, CASE WHEN np AND NOT ng THEN 'pred_missing_fields_gold_has_values' WHEN ng AND NOT np THEN 'pred_too_verbose' WHEN w > 0 AND pa > 0 THEN 'mixed_errors' WHEN w > 0 THEN 'semantic_mismatch' ELSE 'partial_match_or_format_diff' END AS classification,
  count(*) AS n, sum(mismatches)::BIGINT AS mismatches FROM a GROUP BY ALL""",
    "source_detail": f"{P}{_L2} SELECT run, rule_id, string_agg(field || '=' || label || ':' || coalesce(gold, '-') || '>' || coalesce(pred, '-'), ';' ORDER BY fidx) AS detail FROM labels GROUP BY ALL",
}
