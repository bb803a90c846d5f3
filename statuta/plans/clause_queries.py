"""Queries of the rule-first parts of sentences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import clauses as C
from statuta.operators import gates as G
from statuta.plans.corpora import corpus, with_parts

R = with_parts("rules")


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "rules").select("rule_id", "text")


def modality_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _rules(spark, sf_dir).select("rule_id", C.modality_hits(F.col("text")).alias("h"))
    return h.select("rule_id", F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["marker"], x["start"], x["stop"])), ",").alias("hits"))


def initial_unless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("rule_id", C.initial_unless(F.col("text"))["text"].alias("condition"))


def mid_unless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("rule_id", C.mid_unless(F.col("text")).alias("at"))


def seg_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("rule_id", C.first_modality(F.col("text")).alias("m")).select("rule_id", "m.marker", "m.start", "m.stop")


def _after(kind) -> DataFrame:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = _rules(spark, sf_dir).withColumn("m", C.first_modality(F.col("text"))).where("m is not null").withColumn("stop", F.col("m.stop"))
        return m.select("rule_id", kind(F.col("text"), F.col("stop")).alias("s")).select("rule_id", "s.text", "s.start", F.col("s.stop").alias("end_at"))
    return run


def looks_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("rule_id", C.looks_like_definition(F.col("text")).alias("definition"))


QUERIES = {"modality_hits": modality_hits, "initial_unless": initial_unless, "mid_unless": mid_unless, "seg_modality": seg_modality, "seg_constraint": _after(C.constraint), "seg_exception": _after(C.exception), "looks_definition": looks_definition}

_FIRST = f"""{R}, m AS (SELECT * FROM (VALUES (0, 'no person shall'), (1, 'shall not'), (2, 'must not'), (3, 'shall'), (4, 'must'), (5, 'may')) v(prio, mark)),
h AS (SELECT rule_id, text, prio, mark, instr(lower(text), mark) AS p FROM rules JOIN m ON contains(lower(text), mark)),
o AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY prio) AS rn FROM h WHERE NOT regexp_matches(substr(text, greatest(p - 1, 1), CASE WHEN p > 1 THEN 1 ELSE 0 END), '\\p{{L}}') AND NOT regexp_matches(substr(text, p + length(mark), 1), '\\p{{L}}')),
f AS (SELECT rule_id, text, mark, p - 1 AS start, p - 1 + length(mark) AS stop FROM o WHERE rn = 1)"""
_MID = "CASE WHEN regexp_matches(substr(text, 2), '(?i)\\bunless\\b') THEN length(regexp_extract(text, '(?is)^(..*?)\\bunless\\b', 1)) END"
_HITS = "'(?i)\\b(no person shall|shall not|must not|shall|must|may)\\b'"

SQL = {
    "initial_unless": f"{R} SELECT rule_id, nullif(regexp_extract(text, '(?i)^(Unless\\s+\\w+(?:\\s+\\w+)*?)\\s*,?\\s+', 1), '') AS condition FROM rules",
    "mid_unless": f"{R} SELECT rule_id, ({_MID})::INT AS at FROM rules",
    "seg_modality": f"{_FIRST} SELECT rules.rule_id, substr(rules.text, start + 1, length(mark)) AS marker, start::INT AS start, stop::INT AS stop FROM rules LEFT JOIN f ON f.rule_id = rules.rule_id",
    "modality_hits": f"""{R}, t AS (SELECT rule_id, substr(text, 1, coalesce({_MID}, length(text))) AS part FROM rules), e AS (SELECT rule_id, regexp_extract_all(part, {_HITS}) AS marks, regexp_split_to_array(part, {_HITS}) AS gaps FROM t),
u AS (SELECT rule_id, i, marks[i] AS mark, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(marks[1:i - 1], lambda x: length(x))), 0) AS start FROM e, range(1, 9) r(i) WHERE i <= len(marks))
SELECT rules.rule_id, coalesce(string_agg(mark || ':' || start::INT || ':' || (start + length(mark))::INT, ',' ORDER BY i), '') AS hits FROM rules LEFT JOIN u ON u.rule_id = rules.rule_id GROUP BY rules.rule_id""",
    "seg_constraint": f"""{_FIRST}, c AS (SELECT f.rule_id, f.text, min(stop + instr(lower(substr(f.text, stop + 1)), w)) AS p FROM f, (VALUES ('within'), ('before'), ('after'), ('only if'), ('provided that')) v(w) WHERE contains(lower(substr(f.text, stop + 1)), w) GROUP BY ALL)
SELECT f.rule_id, rtrim(substr(c.text, p), '.,;:!? \t') AS text, (p - 1)::INT AS start, (p - 1 + length(rtrim(substr(c.text, p), '.,;:!? \t')))::INT AS end_at FROM f LEFT JOIN c ON c.rule_id = f.rule_id""",
    "seg_exception": f"""{_FIRST}, c AS (SELECT rule_id, text, stop + instr(lower(substr(text, stop + 1)), 'unless ') AS p FROM f WHERE contains(lower(substr(text, stop + 1)), 'unless '))
SELECT f.rule_id, rtrim(substr(c.text, p), '.,;:!? \t') AS text, (p - 1)::INT AS start, (p - 1 + length(rtrim(substr(c.text, p), '.,;:!? \t')))::INT AS end_at FROM f LEFT JOIN c ON c.rule_id = f.rule_id""",
    "looks_definition": f"""{R} SELECT rule_id, regexp_matches(text, '(?i)\\b\\w+\\s+means\\b|\\b\\w+\\s+is\\s+(a|an|the)\\b|^\\s*"[^"]+"\\s*(means|refers to|denotes)') AS definition FROM rules""",
}


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, clause, c): a row a clause."""
    return _rules(spark, sf_dir).select("rule_id", F.posexplode(C.clauses(F.col("text"))).alias("i", "c")).select("rule_id", (F.col("i") + 1).alias("clause"), "c")


def and_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _rules(spark, sf_dir).select("rule_id", F.posexplode(C.and_boundaries(F.col("text"))).alias("i", "at"))
    return hits.where("i > 0").select("rule_id", (F.col("i") + 1).alias("hit"), "at")


def split_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("rule_id", F.posexplode(C.split(F.col("text"))).alias("i", "s")).select("rule_id", (F.col("i") + 1).alias("clause"), "s.text", "s.start", "s.stop")


def _field(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _clauses(spark, sf_dir).select("rule_id", "clause", F.col(f"c.{name}").alias("s")).select("rule_id", "clause", "s.text", "s.start", F.col("s.stop").alias("end_at"))
    return run


def rule_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir).select("rule_id", "c.clause_id", "c.clause_text", *[F.col(f"c.{f}.text").alias(f) for f in G.FIELDS], "c.confidence")


def nest_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _rules(spark, sf_dir).select("rule_id", C.clauses(F.col("text")).alias("c"))
    line = F.array_join(F.transform("c", lambda c: F.concat_ws("=", c["clause_id"], c["clause_text"])), "|")
    return nested.select("rule_id", F.size("c").alias("n_clauses"), line.alias("clauses"))


def flatten_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("rule_id", C.flattened(C.clauses(F.col("text"))).alias("p")).select("rule_id", "p.*")


def rule_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth text is made null, which gives an error record and no failure."""
    rows = _rules(spark, sf_dir).withColumn("text", F.when(F.col("rule_id") % 50 != 0, F.col("text")))
    return C.baseline(rows, "text").select("rule_id", F.size("clauses").alias("n_clauses"), "error")


_RECORDS = """CASE rule_id % 6 WHEN 0 THEN concat('{"sample_id": ', rule_id, ', "source_id": "s", "predicted": {"modality": null, "actor": "a", "action": "b", "condition": null, "constraint": null, "exception": null}, "runtime": {}, "schema_valid": true}')
WHEN 1 THEN '{"sample_id": 1, "source_id": "s", "predicted": {"modality": null, "actor": "a", "action": "b", "condition": null, "constraint": null, "exception": null}, "runtime": {}, "schema_valid": "true"}'
WHEN 2 THEN '{"sample_id": 1, "source_id": "s", "predicted": {"modality": null, "actor": "a", "action": "b", "condition": null, "constraint": null, "exception": null}, "schema_valid": true}'
WHEN 3 THEN '{"sample_id": 1, "source_id": "s", "predicted": {"modality": null, "actor": "a"}, "runtime": {}, "schema_valid": true}'
WHEN 4 THEN '{"sample_id": 1, "source_id": "s", "predicted": null, "runtime": {}, "schema_valid": true}' ELSE 'none' END"""


def valid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("rule_id", F.expr(_RECORDS).alias("record")).select("rule_id", G.valid_prediction(F.col("record")).alias("valid"))


QUERIES |= {"and_boundaries": and_boundaries, "split_clauses": split_clauses, "seg_actor": _field("actor"), "seg_action": _field("action"), "rule_clauses": rule_clauses, "nest_clauses": nest_clauses, "flatten_prediction": flatten_prediction, "rule_baseline": rule_baseline, "valid_predictions": valid_predictions}

_PLACE = "CASE WHEN regexp_matches(tail, '(?i)\\b{0}\\s+the\\s+\\w+') THEN stop + length(regexp_extract(tail, '(?is)^(.*?)\\b{0}\\s+the\\s+\\w+', 1)) END"
_MARKS = "'.,;:!? \t'"
_SPLIT = f"""{R}, t AS (SELECT rule_id, text, nullif(regexp_extract(text, '(?i)^(Unless\\s+\\w+(?:\\s+\\w+)*?)\\s*,?\\s+', 1), '') AS cond, substr(text, 1, coalesce({_MID}, length(text))) AS part FROM rules),
t2 AS (SELECT *, CASE WHEN cond IS NULL THEN 0 ELSE length(cond) + length(regexp_extract(substr(text, length(cond) + 1), '^[, ]*')) END AS opening FROM t),
e AS (SELECT *, regexp_extract_all(part, {_HITS}) AS marks, regexp_split_to_array(part, {_HITS}) AS gaps FROM t2),
u AS (SELECT rule_id, text, opening, i, marks[i] AS mark, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(marks[1:i - 1], lambda x: length(x))), 0) AS start FROM e, range(1, 99) r(i) WHERE i <= len(marks)),
w AS (SELECT *, lag(start + length(mark)) OVER (PARTITION BY rule_id ORDER BY i) AS prev, count(*) OVER (PARTITION BY rule_id) AS n FROM u),
b AS (SELECT *, regexp_split_to_array(substr(text, (prev + 1)::BIGINT, (start - prev)::BIGINT), '(?i)\\b(?:within|before|after|only\\s+if|provided\\s+that)\\b')[1] AS free FROM w),
a AS (SELECT *, CASE WHEN i > 1 AND regexp_matches(free, '(?i)\\band\\b') THEN (prev + length(regexp_extract(free, '(?is)^(.*)\\band\\b', 1)))::BIGINT END AS own FROM b),
g AS (SELECT rule_id, i, CASE WHEN i = 1 THEN opening WHEN own IS NOT NULL THEN own + 3 + length(regexp_extract(substr(text, own + 4), '^ *')) ELSE start END::BIGINT AS lo, coalesce(lead(own) OVER (PARTITION BY rule_id ORDER BY i), length(text)) AS hi FROM a WHERE n > 1
UNION ALL SELECT rule_id, 1, opening, length(text) FROM t2 WHERE rule_id NOT IN (SELECT rule_id FROM u WHERE i > 1)),
s AS (SELECT g.rule_id, g.i, t2.text, t2.cond, t2.opening, lo + length(regexp_extract(substr(t2.text, lo + 1, hi - lo), '^\\s*')) AS st, regexp_replace(substr(t2.text, lo + 1, hi - lo), '^\\s+|\\s+$', '', 'g') AS seg FROM g JOIN t2 ON t2.rule_id = g.rule_id)"""
_ALL = f"""{_SPLIT}, m AS (SELECT * FROM (VALUES (0, 'no person shall'), (1, 'shall not'), (2, 'must not'), (3, 'shall'), (4, 'must'), (5, 'may')) v(prio, mark)),
h AS (SELECT rule_id, i, prio, mark, instr(lower(seg), mark) AS p, seg FROM s JOIN m ON contains(lower(seg), mark)),
o AS (SELECT *, row_number() OVER (PARTITION BY rule_id, i ORDER BY prio) AS rn FROM h WHERE NOT regexp_matches(substr(seg, greatest(p - 1, 1), CASE WHEN p > 1 THEN 1 ELSE 0 END), '\\p{{L}}') AND NOT regexp_matches(substr(seg, p + length(mark), 1), '\\p{{L}}')),
f1 AS (SELECT s.*, st + p - 1 AS ms, st + p - 1 + length(mark) AS stop, substr(s.seg, p, length(mark)) AS modality, substr(text, st + p + length(mark)) AS tail FROM s LEFT JOIN o ON o.rule_id = s.rule_id AND o.i = s.i AND rn = 1),
f2 AS (SELECT *, stop - 1 + list_min(list_filter(list_transform(['within', 'before', 'after', 'only if', 'provided that'], lambda x: CASE WHEN contains(lower(tail), x) THEN instr(lower(tail), x) END), lambda x: x IS NOT NULL)) AS c_at,
  CASE WHEN contains(lower(tail), 'unless ') THEN stop - 1 + instr(lower(tail), 'unless ') END AS e_at, {_PLACE.format("by")} AS b_at, {_PLACE.format("to")} AS t_at,
  greatest(st, CASE WHEN length(cond) <= ms THEN least(opening, ms) ELSE 0 END) AS a_at FROM f1),
f3 AS (SELECT *, substr(text, stop + 1, least(st + length(seg), c_at, e_at, b_at, t_at) - stop) AS raw, nullif(rtrim(substr(text, c_at + 1), {_MARKS}), '') AS constr, nullif(rtrim(substr(text, e_at + 1), {_MARKS}), '') AS exc FROM f2),
f AS (SELECT *, CASE WHEN lower(modality) = 'no person shall' THEN substr(modality, 1, 9) WHEN regexp_matches(tail, '^\\s*be\\s+\\w+') THEN nullif(regexp_extract(tail, '(?i)\\bby\\s+(the\\s+\\w+)', 1), '') ELSE nullif(trim(substr(text, a_at + 1, ms - a_at)), '') END AS actor,
  CASE WHEN lower(modality) = 'no person shall' THEN ms WHEN regexp_matches(tail, '^\\s*be\\s+\\w+') THEN b_at + length(regexp_extract(substr(text, b_at + 1), '(?i)^by\\s+')) ELSE a_at + length(regexp_extract(substr(text, a_at + 1, ms - a_at), '^\\s*')) END AS actor_at,
  nullif(rtrim(trim(raw), {_MARKS}), '') AS action, stop + length(regexp_extract(raw, '^\\s*')) AS action_at FROM f3)"""

SQL |= {
    "and_boundaries": f"{_SPLIT} SELECT rule_id, i::INT AS hit, own::INT AS at FROM a WHERE i > 1",
    "split_clauses": f"{_SPLIT} SELECT rule_id, i::INT AS clause, seg AS text, st::INT AS start, (st + length(seg))::INT AS stop FROM s",
    "seg_actor": f"{_ALL} SELECT rule_id, i::INT AS clause, actor AS text, CASE WHEN actor IS NOT NULL THEN actor_at END::INT AS start, (actor_at + length(actor))::INT AS end_at FROM f",
    "seg_action": f"{_ALL} SELECT rule_id, i::INT AS clause, action AS text, CASE WHEN action IS NOT NULL THEN action_at END::INT AS start, (action_at + length(action))::INT AS end_at FROM f",
    "rule_clauses": f"{_ALL} SELECT rule_id, 'C' || i AS clause_id, seg AS clause_text, modality, actor, action, cond AS condition, constr AS \"constraint\", exc AS \"exception\", CASE WHEN modality IS NULL THEN 0.1 WHEN action IS NULL THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence FROM f",
    "nest_clauses": f"{_SPLIT} SELECT rule_id, count(*)::INT AS n_clauses, string_agg('C' || i || '=' || seg, '|' ORDER BY i) AS clauses FROM s GROUP BY rule_id",
    "flatten_prediction": f"""{_ALL} SELECT rule_id, CASE lower(arg_min(modality, i) FILTER (WHERE modality IS NOT NULL)) WHEN 'shall' THEN 'obligation' WHEN 'must' THEN 'obligation' WHEN 'may' THEN 'permission' WHEN 'shall not' THEN 'prohibition' WHEN 'must not' THEN 'prohibition' WHEN 'no person shall' THEN 'prohibition' END AS modality,
max(CASE WHEN i = 1 THEN actor END) AS actor, arg_min(action, i) FILTER (WHERE action IS NOT NULL) AS action, max(cond) AS condition, max(CASE WHEN i = 1 THEN constr END) AS "constraint", max(CASE WHEN i = 1 THEN exc END) AS "exception" FROM f GROUP BY rule_id""",
    "rule_baseline": f"{_SPLIT} SELECT rule_id, CASE WHEN rule_id % 50 = 0 THEN 0 ELSE count(*) END::INT AS n_clauses, CASE WHEN rule_id % 50 = 0 THEN 'text is null' END AS error FROM s GROUP BY rule_id",
    "valid_predictions": f"""{R}, r AS (SELECT rule_id, {_RECORDS} AS r FROM rules) SELECT rule_id, CASE WHEN json_valid(r) THEN list_has_all(json_keys(r), ['sample_id', 'source_id', 'predicted', 'runtime', 'schema_valid']) AND json_type(r, '$.schema_valid') = 'BOOLEAN' AND json_extract_string(r, '$.schema_valid') = 'true'
AND json_type(r, '$.predicted') = 'OBJECT' AND list_has_all(json_keys(r, '$.predicted'), ['modality', 'actor', 'action', 'condition', 'constraint', 'exception']) ELSE false END AS valid FROM r""",
}
