"""Queries of lexicon extraction, corpus building, gates, routing, ledger and process models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.strings import once
from statuta.operators import corpus as D
from statuta.operators import evaluation as E
from statuta.operators import gates as B
from statuta.operators import ledger as H
from statuta.operators import lexicon as L
from statuta.operators import process as K
from statuta.operators import routing as G
from statuta.sources import jsonl, models
from statuta.plans.corpora import FIELDS, corpus, corpus_over, with_parts
from statuta.plans.lineage import cut, new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


R = with_parts("rules")


def _values(kinds: list[str]) -> str:
    rows = [f"('{k}', {i}, '{m}', {len(m)}, {j})" for i, k in enumerate(kinds) for j, m in enumerate(L.longest_first(L.LEXICON[k]))]
    return f"m(kind, prio, marker, len, ord) AS (VALUES {', '.join(rows)})"


_MOD = f"""{R}, {_values(L.CLASSES)}, h AS (SELECT rule_id, text, kind AS klass, m.marker, instr(lower(text), m.marker) - 1 AS start, instr(lower(text), m.marker) - 1 + len AS stop,
  row_number() OVER (PARTITION BY rule_id ORDER BY prio, ord) AS rn FROM rules JOIN m ON contains(lower(text), m.marker)), mod AS (SELECT * EXCLUDE rn FROM h WHERE rn = 1)"""
_CONF = "round(CASE WHEN klass IN ('prohibition', 'obligation') THEN greatest(least(1.0, length(marker) / 15.0::DOUBLE), 0.85) WHEN klass = 'definition' THEN greatest(least(1.0, length(marker) / 15.0::DOUBLE), 0.6) ELSE least(1.0, length(marker) / 15.0::DOUBLE) END, 4)"


@query(f"{_MOD} SELECT rule_id, klass, marker, start::INT AS start, stop::INT AS stop FROM mod")
def lex_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "rules").select("rule_id", L.modality(F.col("text")).alias("m")).where("m is not null").select("rule_id", "m.klass", "m.marker", "m.start", "m.stop")


@query(f"{_MOD} SELECT rules.rule_id, coalesce(klass, 'obligation') AS klass, coalesce(mod.marker, '') AS marker, coalesce(start, -1)::INT AS start, coalesce(stop, -1)::INT AS stop, CASE WHEN klass IS NULL THEN 0.1 ELSE {_CONF.replace('marker', 'mod.marker')} END::DOUBLE AS confidence FROM rules LEFT JOIN mod ON mod.rule_id = rules.rule_id")
def lex_modality_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "rules").select("rule_id", L.or_default(L.modality(F.col("text"))).alias("m")).select("rule_id", "m.*")


@query(f"{_MOD} SELECT klass, marker, {_CONF}::DOUBLE AS confidence, count(*) AS n FROM mod GROUP BY ALL")
def lex_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lex_modality(spark, sf_dir)
    return m.groupBy("klass", "marker", L.confidence(F.col("klass"), F.col("marker")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


_KINDS = ["condition", "constraint", "exception"]
_HITS = f"{_MOD}, {_values(_KINDS).replace('m(kind', 'mk(kind')}, hits AS (SELECT rule_id, kind, mk.marker, len, p - 1 AS start, p - 1 + len AS stop, text FROM rules, mk, range(1, 401) r(p) WHERE contains(lower(text), mk.marker) AND substr(lower(text), p, len) = mk.marker)"


@query(f"{_HITS} SELECT rule_id, kind, marker, start::INT AS start, stop::INT AS stop FROM hits")
def marker_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus(spark, sf_dir, "rules")
    each = F.concat(*[F.transform(L.hits(F.col("text"), L.LEXICON[k]), _with_kind(k)) for k in _KINDS])
    return r.select("rule_id", F.explode(each).alias("h")).select("rule_id", "h.kind", "h.marker", "h.start", "h.stop")


def _with_kind(kind: str):
    return lambda h: F.struct(F.lit(kind).alias("kind"), h["marker"].alias("marker"), h["start"].alias("start"), h["stop"].alias("stop"))


_AM = _values(["actor"]).replace("m(kind", "ma(kind")


@query(f"{R}, {_AM}, h AS (SELECT rule_id, ma.marker, instr(lower(text), ma.marker) - 1 AS start, row_number() OVER (PARTITION BY rule_id ORDER BY instr(lower(text), ma.marker), len DESC) AS rn FROM rules JOIN ma ON contains(lower(text), ma.marker)) SELECT rule_id, start::INT AS start, (start + length(marker))::INT AS stop FROM h WHERE rn = 1")
def lex_actor_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus(spark, sf_dir, "rules").select("rule_id", L.actor_hit(F.col("text"), L.LEXICON["actor"]).alias("a"))
    return r.where("a is not null").select("rule_id", "a.start", "a.stop")


def _spans(kind: str, where: str, stop: str, columns: str = "rule_id, span") -> str:
    end = lambda s: f"(CASE WHEN regexp_matches(substr(text, {s} + 1), '[.!?]') THEN {s} + length(regexp_extract(substr(text, {s} + 1), '^[^.!?]*')) WHEN length(regexp_extract(substr(text, {s} + 1), '^;?[^,;]*')) < length(text) - {s} THEN {s} + length(regexp_extract(substr(text, {s} + 1), '^;?[^,;]*')) ELSE length(text) END)"
    upto = stop.format(end=end('h.stop').replace('text', 'h.text'), here=end('h.start').replace('text', 'h.text'))
    return f"""{_HITS}, s AS (SELECT h.rule_id, h.start, h.len, h.stop AS b, {upto} AS e, trim(substr(h.text, h.stop + 1, greatest({upto} - h.stop, 0)), ' ,;') AS span
  FROM hits h JOIN mod USING (rule_id) WHERE h.kind = '{kind}' AND {where}),
f AS (SELECT rule_id, span, b, e, row_number() OVER (PARTITION BY rule_id ORDER BY start, len DESC) AS rn FROM s WHERE span <> '') SELECT {columns} FROM f WHERE rn = 1"""


_WHERE = {"condition": ("h.start < mod.start", "least({end}, mod.start)"), "constraint": ("h.start >= mod.start", "{here}"), "exception": ("true", "{end}")}


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract(corpus(spark, sf_dir, "rules").select("rule_id", "text"))


def _held(spark: SparkSession, sf_dir: str, field: str, name: str) -> DataFrame:
    """Rules that have a field."""
    return _extracted(spark, sf_dir).select("rule_id", once(F.col(field)).alias(name)).where(F.col(name).isNotNull())


@query(_spans("condition", *_WHERE["condition"]))
def lex_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "condition", "span")


@query(_spans("constraint", *_WHERE["constraint"]))
def lex_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "constraint", "span")


@query(_spans("exception", *_WHERE["exception"]))
def lex_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "exception", "span")


_DET = ", ".join(f"'{x}'" for x in L.DETERMINERS)
_AUX = ", ".join(f"'{x}'" for x in L.AUXILIARIES)
_ACTORS = f"""{_MOD}, {_AM}, ah AS (SELECT rule_id, instr(lower(text), ma.marker) - 1 AS s, instr(lower(text), ma.marker) - 1 + len AS e, row_number() OVER (PARTITION BY rule_id ORDER BY instr(lower(text), ma.marker), len DESC) AS rn FROM rules JOIN ma ON contains(lower(text), ma.marker)),
a0 AS (SELECT mod.rule_id, mod.text, mod.start AS m, ah.s, ah.e, ah.s - length(regexp_extract(substr(mod.text, 1, ah.s), '[^ ]*$')) AS l FROM mod LEFT JOIN ah ON ah.rule_id = mod.rule_id AND ah.rn = 1),
a1 AS (SELECT *, regexp_replace(substr(text, 1, l), '\\s+$', '') AS before FROM a0), a2 AS (SELECT *, lower(regexp_extract(before, '(\\S*)$', 1)) AS word FROM a1), a3 AS (SELECT *, instr(reverse(before), reverse(word)) AS back FROM a2),
a4 AS (SELECT *, CASE WHEN word IN ({_DET}) THEN CASE WHEN back > 0 THEN length(before) - (back - 1) - length(word) ELSE -1 END ELSE l END AS b, e + length(regexp_extract(substr(text, e + 1), '^[^ ,;.!?]*')) AS z FROM a3),
a5 AS (SELECT *, list_reverse(list_filter(string_split_regex(trim(substr(text, 1, m)), '\\s+'), lambda x: x <> '')[-3:]) AS w FROM a4),
a6 AS (SELECT *, coalesce(nullif(list_position(list_transform(w, lambda x: lower(x) IN ({_AUX}) AND NOT regexp_matches(x, '^\\p{{Lu}}')), true), 0), len(w) + 1) - 1 AS upto FROM a5),
a7 AS (SELECT *, array_to_string(list_reverse(w[1:upto]), ' ') AS tail FROM a6),
actors AS (SELECT rule_id, CASE WHEN s < m THEN b ELSE instr(substr(text, 1, m), tail) - 1 END AS b, CASE WHEN s < m THEN z ELSE instr(substr(text, 1, m), tail) - 1 + length(tail) END AS e, nullif(CASE WHEN s < m THEN CASE WHEN b < 0 THEN '' ELSE substr(text, b + 1, z - b) END ELSE CASE WHEN tail <> '' AND contains(substr(text, 1, m), tail) THEN tail END END, '') AS actor FROM a7)"""
_PARTS = ", ".join(f'{name} AS ({_spans(k, *_WHERE[k], "rule_id, span, b, e")})' for name, k in (("cond", "condition"), ("stra", "constraint"), ("exce", "exception")))


def _without(text: str, span: str) -> str:
    return f"CASE WHEN {span} IS NULL THEN {text} ELSE replace({text}, {span}, '') END"


_ACTIONS = f"""{_ACTORS}, {_PARTS}, w0 AS (SELECT mod.rule_id, mod.klass, mod.text, mod.start AS ms, mod.stop AS me, cond.b AS cb, cond.e AS ce, stra.b AS kb, stra.e AS ke, exce.b AS eb, exce.e AS ee, substr(mod.text, mod.stop + 1) AS rest, cond.span AS cs, stra.span AS ks, exce.span AS es FROM mod LEFT JOIN cond ON cond.rule_id = mod.rule_id LEFT JOIN stra ON stra.rule_id = mod.rule_id LEFT JOIN exce ON exce.rule_id = mod.rule_id),
w1 AS (SELECT *, {_without('rest', 'es')} AS r1 FROM w0), w2 AS (SELECT *, {_without('r1', 'ks')} AS r2 FROM w1), w3 AS (SELECT *, {_without('r2', 'cs')} AS r3 FROM w2),
whole AS (SELECT klass AS modality, actor, nullif(trim(regexp_replace(trim(r3, ' ,;.' || chr(9)), '{L.CONNECTORS}', '')), '') AS action, cs AS condition, ks AS "constraint", es AS "exception", w3.*, actors.b AS ab, actors.e AS ae FROM w3 JOIN actors ON actors.rule_id = w3.rule_id)"""


@query(f"{_ACTORS} SELECT rule_id, actor FROM actors WHERE actor IS NOT NULL")
def lex_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "actor", "actor")


@query(f"{_ACTIONS} SELECT rule_id, action FROM whole WHERE action IS NOT NULL")
def lex_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "action", "action")


@query(f"{_ACTIONS} SELECT rules.rule_id, {', '.join('whole.' + chr(34) + f + chr(34) for f in FIELDS)} FROM rules LEFT JOIN whole ON whole.rule_id = rules.rule_id")
def lex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job; checked against the golden outputs in the tests too."""
    return _extracted(spark, sf_dir).select("rule_id", *FIELDS)


_AT = "me + greatest(instr(substr(text, me + 1), action) - 1, 0)"


@query(f"""{_ACTIONS}, p AS (SELECT rule_id, unnest([{{'f': 'modality', 'b': ms, 'e': me}}, {{'f': CASE WHEN actor IS NOT NULL THEN 'actor' END, 'b': ab, 'e': ae}}, {{'f': CASE WHEN action IS NOT NULL THEN 'action' END, 'b': {_AT}, 'e': {_AT} + length(action)}}, {{'f': CASE WHEN cs IS NOT NULL THEN 'condition' END, 'b': cb, 'e': ce}},
{{'f': CASE WHEN ks IS NOT NULL THEN 'constraint' END, 'b': kb, 'e': ke}}, {{'f': CASE WHEN es IS NOT NULL THEN 'exception' END, 'b': eb, 'e': ee}}]) AS x FROM whole) SELECT rule_id, x.f AS field, x.b::INT AS start, x.e::INT AS stop FROM p WHERE x.f IS NOT NULL""")
def lex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each field of a sentence stands."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"spans.{f}").alias("s")) for f in FIELDS])
    return _extracted(spark, sf_dir).select("rule_id", F.explode(each).alias("x")).where("x.s is not null").select("rule_id", "x.field", "x.s.start", "x.s.stop")


# Corpus building.
_SENT = "s AS (SELECT doc_id, u.pos - 1 AS pos, trim(regexp_replace(u.x, '^\\s+|\\s+$', '', 'g')) AS sentence FROM documents, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\n+')) WITH ORDINALITY u(x, pos)), sentences AS (SELECT * FROM s WHERE sentence <> '')"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sentences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query(f"WITH {_SENT} SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars, max(pos)::INT AS last_pos FROM sentences GROUP BY doc_id")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"), F.max("pos").alias("last_pos"))


@query(f"WITH {_SENT}, d AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(sentence, '\\s+', ' ', 'g') ORDER BY doc_id, pos) AS rn FROM sentences) SELECT doc_id, pos::INT AS pos, md5(sentence) AS h FROM d WHERE rn = 1")
def dedup_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup(_sentences(spark, sf_dir), ["doc_id", "pos"]).select("doc_id", "pos", F.md5(F.col("sentence").cast("binary")).alias("h"))


@query(f"WITH {_SENT} SELECT doc_id, pos::INT AS pos, length(sentence)::INT AS n FROM sentences WHERE length(sentence) BETWEEN 60 AND 600")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).where(D.is_good_length(F.col("sentence"))).select("doc_id", "pos", F.length("sentence").alias("n"))


_NORM = "|".join(D.NORMATIVE)


@query(f"{R} SELECT rule_id FROM rules WHERE regexp_matches(lower(text), '\\b({_NORM})\\b')")
def normative_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "rules").where(D.is_normative(F.col("text"))).select("rule_id")


_CITED = "CASE rule_id % 3 WHEN 0 THEN concat('article ', rule_id % 12, ': ', text) WHEN 1 THEN concat('See Art. ', rule_id % 9, ' ', text) ELSE text END"
_GROUP = "'Article ' || coalesce(nullif(regexp_extract(t, 'Article\\s+(\\d+)', 1, 'i'), ''), nullif(regexp_extract(t, 'Art\\.\\s*(\\d+)', 1, 'i'), ''))"
_GROUPED = f"{R}, c AS (SELECT rule_id, {_CITED} AS t FROM rules), g AS (SELECT rule_id, t, {_GROUP} AS grp FROM c)"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "rules").select("rule_id", F.expr(_CITED).alias("t")).withColumn("grp", D.group_key(F.col("t")))


@query(f"{_GROUPED} SELECT rule_id, grp FROM g")
def detect_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("rule_id", "grp")


_RM = "CASE WHEN regexp_matches(l, '\\b(shall not|must not|may not|is prohibited)\\b|\\bprohibit') THEN 'prohibition' WHEN regexp_matches(l, '\\b(shall|must|is required|is obliged)\\b') THEN 'obligation' WHEN regexp_matches(l, '\\b(may|is permitted|is entitled|have the right|have a right)\\b') THEN 'permission' WHEN regexp_matches(l, '\\b(means|refers to|defined as|definition)\\b') THEN 'definition' ELSE 'obligation' END"


@query(f"{R}, x AS (SELECT rule_id, lower(text) AS l FROM rules) SELECT rule_id, {_RM} AS modality FROM x")
def regex_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "rules").select("rule_id", D.regex_modality(F.col("text")).alias("modality"))


@query(f"""{_GROUPED}, a AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rule_id) AS rn FROM g),
b AS (SELECT *, CASE WHEN rn <= 3 THEN 1 ELSE 2 END AS pass FROM a),
o AS (SELECT rule_id, grp, row_number() OVER (ORDER BY pass, CASE WHEN pass = 1 THEN grp END NULLS LAST, CASE WHEN pass = 1 THEN rn END, rule_id) AS place FROM b)
SELECT rule_id, grp, place::INT AS place FROM o WHERE place <= 200""")
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diverse_sample(_grouped(spark, sf_dir), "grp", ["rule_id"], 200).select("rule_id", "grp", "place")


@query(f"{R} SELECT rule_id, 'rule_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id FROM (SELECT rule_id, row_number() OVER (ORDER BY rule_id) AS n FROM rules)")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_ids(corpus(spark, sf_dir, "rules").select("rule_id"), ["rule_id"], "rule").select("rule_id", "id")


def _rx(p: str, strip: str) -> str:
    inner = f"regexp_extract(text, '{p}', 0, 'i')"
    return f"nullif(trim({f'''rtrim({inner}, '{strip}')''' if strip else inner}), '')"


@query(f"""{R}, x AS (SELECT *, lower(text) AS l FROM rules) SELECT rule_id, {_RM} AS modality,
coalesce({_rx('(?:the\\s+)?(?:controller|processor|data subject|supervisory authority|recipient|third party|natural person|legal person)', '')}, nullif(trim(regexp_extract(text, '^((?:The|A|Each|Any)\\s+\\w+(?:\\s+\\w+)?)\\s+(?:shall|must|may|should|is)', 1, 'i')), '')) AS actor,
nullif(trim(concat(regexp_extract(text, '\\b(?:shall|must|may|should)\\s+(not\\s+)?(?:be\\s+)?(\\w+(?:\\s+\\w+){{0,8}})', 1, 'i'), regexp_extract(text, '\\b(?:shall|must|may|should)\\s+(not\\s+)?(?:be\\s+)?(\\w+(?:\\s+\\w+){{0,8}})', 2, 'i'))), '') AS action,
{_rx('(?:Where|If|When|In case of|Provided that|On condition that)\\s+[^,.;]+(?:,|;|\\.)', ',;.')} AS condition,
coalesce({_rx('(?:within|before|after|at least|at most|no later than|not later than)\\s+[^,.;]+', '')}, {_rx('(?:in accordance with|subject to|without prejudice to)\\s+[^,.;]+', '')}) AS "constraint",
{_rx('(?:except|unless|with the exception of|apart from|other than|excluding)\\s+[^.;]+', ';.')} AS "exception" FROM x""")
def weak_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.weak_annotate(F.col("text"))
    return corpus(spark, sf_dir, "rules").select("rule_id", *[found[f].alias(f) for f in FIELDS])


@query(f"{_GROUPED} SELECT coalesce(grp, 'unknown') AS grp, count(*) AS n FROM g GROUP BY ALL")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).groupBy(F.coalesce("grp", F.lit("unknown")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{R}, t AS (SELECT unnest([segment, coalesce(modality, 'none'), CASE WHEN condition IS NULL THEN 'plain' ELSE 'conditional' END]) AS tag FROM rules) SELECT tag, count(*) AS n FROM t GROUP BY tag")
def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array("segment", F.coalesce("modality", F.lit("none")), F.when(F.col("condition").isNull(), "plain").otherwise("conditional"))
    return corpus(spark, sf_dir, "rules").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


# Gates.
CL = with_parts("clauses")


@query(f"""{CL} SELECT rule_id, concat_ws(',', CASE WHEN source_id = '' THEN 'source_id_empty' END, CASE WHEN span_start < 0 THEN 'span_start_negative' END, CASE WHEN span_end < span_start THEN 'span_end_before_start' END,
CASE WHEN span_end > length(source_text) THEN 'span_end_beyond_text' END, CASE WHEN confidence > 1 THEN 'confidence_out_of_range' END) AS reasons FROM clauses""")
def validate_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.validate_spans(corpus(spark, sf_dir, "clauses")).select("rule_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""{CL}, a AS (SELECT *, instr(source_text, span_text) AS p, span_start >= 0 AND substr(source_text, greatest(span_start, 0) + 1, greatest(span_end - span_start, 0)) = span_text AS kept FROM clauses),
b AS (SELECT *, CASE WHEN kept THEN 'kept' WHEN p = 0 THEN 'not_found' WHEN instr(substr(source_text, p + 1), span_text) > 0 THEN 'ambiguous' ELSE 'repaired' END AS status FROM a)
SELECT rule_id, status, (CASE WHEN status = 'repaired' THEN p - 1 ELSE span_start END)::INT AS start, (CASE WHEN status = 'repaired' THEN p - 1 + length(span_text) ELSE span_end END)::INT AS stop FROM b""")
def repair_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir, "clauses")
    return c.select("rule_id", B.repair_span(F.col("source_text"), F.col("span_text"), F.col("span_start"), F.col("span_end")).alias("r")).select("rule_id", "r.*")


AN = with_parts("answers")


@query(f"""{AN}, k AS (SELECT rule_id, CASE WHEN json_valid(answer) AND json_type(answer) = 'OBJECT' THEN json_keys(answer) END AS k FROM answers)
SELECT rule_id, array_to_string(list_sort(list_filter(k, lambda x: NOT list_contains(['modality', 'actor', 'action', 'condition', 'constraint', 'exception'], x))), ',') AS unknown, array_to_string(list_filter(['modality', 'actor', 'action'], lambda x: NOT list_contains(k, x)), ',') AS missing FROM k WHERE k IS NOT NULL""")
def key_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.key_gate(corpus(spark, sf_dir, "answers"), "answer", FIELDS, FIELDS[:3])
    return a.where("unknown is not null").select("rule_id", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"))


@query(f"""{AN}, k AS (SELECT rule_id, answer, CASE WHEN json_valid(answer) AND json_type(answer) = 'OBJECT' THEN json_keys(answer) END AS k FROM answers),
v AS (SELECT rule_id, k, CASE WHEN k IS NULL THEN NULL ELSE nullif(trim(coalesce(json_extract_string(answer, '$.modality'), json_extract_string(answer, '$.normative_type'))), '') END AS m, CASE WHEN k IS NULL THEN NULL ELSE nullif(trim(coalesce(json_extract_string(answer, '$.actor'), json_extract_string(answer, '$.subject'))), '') END AS a FROM k),
r AS (SELECT *, CASE WHEN k IS NULL THEN 'not_an_object' WHEN len(k) = 0 THEN 'no_fields' WHEN list_contains(k, 'severity') THEN 'unknown_key' WHEN m IS NOT NULL AND m NOT IN ('obligation', 'prohibition', 'permission', 'definition') THEN 'invalid_modality' END AS reason FROM v)
SELECT rule_id, m AS modality, a AS actor, reason, CASE WHEN reason IS NOT NULL THEN 'error' WHEN list_has_any(k, ['normative_type', 'subject', 'conditions']) THEN 'accepted' ELSE 'noop' END AS status FROM r""")
def align_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.align_flat(corpus(spark, sf_dir, "answers"), "answer")
    return a.select("rule_id", F.col("out_modality").alias("modality"), F.col("out_actor").alias("actor"), "reason", "status")


def _texts(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


_CONFLICT = " OR ".join(f"list_contains(k, '{a}') AND list_contains(k, '{t}')" for a, t in B.ALIASES.items())
_ODD = " OR ".join(f"list_contains(k, '{a}') AND json_type(json_extract(c, '$.{a}')) NOT IN ('OBJECT', 'NULL')" for a in B.ALIASES)


@query(f"""{with_parts('responses')}, t AS (SELECT rule_id, CASE WHEN json_valid(response) THEN CASE WHEN json_type(response) = 'OBJECT' THEN response END END AS j FROM responses),
u AS (SELECT rule_id, j, json_keys(j) AS keys, json_type(j, '$.clauses') AS kind, CASE WHEN json_type(j, '$.clauses') = 'ARRAY' THEN from_json(json_extract(j, '$.clauses'), '["JSON"]') END AS cl FROM t),
e AS (SELECT rule_id, x.i - 1 AS i, x.c AS c, json_type(x.c) AS kind FROM u, unnest(cl) WITH ORDINALITY x(c, i)),
g AS (SELECT rule_id, i, kind, CASE WHEN kind = 'OBJECT' THEN json_keys(c) END AS k, c FROM e),
h AS (SELECT rule_id, i, c, CASE WHEN k IS NULL THEN 'invalid_clause_item' WHEN list_has_any(k, {_texts(B.UNSUPPORTED)}) THEN 'unsupported_model_field' WHEN len(list_filter(k, lambda y: NOT list_contains({_texts([*B.CLAUSE, *B.ALIASES])}, y))) > 0 THEN 'unknown_clause_field'
  WHEN {_CONFLICT} THEN 'alias_target_conflict' WHEN {_ODD} THEN 'invalid_enum' END AS bad, len(list_intersect(k, {_texts(list(B.ALIASES))})) AS n FROM g),
b AS (SELECT rule_id, min(i) FILTER (bad = 'invalid_clause_item') AS item, min(i) FILTER (bad IS NOT NULL) AS first, arg_min(bad, i) FILTER (bad IS NOT NULL) AS bad, sum(n) AS n,
  max(coalesce(json_extract_string(c, '$.normative_type.text'), json_extract_string(c, '$.modality.text'))) FILTER (i = len0 - 1) AS last_modality FROM (SELECT *, count(*) OVER (PARTITION BY rule_id) AS len0 FROM h) GROUP BY rule_id),
r AS (SELECT u.rule_id, CASE WHEN keys IS NULL OR len(list_filter({_texts(B.RESPONSE)}, lambda y: NOT list_contains(keys, y))) > 0 THEN 'missing_required_top_level_key' WHEN len(list_filter(keys, lambda y: NOT list_contains({_texts(B.RESPONSE)}, y))) > 0 THEN 'unknown_top_level_field'
  WHEN kind <> 'ARRAY' OR item IS NOT NULL THEN 'invalid_clause_item' ELSE bad END AS reason, item, first, n, last_modality FROM u LEFT JOIN b ON b.rule_id = u.rule_id)
SELECT rule_id, reason, CASE WHEN reason = 'invalid_clause_item' THEN item WHEN reason IS NULL OR reason LIKE '%top_level%' THEN NULL ELSE first END::INT AS bad_clause, CASE WHEN reason IS NULL THEN n ELSE 0 END::INT AS mappings,
CASE WHEN reason IS NOT NULL THEN 'error' WHEN n > 0 THEN 'accepted' ELSE 'noop' END AS status, CASE WHEN reason IS NULL THEN last_modality END AS last_modality FROM r""")
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.align_responses(corpus(spark, sf_dir, "responses"), "response")
    clauses = F.from_json(F.get_json_object("normalized", "$.clauses"), "array<struct<modality: struct<text: string>>>")
    return a.select("rule_id", "reason", "bad_clause", "mappings", "status", F.element_at(clauses, -1)["modality"]["text"].alias("last_modality"))


@query(f"""{AN}, k AS (SELECT rule_id, CASE WHEN json_valid(answer) AND json_type(answer) = 'OBJECT' THEN answer END AS j FROM answers)
SELECT rule_id, nullif(trim(json_extract_string(j, '$.modality')), '') AS modality, nullif(trim(json_extract_string(j, '$.actor')), '') AS actor, nullif(trim(json_extract_string(j, '$.action')), '') AS action,
j IS NOT NULL AND len(list_filter(['modality', 'actor', 'action', 'condition', 'constraint', 'exception'], lambda x: NOT list_contains(json_keys(j), x))) = 0 AND (nullif(trim(json_extract_string(j, '$.modality')), '') IS NULL OR json_extract_string(j, '$.modality') IN ('obligation', 'prohibition', 'permission', 'definition')) AS schema_valid FROM k""")
def ingest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ingest_fields(corpus(spark, sf_dir, "answers"), "answer").select("rule_id", "modality", "actor", "action", "schema_valid")


@query(f"{AN} SELECT rule_id, answer AS body FROM answers")
def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.when(F.col("rule_id") % 2 == 0, F.concat(F.lit("```json\n"), "answer", F.lit("\n```"))).otherwise(F.concat(F.lit("  "), "answer"))
    return corpus(spark, sf_dir, "answers").select("rule_id", B.strip_fences(fenced).alias("body"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.duplicate_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS k, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return B.key_difference(o, li, "k")


@query("WITH s AS (SELECT doc_id, CASE quality WHEN 1 THEN 'reviewed_gold' WHEN 0 THEN 'draft' END AS status FROM labels), i AS (SELECT doc_id, count(*) AS n, count(*) FILTER (coalesce(status <> 'reviewed_gold', true)) AS bad FROM s GROUP BY doc_id), t AS (SELECT sum(n)::BIGINT AS total, sum(bad)::BIGINT AS unreviewed, sum(n - 1)::BIGINT AS duplicates FROM i) SELECT *, total BETWEEN 1 AND 1000000000 AND unreviewed = 0 AND duplicates = 0 AS passed FROM t")
def gold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "reviewed_gold").when(F.col("quality") == 0, "draft")
    return B.gold_gate(_table(spark, sf_dir, "labels"), "doc_id", status, "reviewed_gold", 10**9)


_REGISTERED = "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN sha256(concat(html, ' ')) ELSE sha256(html) END AS digest, octet_length(encode(html))::BIGINT + CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS bytes FROM pages WHERE page_id % 13 <> 0"


@query(f"WITH reg AS ({_REGISTERED}), now AS (SELECT page_id, sha256(html) AS digest, octet_length(encode(html))::BIGINT AS bytes FROM pages) SELECT now.page_id, now.digest, now.bytes, coalesce(now.digest = reg.digest AND now.bytes = reg.bytes, false) AS same FROM now LEFT JOIN reg ON reg.page_id = now.page_id")
def snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a register in which every seventh has another content, every eleventh another size, and every thirteenth is not listed."""
    pages = _table(spark, sf_dir, "pages")
    size = F.octet_length("html").cast("long")
    known = pages.where("page_id % 13 <> 0").select("page_id", F.when(F.col("page_id") % 7 == 0, F.sha2(F.concat("html", F.lit(" ")), 256)).otherwise(F.sha2("html", 256)).alias("digest"), (size + F.when(F.col("page_id") % 11 == 0, 1).otherwise(0)).alias("bytes"))
    return B.snapshot_check(pages.select("page_id", F.sha2("html", 256).alias("digest"), size.alias("bytes")), known, "page_id")


# Key/value records of pages: the address with a query or an authority that tells a secret, a header, a key, a plain value.
_KV = """SELECT page_id, url, concat(url, CASE page_id % 5 WHEN 0 THEN '?api_key=abc' WHEN 1 THEN '&q=1&Token=x' WHEN 2 THEN '?monkey=1' WHEN 3 THEN '#key=' ELSE '' END) AS base_url,
CASE page_id % 4 WHEN 0 THEN concat('Bearer ', page_id) WHEN 1 THEN 'task-1' WHEN 2 THEN 'sk-12' ELSE NULL END AS header, CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://me:pw@') ELSE url END AS endpoint, concat('v', page_id) AS sort_key FROM {pages}"""
_KEYS = ["url", "base_url", "header", "endpoint", "sort_key"]


def _kv_sql(k: str) -> str:
    if any(w in k for w in B.SECRET_KEYS):
        return f"'{B.REDACTED}' AS {k}"
    url = f" OR regexp_matches({k}, '://[^/]*@') OR regexp_matches(lower({k}), '[?&]({'|'.join(B.SECRET_PARAMETERS)})=')" if k in B.URL_KEYS else ""
    return f"CASE WHEN regexp_matches(lower({k}), '{'|'.join(B.SECRET_VALUES)}'){url} THEN '{B.REDACTED}' ELSE {k} END AS {k}"


@query(f"WITH kv AS ({_KV.replace('{pages}', 'pages')}) SELECT page_id, {', '.join(map(_kv_sql, _KEYS))} FROM kv")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_KV.replace("{pages}", f"parquet.`{sf_dir}/pages.parquet`"))
    record = F.map_from_arrays(F.array(*map(F.lit, _KEYS)), F.array(*map(F.col, _KEYS)))
    return rows.select("page_id", B.redact_record(record).alias("r")).select("page_id", *[F.col("r")[k].alias(k) for k in _KEYS])


@query(f"SELECT doc_id, CASE WHEN text IS NULL THEN 'None' WHEN length(text) <= 7 THEN '{B.REDACTED}' ELSE concat(substr(text, 1, 4), '...{B.REDACTED}') END AS shown FROM documents")
def redact_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", B.redact_secret(F.col("text")).alias("shown"))


# Routing.
_MISS = "list_filter([CASE WHEN coalesce({0}modality, '') = '' THEN 'modality' END, CASE WHEN coalesce({0}condition, '') = '' THEN 'condition' END, CASE WHEN coalesce({0}\"constraint\", '') = '' THEN 'constraint' END, CASE WHEN coalesce({0}\"exception\", '') = '' THEN 'exception' END], lambda x: x IS NOT NULL)"


@query(f"{R} SELECT rule_id, array_to_string({_MISS.format('')}, ',') AS missing FROM rules")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "rules").select("rule_id", F.array_join(G.missing_fields(), ",").alias("missing"))


@query(f"""{R}, m AS (SELECT rule_id, text, {_MISS.format('')} AS m FROM rules)
SELECT rule_id, 'Fill the missing fields from the sentence; answer with JSON alone.' AS system, concat('Sentence: ', text, '\nMissing: ', array_to_string(m, ', ')) AS "user", concat('{{', array_to_string(list_transform(m, lambda f: concat('"', f, '": null')), ', '), '}}') AS skeleton FROM m WHERE len(m) > 0""")
def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.request_table(corpus(spark, sf_dir, "rules"), "rule_id")


@query(f"{R} SELECT rule_id, row_number() OVER (ORDER BY rule_id)::INT AS no FROM rules QUALIFY no <= 50")
def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.request_budget(corpus(spark, sf_dir, "rules").select("rule_id"), ["rule_id"], 50)


@query(f"""{R} SELECT rule_id, coalesce(modality, CASE WHEN rule_id % 2 = 0 THEN 'obligation' END) AS modality, actor, action, coalesce(condition, CASE WHEN rule_id % 2 = 0 THEN 'asked' END) AS condition,
coalesce("constraint", CASE WHEN rule_id % 2 = 0 THEN 'soon' END) AS "constraint", "exception" FROM rules""")
def fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus(spark, sf_dir, "rules")
    ext = r.where("rule_id % 2 = 0").select("rule_id", F.lit("obligation").alias("modality"), F.lit("someone").alias("actor"), F.lit("act").alias("action"), F.lit("asked").alias("condition"), F.lit("soon").alias("constraint"), F.lit(None).cast("string").alias("exception"))
    return G.fill_merge(r, ext, "rule_id")


@query(f"{with_parts('predictions')} SELECT run, field, count(*) FILTER (coalesce(pred, '') <> '') AS filled, count(*) AS total FROM predictions GROUP BY ALL")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.field_coverage(corpus(spark, sf_dir, "predictions"))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of orders' rules by customer segment and hundreds, with confidences by modulus."""
    r = corpus(spark, sf_dir, "rules")
    conf = {f"{f}_confidence": F.when(F.col(f).isNotNull(), F.lit(0.25) * ((F.col("rule_id") + i) % 4 + 1)) for i, f in enumerate(FIELDS)}
    return r.withColumns(conf).withColumns({"source_id": F.floor(F.col("rule_id") / 3), "seg_idx": F.col("rule_id") % 3, "schema_valid": F.col("rule_id") % 50 != 0, "confidence": F.lit(0.3) * (F.col("rule_id") % 4), "action": F.when(F.col("rule_id") % 11 != 0, F.col("action"))})


_TRIG = f"""{R}, c AS (SELECT *, rule_id // 3 AS source_id, rule_id % 3 AS seg FROM rules), r AS (SELECT source_id, seg, rule_id % 50 <> 0 AS valid, CASE WHEN modality IS NULL THEN [] ELSE list_filter([CASE WHEN rule_id % 11 = 0 THEN 'MISSING_ACTION' END,
CASE WHEN (rule_id % 4 = 0) OR ((rule_id + 1) % 4 = 0) OR ((rule_id + 2) % 4 = 0 AND rule_id % 11 <> 0) OR ((rule_id + 3) % 4 = 0 AND condition IS NOT NULL) OR ((rule_id + 4) % 4 = 0 AND "constraint" IS NOT NULL) OR ((rule_id + 5) % 4 = 0 AND "exception" IS NOT NULL) THEN 'LOW_FIELD_CONFIDENCE' END,
CASE WHEN rule_id % 4 <= 1 THEN 'LOW_CLAUSE_CONFIDENCE' END], lambda x: x IS NOT NULL) END AS r FROM c),
p AS (SELECT source_id, bool_and(valid) AS valid, flatten(list(r ORDER BY seg)) AS r FROM r GROUP BY source_id),
t AS (SELECT source_id, NOT valid OR len(r) > 0 AS triggered, CASE WHEN NOT valid THEN 'SCHEMA_VALIDATION_FAILURE' WHEN len(r) = 0 THEN 'NO_FALLBACK_NEEDED' ELSE array_to_string(r, ',') END AS reasons FROM p)"""


@query(f"{_TRIG} SELECT * FROM t")
def fallback_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fallback_trigger(_clauses(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"{_TRIG}, s AS (SELECT DISTINCT o_orderkey // 2 AS source_id FROM orders) SELECT s.source_id, s.source_id % 10 = 0 OR coalesce(triggered, true) AS triggered, CASE WHEN s.source_id % 10 = 0 THEN 'FORCED' ELSE coalesce(reasons, 'EMPTY_CLAUSES') END AS reasons FROM s LEFT JOIN t ON t.source_id = s.source_id")
def optional_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("source_id")).distinct()
    found = G.optional_trigger(sources, G.fallback_trigger(_clauses(spark, sf_dir)), F.col("source_id") % 10 == 0)
    return found.withColumn("reasons", F.array_join("reasons", ","))


_HYB = f"""{R}, b AS (SELECT rule_id AS source_id, action AS result, rule_id % 2 = 0 AS triggered, CASE WHEN rule_id % 4 = 0 THEN concat('ext ', action) END AS e, CASE WHEN rule_id % 10 = 0 THEN 'timeout' END AS err, rule_id % 8 = 0 AS ok, rule_id % 6 <> 0 AS present FROM rules),
s AS (SELECT *, CASE WHEN NOT triggered THEN 'not_needed' WHEN present AND err IS NOT NULL THEN 'external_error' WHEN NOT present OR e IS NULL THEN 'no_external' WHEN NOT ok THEN 'external_invalid' ELSE 'used' END AS status FROM b)
SELECT source_id, status, CASE WHEN status = 'used' THEN e WHEN status = 'not_needed' {{}} THEN result END AS final FROM s"""


def _hybrid(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    r = corpus(spark, sf_dir, "rules").select(F.col("rule_id").alias("source_id"), F.col("action").alias("result"), (F.col("rule_id") % 2 == 0).alias("triggered"))
    ext = r.where("source_id % 6 <> 0").select("source_id", F.when(F.col("source_id") % 4 == 0, F.concat(F.lit("ext "), "result")).alias("ext_result"), F.when(F.col("source_id") % 10 == 0, "timeout").alias("ext_error"), (F.col("source_id") % 8 == 0).alias("ext_valid"))
    return G.hybrid(r, ext, strict).select("source_id", "status", "final")


@query(_HYB.format(""))
def hybrid_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, True)


@query(_HYB.format("OR true"))
def hybrid_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, False)


_REASONS = f"({SQL['validate_clauses']})"
_REPAIRED = f"({SQL['repair_spans']})"


@query(f"""{CL}, x AS (SELECT clauses.rule_id, v.reasons = '' AND s.status IN ('kept', 'repaired') AS ok, concat_ws(':', s.start, s.stop, span_text) AS told FROM clauses JOIN {_REASONS} v ON v.rule_id = clauses.rule_id JOIN {_REPAIRED} s ON s.rule_id = clauses.rule_id)
SELECT r.rule_id, CASE WHEN r.rule_id % 2 <> 0 THEN 'not_needed' WHEN x.rule_id IS NULL OR x.rule_id % 6 = 0 THEN 'no_external' WHEN NOT ok THEN 'external_invalid' ELSE 'used' END AS status,
CASE WHEN r.rule_id % 2 <> 0 THEN r.action WHEN x.rule_id % 6 <> 0 AND ok THEN told END AS final FROM rules r LEFT JOIN x ON x.rule_id = r.rule_id""")
def hybrid_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict choice, external clauses passing the gates and the repair of spans first."""
    rule = corpus(spark, sf_dir, "rules").select(F.col("rule_id").alias("source_id"), F.col("action").alias("result"), (F.col("rule_id") % 2 == 0).alias("triggered"))
    c = corpus(spark, sf_dir, "clauses").where("rule_id % 6 <> 0")
    found = B.validate_spans(c).select("rule_id", "reasons", "source_text", "span_text", "span_start", "span_end")
    return G.hybrid(rule, G.checked_external(found, "rule_id"), True).select(F.col("source_id").alias("rule_id"), "status", "final")


@query(f"""{R}, b AS (SELECT rule_id, action, rule_id % 7 <> 0 AS enabled, CASE rule_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'mock' ELSE 'client' END AS client, rule_id % 2 = 0 AS triggered, CASE WHEN rule_id % 6 <> 0 AND rule_id % 10 = 2 THEN 'timeout' END AS err, rule_id % 6 <> 0 AND rule_id % 4 = 0 AS ok FROM rules),
s AS (SELECT *, CASE WHEN NOT enabled THEN '{G.DISABLED}' WHEN client IS NULL THEN '{G.CONFIG_MISSING}' WHEN NOT triggered THEN '{G.NOT_TRIGGERED}' WHEN err IS NOT NULL THEN '{G.NETWORK_ERROR}' WHEN NOT ok THEN '{G.SCHEMA_INVALID}' WHEN client = 'mock' THEN '{G.MOCK_USED}' ELSE '{G.SCHEMA_VALID}' END AS status FROM b)
SELECT rule_id, status, status IN ('{G.SCHEMA_VALID}', '{G.MOCK_USED}') AS used, CASE WHEN status IN ('{G.SCHEMA_VALID}', '{G.MOCK_USED}') THEN concat('ext ', action) ELSE action END AS final FROM s""")
def hybrid_conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("rule_id")
    rule = corpus(spark, sf_dir, "rules").select(n.alias("source_id"), F.col("action").alias("result"), (n % 2 == 0).alias("triggered"), (n % 7 != 0).alias("enabled"), F.when(n % 5 == 1, "mock").when(n % 5 > 1, "client").alias("client"))
    ext = corpus(spark, sf_dir, "rules").where("rule_id % 6 <> 0").select(n.alias("source_id"), F.concat(F.lit("ext "), "action").alias("ext_result"), F.when(n % 10 == 2, "timeout").alias("ext_error"), (n % 4 == 0).alias("ext_valid"))
    return G.conservative(rule, ext).select(F.col("source_id").alias("rule_id"), "status", "used", "final")


@query(f"{with_parts('predictions')} SELECT run, coalesce(nullif(trim(pred), ''), 'none') AS value, count(*) AS n FROM predictions WHERE field = 'modality' GROUP BY ALL")
def modality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.value_distribution(corpus(spark, sf_dir, "predictions"), "modality")


# Ledger.
CA = with_parts("calls")


def _says(words: list[str]) -> str:
    return f"regexp_matches(lower(coalesce(error, '')), '{'|'.join(w.replace('.', '[.]') for w in words)}')"


_ST = f"CASE WHEN attempted = 0 THEN 'config_blocked' WHEN NOT schema_valid AND {_says(H.TRANSPORT)} THEN 'api_error' WHEN NOT schema_valid THEN 'schema_invalid' ELSE 'schema_valid' END"
_CAT = f"CASE {_ST} WHEN 'schema_valid' THEN 'none' WHEN 'config_blocked' THEN 'config_blocked' WHEN 'schema_invalid' THEN 'schema_invalid' ELSE CASE WHEN {_says(H.TIMEOUT)} THEN 'timeout' ELSE 'transport_error' END END"


@query(f"{CA} SELECT call_id, {_ST} AS status FROM calls")
def call_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return corpus(spark, sf_dir, "calls").select("call_id", H.status(c("attempted"), c("schema_valid"), c("error")).alias("status"))


@query(f"{CA} SELECT call_id, {_CAT} AS category FROM calls")
def call_error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    found = corpus(spark, sf_dir, "calls").withColumn("status", H.status(c("attempted"), c("schema_valid"), c("error")))
    return found.select("call_id", H.error_category(c("status"), c("error")).alias("category"))


@query(f"{CA} SELECT {_CAT} AS category, count(*) AS n FROM calls GROUP BY ALL")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_error_category(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"{CA} SELECT call_id, CASE WHEN error IS NULL THEN 'ok' WHEN {_says(H.UNREADABLE)} OR {_says([H.SCHEMA])} AND {_says(H.SCHEMA_FAULT)} THEN 'invalid_schema' ELSE 'network' END AS status FROM calls")
def message_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "calls").select("call_id", H.message_status(F.col("error")).alias("status"))


@query(f"""{CA}, s AS (SELECT *, {_ST} AS st, {_CAT} AS cat FROM calls) SELECT stage, count(*) AS calls, sum(attempted)::BIGINT AS attempted, {', '.join(f"count(*) FILTER (st = '{x}') AS {x}" for x in ('config_blocked', 'api_error', 'schema_invalid', 'schema_valid'))},
sum(coalesce(duration_ms, 0))::BIGINT AS total_ms, round(sum(coalesce(duration_ms, 0))::DOUBLE / count(*), 4) AS mean_ms, count(*) FILTER (cat = 'timeout') AS timeouts, count(*) FILTER (cat = 'transport_error') AS transport_errors, arg_min(timeout_seconds, call_id) AS configured_timeout FROM s GROUP BY stage""")
def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.summary(corpus(spark, sf_dir, "calls"), "stage")


# Process models.
FL = with_parts("flows")
# Paths that visit no node twice, with the places of their edges: breadth-first order is by length, then by these places.
_ORDER = f"""{FL}, reach AS (WITH RECURSIVE r(process_id, node, depth, seen, places) AS (SELECT DISTINCT process_id, 's', 0, ['s'], []::INT[] FROM tasks
  UNION ALL SELECT f.process_id, f.target, r.depth + 1, list_append(r.seen, f.target), list_append(r.places, substr(f.target, 2)::INT) FROM r JOIN flows f ON f.process_id = r.process_id AND f.source = r.node WHERE NOT list_contains(r.seen, f.target))
  SELECT process_id, node, depth, places FROM (SELECT *, row_number() OVER (PARTITION BY process_id, node ORDER BY depth, places) AS rn FROM r) WHERE rn = 1),
ordered AS (SELECT t.process_id, t.node_id, t.name, row_number() OVER (PARTITION BY t.process_id ORDER BY depth, places) AS place FROM tasks t JOIN reach ON reach.process_id = t.process_id AND reach.node = t.node_id)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, written once for all that reads them."""
    return cut(corpus(spark, sf_dir, "tasks"))


def _ordered(spark: SparkSession, t: DataFrame) -> DataFrame:
    starts = t.where("seq = 1").select("process_id", F.lit("s").alias("node_id"))
    flows = corpus_over(spark, "flows", tasks=t).withColumn("pos", F.substring("target", 2, 9).cast("int"))
    return K.task_order(starts, flows, t.select("process_id", "node_id", "name"))


@query(f"{_ORDER} SELECT process_id, node_id, place::INT AS place FROM ordered")
def task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, _tasks(spark, sf_dir)).select("process_id", "node_id", "place")


@query(f"{with_parts('tasks')} SELECT process_id, count(*) AS n, string_agg(lower(name), '|' ORDER BY seq) AS names FROM tasks GROUP BY process_id")
def process_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir, "tasks").groupBy("process_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("seq", F.lower("name").alias("name")))).alias("x"))
    return t.select("process_id", "n", F.array_join(F.transform("x", lambda y: y["name"]), "|").alias("names"))


_TOK = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> ''))"


def _pair(text: str, named: str) -> str:
    a, b = _TOK.format(f"r.{text}"), _TOK.format("n.name")
    return f"""b AS (SELECT r.rule_id, max(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))) AS best FROM rules r JOIN {named} n ON n.process_id = r.rule_id GROUP BY r.rule_id)"""


_RT = with_parts("rules", "flows")
_MA = f"{_RT}, {_pair('action', 'tasks')} SELECT r.rule_id, coalesce(best, 0.0)::DOUBLE AS best, 'missing_action' AS kind FROM rules r LEFT JOIN b USING (rule_id) WHERE coalesce(best, 0) < 0.3"
_IA = f"{_RT}, lanes AS (SELECT DISTINCT process_id, lane AS name FROM tasks), {_pair('actor', 'lanes')} SELECT r.rule_id, best::DOUBLE AS best, 'incorrect_actor' AS kind FROM rules r JOIN b USING (rule_id) WHERE best < 0.3"


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "rules").withColumn("process_id", F.col("rule_id"))


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "tasks").select("process_id", F.col("lane").alias("name"))


@query(_MA)
def missing_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.missing_action(_rules(spark, sf_dir), corpus(spark, sf_dir, "tasks").select("process_id", "name")).select("rule_id", "best", "kind")


@query(_IA)
def incorrect_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.incorrect_actor(_rules(spark, sf_dir), _lanes(spark, sf_dir)).select("rule_id", "best", "kind")


_SAID = "CASE rule_id % 3 WHEN 0 THEN 'The operator shall record before archive of files.' WHEN 1 THEN 'The operator shall archive before check.' ELSE text END"
_DONE = "CASE WHEN rule_id % 8 = 0 THEN 'notify nobody at all' WHEN rule_id % 8 = 1 THEN NULL ELSE action END"
_OO = f"""{with_parts('rules', 'flows')}{_ORDER[len(FL):]}, w AS (SELECT rule_id, {_TOK.format(f"coalesce({_DONE}, '')")} AS act, list_filter(string_split_regex(lower({_SAID}), '\\s+'), lambda x: x <> '') AS words FROM rules),
b AS (SELECT *, list_position(words[2:len(words) - 1], 'before') AS spot FROM w WHERE len(words) > 2),
p AS (SELECT rule_id, act, words[spot] AS one, words[spot + 2] AS two FROM b WHERE spot > 0),
x AS (SELECT rule_id, one, two, act, place, {_TOK.format('name')} AS t FROM p JOIN ordered ON ordered.process_id = rule_id),
f AS (SELECT rule_id, min(place) FILTER (list_contains(t, one)) AS a, min(place) FILTER (list_contains(t, two)) AS b, count(*) AS n, max(len(list_intersect(act, t))::DOUBLE / len(list_distinct(list_concat(act, t)))) AS alike FROM x GROUP BY rule_id)
SELECT rule_id, 'out_of_order' AS kind FROM f WHERE n >= 2 AND a >= b AND alike > 0.3"""


def _out_of_order(spark: SparkSession, r: DataFrame, t: DataFrame) -> DataFrame:
    said = r.withColumns({"text": F.expr(_SAID), "action": F.expr(_DONE)})
    return K.out_of_order(said, _ordered(spark, t))


@query(_OO)
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out_of_order(spark, _rules(spark, sf_dir), _tasks(spark, sf_dir)).select("rule_id", "kind")


def _violations(spark: SparkSession, r: DataFrame, t: DataFrame) -> DataFrame:
    keep = ["rule_id", "process_id", "kind"]
    lanes = t.select("process_id", F.col("lane").alias("name"))
    return K.missing_action(r, t.select("process_id", "name")).select(*keep).unionByName(K.incorrect_actor(r, lanes).select(*keep)).unionByName(_out_of_order(spark, r, t).select(*keep))


def _rules_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What violations read of the rules, written once for all kinds."""
    return cut(_rules(spark, sf_dir).select("rule_id", "process_id", "actor", "action", "text"))


@query(f"SELECT rule_id, kind FROM ({_MA}) UNION ALL SELECT rule_id, kind FROM ({_IA}) UNION ALL SELECT rule_id, kind FROM ({_OO})")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, _rules_once(spark, sf_dir), _tasks(spark, sf_dir)).select("rule_id", "kind")


@query(f"{R}, v AS (SELECT rule_id, kind FROM ({_MA}) UNION ALL SELECT rule_id, kind FROM ({_IA}) UNION ALL SELECT rule_id, kind FROM ({_OO})), g AS (SELECT rule_id, count(*) AS n, string_agg(kind, ',' ORDER BY kind) AS kinds FROM v GROUP BY rule_id) SELECT rules.rule_id, n IS NOT NULL AS has_violations, coalesce(n, 0) AS n, coalesce(kinds, '') AS kinds FROM rules LEFT JOIN g ON g.rule_id = rules.rule_id")
def violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rules_once(spark, sf_dir)
    return K.violation_report(r, _violations(spark, r, _tasks(spark, sf_dir))).select("rule_id", "has_violations", "n", "kinds")


def _model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model text for each order, rendered from its tasks and flows."""
    t = corpus(spark, sf_dir, "tasks")
    tag = lambda name, close, *pairs: F.concat(F.lit(f"<bpmn:{name}"), *[x for k, v in pairs for x in (F.lit(f' {k}="'), v, F.lit('"'))], F.lit(close))
    tasks = t.groupBy("process_id").agg(F.array_join(F.sort_array(F.collect_list(tag("task", "/>", ("id", F.col("node_id")), ("name", F.col("name"))))), "").alias("tasks"))
    lanes = t.groupBy("process_id", "lane").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<bpmn:flowNodeRef>"), "node_id", F.lit("</bpmn:flowNodeRef>")))), "").alias("refs"))
    lanes = lanes.groupBy("process_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(tag("lane", ">", ("id", F.col("lane")), ("name", F.col("lane"))), "refs", F.lit("</bpmn:lane>")))), "").alias("lanes"))
    flows = corpus(spark, sf_dir, "flows").groupBy("process_id").agg(F.array_join(F.sort_array(F.collect_list(tag("sequenceFlow", "/>", ("id", F.concat("source", F.lit("-"), "target")), ("sourceRef", F.col("source")), ("targetRef", F.col("target"))))), "").alias("flows"))
    whole = tasks.join(lanes, "process_id").join(flows, "process_id")
    xml = F.concat(F.lit('<bpmn:definitions xmlns:bpmn="urn:bpmn"><bpmn:process id="'), F.col("process_id"), F.lit('"><bpmn:laneSet>'), "lanes", F.lit('</bpmn:laneSet><bpmn:startEvent id="s" name="begin"/>'), "tasks", "flows", F.lit("</bpmn:process></bpmn:definitions>"))
    return whole.select(xml.alias("xml"), F.col("process_id").cast("string").alias("file"))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.parse_models(_model_texts(spark, sf_dir).select("xml"))


@query(f"{with_parts('tasks')} SELECT process_id::VARCHAR AS process_id, node_id, name, 'task' AS kind FROM tasks")
def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.activities(_models(spark, sf_dir))


@query(f"{with_parts('tasks')} SELECT DISTINCT process_id::VARCHAR AS process_id, 's' AS node_id, 'begin' AS name, 'startEvent' AS kind FROM tasks")
def events_gateways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.events_gateways(_models(spark, sf_dir))


@query(f"{with_parts('tasks')} SELECT process_id::VARCHAR AS process_id, lane AS name, node_id FROM tasks")
def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.lanes(_models(spark, sf_dir)).select("process_id", "name", "node_id")


@query(f"{FL} SELECT process_id::VARCHAR AS process_id, source, target FROM flows")
def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.flows(_models(spark, sf_dir)).select("process_id", "source", "target")


@query(f"{with_parts('flows')}, t AS (SELECT process_id, count(*) AS n_tasks, count(DISTINCT lane) AS n_lanes FROM tasks GROUP BY process_id), f AS (SELECT process_id, count(*) AS n_flows FROM flows GROUP BY process_id) SELECT t.process_id::VARCHAR AS process_id, n_tasks::INT AS n_tasks, 1::INT AS n_events, n_lanes::INT AS n_lanes, n_flows::INT AS n_flows FROM t JOIN f ON f.process_id = t.process_id")
def bpmn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan of a model text finds."""
    m = _models(spark, sf_dir)
    size = lambda tags: sum((F.coalesce(F.size(F.col(f"p.{t}")), F.lit(0)) for t in tags), F.lit(0))
    return m.select(F.col("p._id").alias("process_id"), size(K.TASKS).alias("n_tasks"), size(K.EVENTS).alias("n_events"), F.size("p.laneSet.lane").alias("n_lanes"), F.size("p.sequenceFlow").alias("n_flows"))


def _model_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The model texts as files, some cut off, without an id, of another kind or empty; every eleventh holds a second process."""
    n, xml = F.col("file").cast("long") % 40, F.col("xml")
    second = F.replace(xml, F.lit("</bpmn:definitions>"), F.concat(F.lit('<process id="x'), F.col("file"), F.lit('"><task id="t1" name="one"/></process></bpmn:definitions>')))
    bent = F.when(n == 3, F.substring(xml, F.lit(1), F.length(xml) - 25)).when(n == 7, F.regexp_replace(xml, 'process id="[0-9]+"', "process")).when(n == 13, F.lit("<other/>")).when(n == 17, F.lit(" ")).when(n == 23, F.lit("no xml at all")).when(n == 29, F.lit(None).cast("string")).when(n % 11 == 0, second).otherwise(xml)
    return models.split_models(_model_texts(spark, sf_dir).select(bent.alias("xml"), "file"))


@query(f"""{with_parts('flows')}, t AS (SELECT process_id, count(*) AS n_tasks FROM tasks GROUP BY process_id), f AS (SELECT process_id, count(*) AS n_flows FROM flows GROUP BY process_id), g AS (SELECT * FROM t JOIN f USING (process_id) WHERE process_id % 40 NOT IN (3, 7, 13, 17, 23, 29))
SELECT process_id::VARCHAR AS file, process_id::VARCHAR AS process_id, n_tasks::INT AS n_tasks, n_flows::INT AS n_flows FROM g UNION ALL SELECT process_id::VARCHAR, 'x' || process_id, 1::INT, 0::INT FROM g WHERE process_id % 40 % 11 = 0""")
def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes of the model files that can be read."""
    good, _ = _model_files(spark, sf_dir)
    return good.select("file", F.col("p._id").alias("process_id"), F.size("p.task").alias("n_tasks"), F.coalesce(F.size("p.sequenceFlow"), F.lit(0)).alias("n_flows"))


@query(f"{with_parts('tasks')} SELECT process_id::VARCHAR AS file, CASE process_id % 40 WHEN 3 THEN 'not_well_formed' WHEN 7 THEN 'process_without_id' WHEN 13 THEN 'no_process' WHEN 23 THEN 'not_well_formed' ELSE 'empty' END AS reason FROM (SELECT DISTINCT process_id FROM tasks) WHERE process_id % 40 IN (3, 7, 13, 17, 23, 29)")
def model_files_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model files set apart, and why."""
    return _model_files(spark, sf_dir)[1]


# Sources, and alignment of clauses.
_LINES = "SELECT event_id, CASE event_id % 10 WHEN 0 THEN '  ' WHEN 1 THEN concat('# ', props) WHEN 2 THEN substr(props, 1, length(props) - 1) ELSE props END AS line FROM {events}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LINES.replace("{events}", f"parquet.`{sf_dir}/events.parquet`"))


@query("SELECT event_type, sum(CASE WHEN event_id % 10 > 2 THEN (json_extract_string(props, '$.k'))::INT END)::BIGINT AS total, count(*) FILTER (event_id % 10 > 2) AS good FROM events GROUP BY event_type")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _table(spark, sf_dir, "events").select("event_id", "event_type")
    good, _ = jsonl.parse(_lines(spark, sf_dir).select(F.concat(F.regexp_replace("line", r"\}$", ""), F.when(F.endswith("line", F.lit("}")), F.concat(F.lit(', "event_id": '), "event_id", F.lit("}"))).otherwise(F.lit(""))).alias("line")), "k int, event_id long")
    return good.join(kinds, "event_id").groupBy("event_type").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("good"))


@query("SELECT event_id, substr(props, 1, length(props) - 1) AS line FROM events WHERE event_id % 10 = 2")
def load_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantine of a load: lines that are no JSON object."""
    return jsonl.parse(_lines(spark, sf_dir), "k int")[1].select("event_id", "line")


_CLAUSE_ROW = "rule_id long, source_id string, source_text string, span_text string, span_start int, span_end int, confidence double"


@query(f"{CL} SELECT c.rule_id, CASE WHEN c.rule_id % 10 = 3 THEN 'not_json' ELSE reasons END AS reasons FROM clauses c JOIN {_REASONS} v ON v.rule_id = c.rule_id WHERE c.rule_id % 10 = 3 OR reasons <> ''")
def load_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of clauses from JSON Lines rejects: lines that are no JSON object, and rows that fail the gates, with reasons."""
    line = F.to_json(F.struct(*[x.split()[0] for x in _CLAUSE_ROW.split(", ")]))
    lines = corpus(spark, sf_dir, "clauses").select("rule_id", F.when(F.col("rule_id") % 10 == 3, F.concat(F.lit("{"), line)).otherwise(line).alias("line"))
    good, bad = jsonl.parse(lines, _CLAUSE_ROW)
    failed = B.validate_spans(good).where(F.size("reasons") > 0).select("rule_id", F.array_join("reasons", ",").alias("reasons"))
    return bad.select("rule_id", F.lit("not_json").alias("reasons")).unionByName(failed)


@query("SELECT conv_id, turn, role, md5(text) AS h, length(text)::INT AS n FROM conversations")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as JSON Lines and read back."""
    rows, path = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), new_path(spark)
    jsonl.write(rows, path)
    good, _ = jsonl.parse(jsonl.read_lines(spark, path), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    return good.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").alias("n"))


@query("SELECT conv_id, CASE WHEN role = 'user' THEN 'asked' ELSE 'modality' END AS category, CASE WHEN role <> 'user' THEN role END AS klass, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon object for each conversation, plain markers in one category and classes in another, read back as rows."""
    t = _table(spark, sf_dir, "conversations").where("text is not null")
    by_role = t.groupBy("conv_id", "role").agg(F.collect_list("text").alias("texts")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "texts"))).alias("m"))
    plain = F.to_json(F.coalesce(F.element_at("m", "user"), F.array().cast("array<string>")))
    classes = F.to_json(F.map_filter("m", lambda k, v: k != "user"))
    value = F.concat(F.lit('{"version": 1, "categories": {"asked": {"markers": '), plain, F.lit('}, "modality": {"classifications": '), classes, F.lit("}}}"))
    return jsonl.lexicon_entries(by_role.select("conv_id", value.alias("value"))).groupBy("conv_id", "category", "klass").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("marker")).alias("chars"))


@query("SELECT to_json({'name': 'documents', 'rows': count(*), 'columns': ['doc_id', 'text', 'lang', 'source', 'n_chars']})::VARCHAR AS manifest FROM documents")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.manifest(_table(spark, sf_dir, "documents"), "documents")


@query("SELECT lang, count(*) AS texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = corpus(spark, sf_dir, "rules").select(F.floor(F.col("rule_id") / 3).alias("source_id"), (F.col("rule_id") % 3).alias("seg_idx"), F.col("action").alias("text"), "rule_id")
    return r.where("rule_id % 11 <> 0").drop("rule_id"), r.where("rule_id % 7 <> 0").drop("rule_id")


_SIDES = f"{R}, r AS (SELECT rule_id // 3 AS source_id, rule_id % 3 AS seg_idx, action, rule_id FROM rules), g AS (SELECT * FROM r WHERE rule_id % 11 <> 0), p AS (SELECT * FROM r WHERE rule_id % 7 <> 0 AND source_id IN (SELECT source_id FROM g)), a AS (SELECT coalesce(g.source_id, p.source_id) AS source_id, coalesce(g.seg_idx, p.seg_idx) AS seg_idx, g.action AS gold_text, p.action AS pred_text, g.action IS NOT NULL AND p.action IS NOT NULL AS matched FROM g FULL JOIN p ON g.source_id = p.source_id AND g.seg_idx = p.seg_idx)"


@query(f"{_SIDES} SELECT * FROM a")
def align_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.align_clauses(*_sides(spark, sf_dir))


@query(f"""{_SIDES}, n AS (SELECT g.source_id, count(*) AS n_g, (SELECT count(*) FROM p WHERE p.source_id = g.source_id) AS n_p FROM g GROUP BY g.source_id), c AS (SELECT sum(n_g)::BIGINT AS n_gold, sum(n_p)::BIGINT AS n_pred, sum(least(n_g, n_p))::BIGINT AS n_matched FROM n),
q AS (SELECT *, n_matched::DOUBLE / n_pred AS p, n_matched::DOUBLE / n_gold AS r FROM c) SELECT n_gold, n_pred, n_matched, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM q""")
def clause_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clause_report(*_sides(spark, sf_dir))


_CF = "CASE field WHEN 'actor' THEN actor WHEN 'action' THEN action ELSE condition END"


@query(f"""{R}, l AS (SELECT rule_id, rule_id // 3 AS source_id, rule_id % 3 AS seg_idx, field, {_CF} AS text FROM rules, (VALUES ('actor'), ('action'), ('condition')) v(field)), g AS (SELECT * FROM l WHERE rule_id % 11 <> 0),
p AS (SELECT source_id, seg_idx, field, CASE WHEN rule_id % 5 = 0 THEN 'other' ELSE text END AS text FROM l WHERE rule_id % 7 <> 0 AND source_id IN (SELECT source_id FROM g)), a AS (SELECT field, g.text AS gt, p.text AS pt FROM g FULL JOIN p USING (source_id, seg_idx, field)),
k AS (SELECT field, sum((gt = pt)::INT)::BIGINT AS tp, count(pt) - sum(coalesce(gt = pt, false)::INT)::BIGINT AS fp, count(gt) - sum(coalesce(gt = pt, false)::INT)::BIGINT AS fn FROM a GROUP BY field),
m AS (SELECT * FROM k UNION ALL SELECT NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM k), q AS (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r FROM m)
SELECT field, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM q""")
def clause_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["actor", "action", "condition"]
    r = corpus(spark, sf_dir, "rules").select("rule_id", F.floor(F.col("rule_id") / 3).alias("source_id"), (F.col("rule_id") % 3).alias("seg_idx"), *names)
    long = r.unpivot(["rule_id", "source_id", "seg_idx"], names, "field", "text")
    pred = long.where("rule_id % 7 <> 0").withColumn("text", F.when(F.col("rule_id") % 5 == 0, "other").otherwise(F.col("text")))
    return E.clause_fields(long.where("rule_id % 11 <> 0").drop("rule_id"), pred.drop("rule_id"))
