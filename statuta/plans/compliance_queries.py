"""Queries of the similarity join with processes, observed order, lexicon tables, declared constraints and contracts, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import constraints as C
from statuta.operators import contracts as N
from statuta.operators import corpus as D
from statuta.operators import lexicon as L
from statuta.operators import lexicon_table as LT
from statuta.operators import matching as M
from statuta.operators import traces as T
from statuta.plans import rule_queries
from statuta.plans.corpora import FIELDS, corpus, with_parts
from statuta.plans.lineage import new_path
from statuta.sources import committed

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


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rules meet all processes: the SQL compares every pair of distinct texts.
_TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> ''))"


def _match_sql(corpora: tuple[str, ...], asked: str, named: str) -> str:
    """Brute force over (rule_id, text) and (process_id, name)."""
    return f"""{with_parts(*corpora)}, asked AS ({asked}), named AS ({named}),
a AS (SELECT text, {_TOKENS.format('text')} AS x FROM (SELECT DISTINCT lower(text) AS text FROM asked)), b AS (SELECT name, process_id, {_TOKENS.format('name')} AS y FROM (SELECT lower(name) AS name, min(process_id) AS process_id FROM named GROUP BY ALL)),
s AS (SELECT text, name, process_id, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS best FROM a, b WHERE len(x) > 0 AND len(y) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY best DESC, name) AS rn, count(*) OVER (PARTITION BY text) AS alike FROM s WHERE best >= 0.3)
SELECT rule_id, coalesce(best, 0.0)::DOUBLE AS best, f.name AS best_name, f.process_id, coalesce(alike, 0)::BIGINT AS alike FROM asked LEFT JOIN f ON f.text = lower(asked.text) AND rn = 1 WHERE len({_TOKENS.format('asked.text')}) > 0"""


@query(_match_sql(("duties", "work"), "SELECT rule_id, action AS text FROM duties", "SELECT process_id, name FROM work"))
def rule_process_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task of all processes that is most like each rule's action."""
    return M.best_processes(corpus(spark, sf_dir, "duties"), corpus(spark, sf_dir, "work"), "action")


@query(_match_sql(("duties", "work"), "SELECT rule_id, actor AS text FROM duties", "SELECT process_id, lane AS name FROM work"))
def actor_lane_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane of all processes that is most like each rule's actor."""
    return M.best_processes(corpus(spark, sf_dir, "duties"), corpus(spark, sf_dir, "work").select("process_id", F.col("lane").alias("name")), "actor")


# Observed order: sessions end where a user does nothing for half a day.
_GAP = 43_200
_LOG = f"""WITH e AS (SELECT user_id AS "case", ts AS time, event_id AS event, coalesce(event_type, '') AS activity FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT *, lag(time) OVER w AS was, lag(activity) OVER w AS prior FROM e WINDOW w AS (PARTITION BY "case" ORDER BY time, event)),
o AS (SELECT *, was IS NULL OR epoch_us(time) - epoch_us(was) > {_GAP} * 1000000::BIGINT AS opens FROM l),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY "case" ORDER BY time, event ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM o),
log AS (SELECT "case", session, row_number() OVER (PARTITION BY "case", session ORDER BY time, event) AS place, activity, event, CASE WHEN opens THEN '{T.START}' ELSE prior END AS before FROM n)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sessions(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", _GAP)


@query(f'{_LOG} SELECT event AS event_id, "case" AS user_id, session, place, before FROM log')
def trace_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select(F.col("event").alias("event_id"), F.col("case").alias("user_id"), "session", "place", "before")


@query(f"{_LOG} SELECT before AS one, activity AS two, count(*) AS n FROM log GROUP BY ALL")
def trace_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one type of event comes directly after another within a session."""
    return T.follows(_log(spark, sf_dir))


@query(f"""{_LOG}, k AS (SELECT DISTINCT activity FROM log), r AS (SELECT concat(a.activity, '>', b.activity) AS rule_id, a.activity AS one, b.activity AS two FROM k a, k b WHERE a.activity <> b.activity),
f AS (SELECT "case", session, activity, min(place) AS place FROM log GROUP BY ALL)
SELECT rule_id, x."case" AS user_id, x.session, x.place AS first, y.place AS second FROM r JOIN f x ON x.activity = one JOIN f y ON y.activity = two AND y."case" = x."case" AND y.session = x.session WHERE x.place >= y.place""")
def trace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that break a rule of order, for every rule that the types of events allow."""
    kinds = _table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select(F.coalesce("event_type", F.lit("")).alias("one")).distinct()
    both = kinds.join(kinds.select(F.col("one").alias("two")), F.col("one") != F.col("two"))
    rules = both.select(F.concat("one", F.lit(">"), "two").alias("rule_id"), F.concat(F.lit("Each user does "), "one", F.lit(" before "), "two", F.lit(" in a session.")).alias("text"))
    return T.observed_order(rules, _log(spark, sf_dir)).select("rule_id", F.col("case").alias("user_id"), "session", "first", "second")


# Lexicons as tables: version 1 as the literal one, version 2 with the names of parts and parties besides.
_LEX_ROWS = ", ".join(f"('modality', '{k}', '{m}', {i})" if k in L.CLASSES else f"('{k}', NULL, '{m}', {i})" for k, ms in L.LEXICON.items() for i, m in enumerate(ms))
_LEXICON = f"""base(category, klass, marker, no) AS (VALUES {_LEX_ROWS}),
lexicon AS (SELECT v.version, base.* FROM base, (VALUES ('1'), ('2')) v(version) UNION ALL SELECT DISTINCT '2', 'object', NULL, lower(p_name), 0 FROM part UNION ALL SELECT DISTINCT '2', 'party', NULL, lower(c_name), 0 FROM customer)"""
_LEX = f"""{with_parts('rules')}, {_LEXICON}, texts AS (SELECT rule_id, lower(text) AS low FROM rules),
met AS (SELECT rule_id, low, version, category, klass, marker, no, length(marker) AS n FROM texts JOIN lexicon ON contains(low, marker)),
hits AS (SELECT rule_id, low, version, category, klass, marker, no, (p - 1)::INT AS start, (p - 1 + n)::INT AS stop FROM met, range(1, 401) r(p) WHERE substr(low, p, n) = marker)"""
_LEX_WORD = f"{_LEX}, words AS (SELECT * FROM hits WHERE NOT regexp_matches(substr(low, start, CASE WHEN start = 0 THEN 0 ELSE 1 END), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(substr(low, stop + 1, 1), '[\\p{{L}}\\p{{N}}_]'))"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = LT.from_literal(spark).unionByName(LT.from_literal(spark, version="2"))
    names = lambda table, column, category: _table(spark, sf_dir, table).select(F.lit("2").alias("version"), F.lit(category).alias("category"), F.lit(None).cast("string").alias("klass"), F.col(column).alias("marker"), F.lit(0).cast("long").alias("no")).distinct()
    return both.unionByName(names("part", "p_name", "object")).unionByName(names("customer", "c_name", "party"))


def _table_hits(spark: SparkSession, sf_dir: str, match: str = "substring") -> DataFrame:
    return LT.hits(corpus(spark, sf_dir, "rules"), _lexicon(spark, sf_dir), match=match)


@query(f"{_LEX} SELECT rule_id, version, category, klass, marker, start, stop FROM hits")
def lex_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_hits(spark, sf_dir).select("rule_id", "version", "category", "klass", "marker", "start", "stop")


@query(f"{_LEX_WORD} SELECT version, category, klass, marker, count(*) AS n, count(DISTINCT rule_id) AS rules FROM words GROUP BY ALL")
def lex_table_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_hits(spark, sf_dir, "word").groupBy("version", "category", "klass", "marker").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule_id").alias("rules"))


_CLASS = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(L.CLASSES))


@query(f"{_LEX_WORD}, m AS (SELECT *, row_number() OVER (PARTITION BY rule_id, version ORDER BY CASE klass {_CLASS} END, length(marker) DESC, no, start) AS rn FROM words WHERE category = 'modality') SELECT rule_id, version, klass, marker, start, stop FROM m WHERE rn = 1")
def lex_table_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LT.modality(_table_hits(spark, sf_dir, "word"))


@query(f"{_LEX}, m AS (SELECT *, row_number() OVER (PARTITION BY rule_id, version ORDER BY start, length(marker) DESC, marker) AS rn FROM hits WHERE category = 'actor') SELECT rule_id, version, marker, start, stop FROM m WHERE rn = 1")
def lex_table_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LT.first_of(_table_hits(spark, sf_dir), "actor")


# Declared constraints. The document is read by both engines; the SQL is made from its rows by other code than the operator's.
DECLARED = {
    "description": "What events must look like, with fields in structs and lists.",
    "fields": {
        "event_id": {"type": "integer", "required": True, "minimum": 0, "description": "key"},
        "payload": {"required": True, "fields": {"kind": {"type": "string", "required": True, "enum": ["click", "view", "purchase", "error"], "minLength": 5}, "value": {"type": "number", "required": True, "minimum": 5, "maximum": 90.5}}},
        "tags": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"pattern": "^[a-z]+$", "maxLength": 8}},
        "lines": {"items": {"fields": {"n": {"required": True, "maximum": 100}}}},
        "absent": {"required": True},
        "missing": {"pattern": "^x"},
    },
}
_EVENTS_DUCK = """SELECT event_id, {'kind': event_type, 'value': CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END} AS payload,
CASE WHEN event_id % 11 = 0 THEN [] WHEN event_id % 13 = 0 THEN [event_type, event_type] WHEN event_id % 7 = 0 THEN [event_type, 'Über', 'x'] WHEN event_id % 5 = 0 THEN NULL ELSE [event_type] END AS tags,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE [{'n': CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 150 END}, {'n': 1}] END AS lines FROM events"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("event_id"), F.col("event_type")
    return _table(spark, sf_dir, "events").select(
        n, F.struct(kind.alias("kind"), F.when(n % 19 != 0, F.col("value")).alias("value")).alias("payload"),
        F.when(n % 11 == 0, F.array().cast("array<string>")).when(n % 13 == 0, F.array(kind, kind)).when(n % 7 == 0, F.array(kind, F.lit("Über"), F.lit("x"))).when(n % 5 != 0, F.array(kind)).alias("tags"),
        F.when(n % 3 != 0, F.array(F.struct(F.when(n % 17 != 0, n % 150).alias("n")), F.struct(F.lit(1).cast("long").alias("n")))).alias("lines"),
    )


#: Where each declared path leads in SQL; a path within a list is judged for an element e.
_PATHS = {"event_id": "event_id", "payload": "payload", "payload.kind": "payload.kind", "payload.value": "payload.value", "tags": "tags", "tags[]": ("tags", "e"), "lines[].n": ("lines", "e.n")}
_TYPES = {"integer": "BIGINT", "string": "VARCHAR", "number": "DOUBLE", "array": "[]"}


def _broken_sql(path: str, kind: str, value: str) -> str:
    said, place = json.loads(value), _PATHS.get(path)
    if place is None:
        return "true" if kind == "required" else "false"
    held, x = place if isinstance(place, tuple) else (None, place)
    number = said if isinstance(said, int | float) else 0
    test = {
        "required": f"{x} IS NULL", "enum": f"{x} NOT IN ({', '.join(chr(39) + str(o) + chr(39) for o in said) if isinstance(said, list) else ''})", "pattern": f"NOT regexp_matches({x}, '{said}')", "minLength": f"length({x}) < {number}",
        "maxLength": f"length({x}) > {number}", "minimum": f"{x} < {number}", "maximum": f"{x} > {number}", "minItems": f"len({x}) < {number}", "maxItems": f"len({x}) > {number}", "uniqueItems": f"len(list_distinct({x})) <> len({x})",
        "type": f"NOT contains(typeof({x}), '{_TYPES.get(said, '') if isinstance(said, str) else ''}')",
    }[kind]
    return f"len(list_filter({held}, lambda e: coalesce({test}, false))) > 0" if held else test


_ROWS = C.declared(DECLARED)
_EACH = " UNION ALL ".join(f"SELECT '{C.name_of(*c)}' AS \"check\", event_id, coalesce({_broken_sql(*c)}, false) AS bad FROM e" for c in _ROWS)


@query(f'WITH e AS ({_EVENTS_DUCK}), j AS ({_EACH}) SELECT "check", count(*) AS rows, count(*) FILTER (bad) AS violations, min(event_id) FILTER (bad) AS first FROM j GROUP BY ALL')
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against constraints that are rows of a table."""
    return C.report(_events(spark, sf_dir), spark.createDataFrame(_ROWS, C.CONSTRAINT), "event_id")


@query(f'WITH e AS ({_EVENTS_DUCK}), j AS ({_EACH}), b AS (SELECT "check", event_id, row_number() OVER (PARTITION BY "check" ORDER BY event_id) AS no FROM j WHERE bad) SELECT "check", event_id, no::INT AS no FROM b WHERE no <= 10')
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten events that break each constraint."""
    return C.violations(_events(spark, sf_dir), spark.createDataFrame(_ROWS, C.CONSTRAINT), "event_id")


# Contracts over several artifacts; what they expect holds at every size.
CONTRACT = {
    "contract_id": "tables",
    "artifacts": {
        "documents": {"path": "documents.parquet", "checks": {
            "rows": {"rows": {"min": 1}}, "languages": {"value": "count(distinct lang)", "equals": 4}, "long_texts": {"value": "count_if(length(text) > 100000)", "max": 0}, "sizes_agree": {"assert": "bool_and(n_chars = length(text))"},
            "no_nulls": {"assert": "count_if(text is null) = 0"}, "one_language": {"value": "count(distinct lang)", "max": 1}, "nothing_known": {"value": "max(cast(null as int))", "equals": 1}}},
        "region": {"path": "region.parquet", "checks": {"rows": {"rows": 5}, "wrong_rows": {"rows": 6}, "names": {"value": "min(r_name)", "equals": "AFRICA"}}},
        "nation": {"path": "nation.parquet", "checks": {"rows": {"rows": {"min": 25, "max": 25}}}},
        "manifest": {"path": "{manifest}", "format": "json", "checks": {"name": {"field": "name", "equals": "orders"}, "saved": {"field": "checks.saved", "equals": False}, "wrong_flag": {"field": "checks.open", "equals": False}, "calls": {"field": "rows", "at_most_field": "checks.most"}, "too_many": {"field": "checks.most", "at_most_field": "rows"}, "unknown": {"field": "nowhere", "equals": 3}}},
        "absent": {"path": "none.parquet", "checks": {"rows": {"rows": 1}}},
    },
}
_MANIFEST = "(SELECT count(*) AS rows FROM orders)"


def _contract_sql() -> str:
    told = {("documents", "rows"): "count(*)", ("documents", "languages"): "count(DISTINCT lang)", ("documents", "long_texts"): "count(*) FILTER (length(text) > 100000)", ("documents", "sizes_agree"): "bool_and(n_chars = length(text))", ("documents", "no_nulls"): "count(*) FILTER (text IS NULL) = 0", ("documents", "one_language"): "count(DISTINCT lang)", ("documents", "nothing_known"): "max(NULL::INT)", ("region", "rows"): "count(*)", ("region", "wrong_rows"): "count(*)", ("region", "names"): "min(r_name)", ("nation", "rows"): "count(*)"}
    fields = {"name": "'orders'", "saved": "'false'", "wrong_flag": "'true'", "calls": "rows", "too_many": "rows + 1", "unknown": "NULL"}
    failing = {("documents", "one_language"), ("region", "wrong_rows"), ("manifest", "wrong_flag"), ("manifest", "too_many"), ("absent", "rows")}
    rows = []
    for name, said in CONTRACT["artifacts"].items():
        there = name != "absent"
        rows.append(f"""SELECT '{name}' AS artifact, 'exists' AS "check", '{str(there).lower()}' AS actual, '{{"equals": true}}' AS expected, '{'pass' if there else 'fail'}' AS status""")
        for check, about in said["checks"].items():
            value = (fields[check] if name == "manifest" else told.get((name, check), "NULL")) if there else "NULL"
            told_of = about["rows"] if isinstance(about.get("rows"), dict) else {"equals": about["rows"]} if "rows" in about else {"equals": True} if "assert" in about else about
            want = json.dumps({k: told_of[k] for k in ("equals", "min", "max", "at_most_field") if k in told_of}, sort_keys=True)
            status = "fail" if (name, check) in failing else "pass"
            if status == "pass" and "value" in about and isinstance(about.get("equals"), int) and check != "nothing_known":
                status = f"' || CASE WHEN {value} = {about['equals']} THEN 'pass' ELSE 'fail' END || '"
            rows.append(f"SELECT '{name}', '{check}', ({value})::VARCHAR, '{want}', '{status}'" + (f" FROM {_MANIFEST}" if name == "manifest" else f" FROM {name}" if there else ""))
    return " UNION ALL ".join(rows)


@query(_contract_sql())
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract document over tables and the manifest of one of them, which is written first."""
    path = new_path(spark)
    rows = _table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("rows"))
    rows.select(F.to_json(F.struct(F.lit("orders").alias("name"), "rows", F.struct(F.lit(False).alias("saved"), F.lit(True).alias("open"), (F.col("rows") + 1).alias("most")).alias("checks")))).coalesce(1).write.text(path)
    document = re.sub(r"\{manifest\}", path, json.dumps(CONTRACT))
    return N.run(spark, document, sf_dir).select("artifact", "check", "actual", "expected", "status")


# Weak annotation beyond ASCII: in SQL words, blanks and edges of any script are written out, an edge taking a character.
_B, _W = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]", "[\\p{L}\\p{N}_]"
_IN, _OUT = "(?:^|[^\\p{L}\\p{N}_])", "(?:[^\\p{L}\\p{N}_]|$)"


def _found(pattern: str, group: int = 0, marks: str = "") -> str:
    """A pattern's first match without marks at its end and outer blanks, null where nothing is left."""
    text = f"regexp_extract(text, '{pattern}', {group}, 'i')"
    text = f"rtrim({text}, '{marks}')" if marks else text
    return f"nullif(regexp_replace({text}, '^{_B}+|{_B}+$', '', 'g'), '')"


_ACT = f"{_IN}(?:shall|must|may|should){_B}+(not{_B}+)?(?:be{_B}+)?({_W}+(?:{_B}+{_W}+){{0,8}})"
_KIND = f"""CASE WHEN regexp_matches(l, '{_IN}(shall not|must not|may not|is prohibited){_OUT}|{_IN}prohibit') THEN 'prohibition' WHEN regexp_matches(l, '{_IN}(shall|must|is required|is obliged){_OUT}') THEN 'obligation'
WHEN regexp_matches(l, '{_IN}(may|is permitted|is entitled|have the right|have a right){_OUT}') THEN 'permission' WHEN regexp_matches(l, '{_IN}(means|refers to|defined as|definition){_OUT}') THEN 'definition' ELSE 'obligation' END"""


@query(f"""{with_parts('words')}, x AS (SELECT rule_id, text, lower(text) AS l FROM words) SELECT rule_id, {_KIND} AS modality,
coalesce({_found(f'(?:the{_B}+)?(?:controller|processor|data subject|supervisory authority|recipient|third party|natural person|legal person)')}, {_found(f'^((?:The|A|Each|Any){_B}+{_W}+(?:{_B}+{_W}+)?){_B}+(?:shall|must|may|should|is)', 1)}) AS actor,
nullif(concat(regexp_extract(text, '{_ACT}', 1, 'i'), regexp_extract(text, '{_ACT}', 2, 'i')), '') AS action,
{_found(f'(?:Where|If|When|In case of|Provided that|On condition that){_B}+[^,.;]+(?:,|;|[.])', marks=',;.')} AS condition,
coalesce({_found(f'(?:within|before|after|at least|at most|no later than|not later than){_B}+[^,.;]+')}, {_found(f'(?:in accordance with|subject to|without prejudice to){_B}+[^,.;]+')}) AS "constraint",
{_found(f'(?:except|unless|with the exception of|apart from|other than|excluding){_B}+[^.;]+', marks=';.')} AS "exception" FROM x""")
def weak_annotate_beyond_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.weak_annotate(F.col("text"))
    return corpus(spark, sf_dir, "words").select("rule_id", *[found[f].alias(f) for f in FIELDS])


# Sinks that commit.
@query(rule_queries.SQL["jsonl_roundtrip"])
def committed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as a committed run, another run that breaks off before its manifest, and what readers see."""
    rows, path = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), new_path(spark)
    committed.write(rows, path)
    rows.select(F.to_json(F.struct("conv_id")).alias("value")).write.text(f"{path}/data-unfinished")
    found = committed.read(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    return found.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").alias("n"))


@query("SELECT count(*)::BIGINT AS lines, true AS ok FROM conversations")
def committed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a run's manifest, and whether every file still is as it was written."""
    path = new_path(spark)
    committed.write(_table(spark, sf_dir, "conversations"), path)
    return committed.verify(spark, path).agg(F.sum("lines").alias("lines"), F.bool_and("ok").alias("ok"))
