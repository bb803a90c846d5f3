"""Corpora derived from the given tables, in SQL that Spark and DuckDB both read.

rules: a templated sentence for each order, with the template's fields as gold. predictions: two runs that bend gold in
known ways. calls: a call ledger from the events. Braces name tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIELDS = ["modality", "actor", "action", "condition", "constraint", "exception"]

RULES = """
SELECT rule_id, segment, modality, marker, actor, action, condition, "constraint", "exception",
  concat(prefix, CASE WHEN prefix = '' THEN concat(upper(substr(actor, 1, 1)), substr(actor, 2)) ELSE actor END, ' ',
    marker, ' ', action, second,
    CASE WHEN limit_text <> '' THEN concat(' ', limit_text) ELSE '' END,
    CASE WHEN except_text <> '' THEN concat(' ', except_text) ELSE '' END, '.') AS text
FROM (
  SELECT o.o_orderkey AS rule_id, c.c_mktsegment AS segment,
    CASE o.o_orderkey % 5 WHEN 0 THEN 'Unless approved, ' WHEN 1 THEN 'Where consent is absent, ' ELSE '' END AS prefix,
    CASE o.o_orderkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'consent is absent' END AS condition,
    CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'the customer' WHEN 'MACHINERY' THEN 'the operator'
      WHEN 'FURNITURE' THEN 'the provider' WHEN 'BUILDING' THEN 'each controller' ELSE 'every driver' END AS actor,
    CASE o.o_orderkey % 9 WHEN 0 THEN 'shall' WHEN 1 THEN 'must' WHEN 2 THEN 'shall not' WHEN 3 THEN 'must not'
      WHEN 4 THEN 'may' WHEN 5 THEN 'is permitted to' WHEN 6 THEN 'means' WHEN 7 THEN 'may not' ELSE 'will' END AS marker,
    CASE o.o_orderkey % 9 WHEN 0 THEN 'obligation' WHEN 1 THEN 'obligation' WHEN 2 THEN 'prohibition'
      WHEN 3 THEN 'prohibition' WHEN 4 THEN 'permission' WHEN 5 THEN 'permission' WHEN 6 THEN 'definition'
      WHEN 7 THEN 'prohibition' END AS modality,
    concat(CASE o.o_orderstatus WHEN 'O' THEN 'record the ' WHEN 'F' THEN 'archive the ' ELSE 'disclose the ' END,
      coalesce(p.p_name, 'file')) AS action,
    CASE WHEN o.o_orderkey % 7 = 0 THEN ' and the authority shall review the entry' ELSE '' END AS second,
    CASE o.o_orderkey % 4 WHEN 0 THEN 'within 30 days' WHEN 1 THEN 'in accordance with the policy' ELSE '' END AS limit_text,
    CASE o.o_orderkey % 4 WHEN 0 THEN '30 days' WHEN 1 THEN 'the policy' END AS "constraint",
    CASE o.o_orderkey % 6 WHEN 0 THEN 'unless the court objects' WHEN 1 THEN 'except where waived' ELSE '' END AS except_text,
    CASE o.o_orderkey % 6 WHEN 0 THEN 'the court objects' WHEN 1 THEN 'waived' END AS "exception"
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
    LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS partkey FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
    LEFT JOIN {part} p ON p.p_partkey = l.partkey) t
"""

GOLD = """
SELECT rule_id, fidx, field,
  CASE field WHEN 'modality' THEN modality WHEN 'actor' THEN actor WHEN 'action' THEN action
    WHEN 'condition' THEN condition WHEN 'constraint' THEN "constraint" ELSE "exception" END AS gold
FROM rules CROSS JOIN (VALUES (1, 'modality'), (2, 'actor'), (3, 'action'), (4, 'condition'), (5, 'constraint'), (6, 'exception')) AS f(fidx, field)
"""

PREDICTIONS = """
SELECT run, rule_id, fidx, field, gold,
  CASE WHEN field = 'modality' THEN CASE WHEN (rule_id + r) % 6 = 0 THEN NULL WHEN (rule_id + r) % 11 = 0 THEN 'permission' ELSE gold END
    WHEN (rule_id + fidx * r) % 5 = 0 THEN NULL
    WHEN gold IS NULL AND (rule_id + fidx + r) % 8 = 0 THEN 'the entry'
    WHEN (rule_id + fidx + r) % 7 = 0 THEN upper(gold) || ', now'
    WHEN (rule_id + fidx * 2 + r) % 9 = 0 THEN 'another matter'
    WHEN (rule_id + fidx + r) % 13 = 0 THEN gold || '.'
    ELSE gold END AS pred
FROM gold CROSS JOIN (VALUES ('a', 1), ('b', 2)) AS v(run, r)
"""

CALLS = """
SELECT event_id AS call_id, event_type AS stage,
  CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS attempted,
  CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN false ELSE true END AS schema_valid,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'read timed out' WHEN 1 THEN 'connection refused'
      WHEN 2 THEN 'HTTP 500 from server' ELSE 'clause_text missing' END
    WHEN event_id % 7 = 0 THEN 'unknown field in clause' END AS error,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS duration_ms,
  CASE WHEN event_id % 2 = 0 THEN 60 ELSE 30 END AS timeout_seconds
FROM {events}
"""

CLAUSES = """
SELECT rule_id, CASE WHEN rule_id % 41 = 0 THEN '' ELSE concat('s', rule_id) END AS source_id, text AS source_text,
  CASE WHEN rule_id % 37 = 0 THEN 'not in the text' WHEN rule_id % 31 = 0 THEN 'e' ELSE action END AS span_text,
  CAST(instr(text, action) - 1 + CASE WHEN rule_id % 5 = 0 THEN 2 WHEN rule_id % 43 = 0 THEN -90 ELSE 0 END AS INT) AS span_start,
  CAST(instr(text, action) - 1 + length(action) + CASE WHEN rule_id % 5 = 0 THEN 2 WHEN rule_id % 29 = 0 THEN 400 ELSE 0 END AS INT) AS span_end,
  CASE WHEN rule_id % 47 = 0 THEN 1.5 ELSE 0.25 * (rule_id % 4) END AS confidence
FROM rules
"""

ANSWERS = """
SELECT rule_id, CASE rule_id % 8
  WHEN 0 THEN concat('{"modality": "', coalesce(modality, 'duty'), '", "actor": " ', actor, ' ", "action": "', action, '", "condition": null, "constraint": "", "exception": null}')
  WHEN 1 THEN concat('{"normative_type": "', coalesce(modality, 'duty'), '", "subject": "', actor, '"}')
  WHEN 2 THEN concat('{"modality": "obligation", "severity": "', marker, '"}')
  WHEN 3 THEN concat('["', actor, '"]')
  WHEN 4 THEN '{}'
  WHEN 5 THEN concat('{"modality": "', actor, '", "action": 7}')
  WHEN 6 THEN concat('{"conditions": "', coalesce(condition, ' '), '", "action": "', action, '"}')
  ELSE 'no json at all' END AS answer
FROM rules
"""

#: Whole responses, one broken rule in each of twelve forms.
RESPONSES = """
SELECT rule_id, CASE WHEN rule_id % 12 = 10 THEN 'no json at all' WHEN rule_id % 12 = 2 THEN concat('{"schema_version": "1", "source_id": "s', rule_id, '", "source_text": "t"}')
  ELSE concat('{"schema_version": "1", "source_id": "s', rule_id, '", "source_text": "', action, '", ', CASE WHEN rule_id % 12 = 3 THEN '"model": "m", ' ELSE '' END, '"clauses": ',
    CASE rule_id % 12 WHEN 4 THEN '{"clause_id": "C1"}' ELSE concat('[{"clause_id": "C1", "modality": {"text": "', marker, '"}, "actor": null}', CASE rule_id % 12
      WHEN 0 THEN '' WHEN 1 THEN concat(', {"clause_id": "C2", "normative_type": {"text": "shall"}, "subject": {"text": "', actor, '"}}')
      WHEN 5 THEN ', {"clause_id": "C2"}, "C3"' WHEN 6 THEN ', {"object": "x", "severity": 1}' WHEN 7 THEN ', {"clause_id": "C2", "severity": 3}'
      WHEN 8 THEN ', {"subject": null, "actor": {"text": "x"}}' WHEN 9 THEN ', {"clause_id": "C2"}, {"conditions": "if so"}'
      WHEN 11 THEN ', {"clause_id": "C2", "actor": "plain", "conditions": null, "confidence": 0.5}' ELSE '' END, ']') END, '}') END AS response
FROM rules
"""

TASKS = """
SELECT process_id, seq, concat('t', seq) AS node_id, concat(verb, ' the ', thing) AS name, lane FROM (
  SELECT l_orderkey AS process_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_tax, l_discount) AS seq,
    CASE WHEN l_linenumber % 3 = 0 THEN 'archive' WHEN l_linenumber % 3 = 1 THEN 'record' ELSE 'check' END AS verb,
    p.p_name AS thing, CASE s.s_nationkey % 4 WHEN 0 THEN 'the customer' WHEN 1 THEN 'each controller' WHEN 2 THEN 'the operator' ELSE 'Auditor' END AS lane
  FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey) x
"""

FLOWS = """
SELECT process_id, 's' AS source, 't1' AS target FROM tasks WHERE seq = 1
UNION ALL SELECT process_id, concat('t', seq), concat('t', seq + 1) FROM (SELECT *, max(seq) OVER (PARTITION BY process_id) AS top FROM tasks) x WHERE seq < top AND NOT (process_id % 7 = 0 AND seq = 2)
UNION ALL SELECT process_id, concat('t', seq), 't1' FROM tasks WHERE process_id % 3 = 0 AND seq % 3 = 0
UNION ALL SELECT process_id, concat('t', seq), concat('t', seq + 2) FROM (SELECT *, max(seq) OVER (PARTITION BY process_id) AS top FROM tasks) x WHERE process_id % 5 = 0 AND seq + 2 <= top
"""

#: Actions and tasks of six words, so that they are alike by degrees; every 17th has letters and blanks beyond ASCII.
DUTIES = """
SELECT o_orderkey AS rule_id, CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '   ' WHEN o_orderkey % 31 = 0 THEN 'sue nobody ever'
    WHEN o_orderkey % 17 = 0 THEN concat('Prüfe the ', p_name, ' ', lower(p_type), ' für 𝔄', substr(p_brand, 7))
    ELSE concat(CASE o_orderstatus WHEN 'O' THEN 'Record the ' WHEN 'F' THEN 'archive the ' ELSE 'disclose the ' END, p_name, ' for ', p_brand) END AS action,
  CASE o_orderkey % 6 WHEN 0 THEN 'the customer' WHEN 1 THEN 'Each controller' WHEN 2 THEN 'operator' WHEN 3 THEN 'every auditor' WHEN 4 THEN NULL ELSE 'the chief of the board' END AS actor
FROM {orders} o JOIN (SELECT l_orderkey, min(l_partkey) AS partkey FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey JOIN {part} p ON p.p_partkey = l.partkey
"""

WORK = """
SELECT l_orderkey AS process_id, CASE WHEN l_orderkey % 37 = 0 THEN ' ' WHEN l_orderkey % 41 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN concat('prüfe the ', p_name, ' ', lower(p_type), ' für 𝔄', substr(p_brand, 7))
    ELSE concat(CASE l_linenumber % 3 WHEN 0 THEN 'Archive the ' WHEN 1 THEN 'record the ' ELSE 'check the ' END, p_name, ' of ', p_brand) END AS name,
  CASE s_nationkey % 4 WHEN 0 THEN 'the Customer' WHEN 1 THEN 'each controller' WHEN 2 THEN 'the operator' ELSE 'Auditor' END AS lane
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
"""

#: Rules with letters, blanks and characters beyond ASCII.
WORDS = """
SELECT rule_id, CASE rule_id % 8 WHEN 0 THEN replace(replace(text, 'record', 'prüfe'), 'archive', 'lösche') WHEN 1 THEN concat('The Käufer ', substr(text, instr(text, marker)))
  WHEN 2 THEN replace(text, ' ', '\u00a0') WHEN 3 THEN concat('𝔄 ', replace(text, 'the ', 'über ')) WHEN 4 THEN replace(replace(text, 'o', 'ö'), 'e', 'é') WHEN 5 THEN replace(text, marker, concat('ä', marker))
  WHEN 6 THEN concat('Each Ärztin\u2003Müller ', substr(text, instr(text, marker))) ELSE text END AS text
FROM rules
"""

PARTS = {"rules": RULES, "gold": GOLD, "predictions": PREDICTIONS, "calls": CALLS, "clauses": CLAUSES, "answers": ANSWERS, "responses": RESPONSES, "tasks": TASKS, "flows": FLOWS, "duties": DUTIES, "work": WORK, "words": WORDS}
NEEDS = {"rules": [], "gold": ["rules"], "predictions": ["rules", "gold"], "calls": [], "clauses": ["rules"], "answers": ["rules"], "responses": ["rules"], "tasks": [], "flows": ["tasks"], "duties": [], "work": [], "words": ["rules"]}


def with_parts(*names: str) -> str:
    """A WITH clause of corpora for DuckDB."""
    order = list(dict.fromkeys(x for n in names for x in [*NEEDS[n], n]))
    return "WITH " + ", ".join(f"{x} AS ({re.sub(r'{(\w+)}', r'\1', PARTS[x])})" for x in order)


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus as a DataFrame over the tables of a folder."""
    body = with_parts_spark(sf_dir, name)
    return spark.sql(body)


def corpus_over(spark: SparkSession, name: str, **given: DataFrame) -> DataFrame:
    """A corpus over others that are given as DataFrames, so that these are not computed anew for each place that names them."""
    return spark.sql(re.sub(rf"\b({'|'.join(given)})\b", r"{\1}", PARTS[name]), **given)


def with_parts_spark(sf_dir: str, name: str) -> str:
    order = [*NEEDS[name], name]
    text = {x: re.sub(r"{(\w+)}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", PARTS[x]) for x in order}
    text = {x: re.sub(r'"(constraint|exception)"(?!:)', r"`\1`", t) for x, t in text.items()}
    return "WITH " + ", ".join(f"{x} AS ({text[x]})" for x in order) + f" SELECT * FROM {name}"
