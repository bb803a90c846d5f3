"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from statuta.plans import clause_queries, compliance_queries, evaluation_queries, rule_queries

MODULES = [evaluation_queries, rule_queries, clause_queries, compliance_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
