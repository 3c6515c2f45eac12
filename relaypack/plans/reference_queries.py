"""All queries over the engine's own operators, and their SQL."""

from __future__ import annotations

from relaypack.plans import audit_queries, contract_queries, model_queries, part_queries, record_queries, selection_queries, table_queries, text_queries

QUERIES = text_queries.QUERIES | contract_queries.QUERIES | selection_queries.QUERIES | record_queries.QUERIES | model_queries.QUERIES | audit_queries.QUERIES | table_queries.QUERIES | part_queries.QUERIES
SQL = text_queries.SQL | contract_queries.SQL | selection_queries.SQL | record_queries.SQL | model_queries.SQL | audit_queries.SQL | table_queries.SQL | part_queries.SQL

#: Small cases on written-down rows, for the tests.
CASES = text_queries.CASES | contract_queries.CASES | selection_queries.CASES
CASE_SQL = text_queries.CASE_SQL | contract_queries.CASE_SQL | selection_queries.CASE_SQL
