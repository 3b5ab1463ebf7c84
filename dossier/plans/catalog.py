"""All registered queries of the library, with the SQL that says the same."""

from __future__ import annotations

from . import contract_queries, evidence_queries, list_queries, record_queries, review_queries, rollup_queries, stream_queries, text_queries, verdict_queries

QUERIES = {**record_queries.QUERIES, **text_queries.QUERIES, **verdict_queries.QUERIES, **list_queries.QUERIES, **review_queries.QUERIES, **evidence_queries.QUERIES, **stream_queries.QUERIES, **contract_queries.QUERIES, **rollup_queries.QUERIES}
ORACLE_SQL = {**record_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **verdict_queries.ORACLE_SQL, **list_queries.ORACLE_SQL, **review_queries.ORACLE_SQL, **evidence_queries.ORACLE_SQL, **stream_queries.ORACLE_SQL, **contract_queries.ORACLE_SQL, **rollup_queries.ORACLE_SQL}
