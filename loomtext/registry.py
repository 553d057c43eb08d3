"""Named queries and the SQL that states the same result, gathered from the plan modules."""

from __future__ import annotations

from loomtext.plans import editor_queries, file_queries, ranking_queries, retrieval_queries, streaming_queries

MODULES = (retrieval_queries, ranking_queries, editor_queries, file_queries, streaming_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
