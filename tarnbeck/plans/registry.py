"""Queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import event_queries, table_queries, text_queries, training_queries, vocabulary_queries

QUERIES = {**event_queries.QUERIES, **text_queries.QUERIES, **table_queries.QUERIES, **training_queries.QUERIES, **vocabulary_queries.QUERIES}
ORACLE = {**event_queries.ORACLE, **text_queries.ORACLE, **table_queries.ORACLE, **training_queries.ORACLE, **vocabulary_queries.ORACLE}
