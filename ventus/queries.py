"""The library's own queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from ventus import catalog_metrics, catalog_questions, catalog_search, catalog_store, catalog_text

QUERIES = {**catalog_metrics.QUERIES, **catalog_text.QUERIES, **catalog_store.QUERIES, **catalog_questions.QUERIES, **catalog_search.QUERIES}
ORACLE_SQL = {**catalog_metrics.ORACLE_SQL, **catalog_text.ORACLE_SQL, **catalog_store.ORACLE_SQL, **catalog_questions.ORACLE_SQL, **catalog_search.ORACLE_SQL}
