"""Every registered query of the engine with the SQL that another engine can run."""

from __future__ import annotations

from tracklens.plans import inference_queries, run_queries, scene_queries, series_queries, table_queries, text_queries
from tracklens.plans.base import Query

BOOKS = [series_queries.BOOK, table_queries.BOOK, inference_queries.BOOK, text_queries.BOOK, scene_queries.BOOK, run_queries.BOOK]


def queries() -> dict[str, Query]:
    return {k: f for b in BOOKS for k, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: x for b in BOOKS for k, x in b.sql.items()}
