"""All registered queries with their SQL twins."""

from __future__ import annotations

from . import catalog_queries, chat_queries, geometry_queries, retrieval_queries, section_queries, text_queries

PARTS = [text_queries, chat_queries, catalog_queries, section_queries, retrieval_queries, geometry_queries]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in PARTS:
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
