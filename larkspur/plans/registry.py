"""Every registered query with its SQL, by name."""

from __future__ import annotations

from larkspur.plans import content_queries, feed_queries, live_queries, member_queries

_MODULES = (feed_queries, member_queries, content_queries, live_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
