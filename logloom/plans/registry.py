"""All registered queries and the SQL that gives the same result."""

from __future__ import annotations

from logloom.plans import core_queries, flow_queries, log_queries, state_queries, text_queries

_MODULES = (core_queries, text_queries, flow_queries, log_queries, state_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
