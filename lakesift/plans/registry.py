"""All queries of the core package and their SQL."""

from __future__ import annotations

from lakesift.plans import corpus_queries, dashboard_queries, maintenance, scan_queries

MODULES = (maintenance, scan_queries, dashboard_queries, corpus_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = maintenance.p1_found
