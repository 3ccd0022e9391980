"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from lakesift.llm import queries_code, queries_corpus

MODULES = (queries_code, queries_corpus)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
