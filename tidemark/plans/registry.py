"""All registered queries and their oracles."""

from __future__ import annotations

from tidemark.plans import documents, freshness, pipeline, streams, verdicts

_MODULES = (documents, freshness, pipeline, streams, verdicts)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql.strip() for m in _MODULES for name, sql in m.ORACLE.items()}
