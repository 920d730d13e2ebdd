"""All queries of the core packages with their DuckDB counterparts."""

from __future__ import annotations

from cairn.plans import bags, formats, graphs, ratings, skewed_links, texts, vectors

_MODULES = [skewed_links, texts, graphs, vectors, ratings, bags, formats]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
