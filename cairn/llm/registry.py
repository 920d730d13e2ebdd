"""All queries of the training-data operators with their DuckDB counterparts."""

from __future__ import annotations

from cairn.llm import markup, packing, residue, similar, spectral, term_tables, tokenizing

_MODULES = [markup, term_tables, tokenizing, packing, residue, similar, spectral]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
