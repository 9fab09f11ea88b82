"""Registry of the engine's queries and their DuckDB counterparts."""

from __future__ import annotations

from . import graph, inputs, keyed, learning, metrics, vectors

MODULES = (keyed, inputs, graph, vectors, metrics, learning)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
