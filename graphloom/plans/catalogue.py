"""Every query of the library with its SQL, by name."""

from __future__ import annotations

from graphloom.plans import analytics, chunking, code, graphs, retrieval, stores, streams, views

QUERIES, ORACLES = {}, {}
for _part in (analytics, chunking, code, graphs, retrieval, stores, streams, views):
    QUERIES |= _part.registry.queries
    ORACLES |= _part.registry.oracles
