"""Registered queries of the geospatial operators and their oracle SQL."""

from __future__ import annotations

from . import catalog_queries, feature_queries, file_queries, scalar_queries, spatial_queries

_MODULES = (feature_queries, scalar_queries, spatial_queries, catalog_queries, file_queries)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.REGISTRY.queries.items()}
ORACLES: dict = {k: s for m in _MODULES for k, s in m.REGISTRY.oracles.items()}
