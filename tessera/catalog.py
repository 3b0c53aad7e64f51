"""Registered queries over the Parquet tables, and the same in SQL."""

from __future__ import annotations

from tessera.plans import catalogue_queries, composed_queries, hierarchy_queries, more_queries, provider_queries, registry_queries, release_queries, resource_queries, versioned_queries

_MODULES = (hierarchy_queries, catalogue_queries, more_queries, composed_queries, versioned_queries, provider_queries, registry_queries, resource_queries, release_queries)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.Q.items()}
ORACLE: dict = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
FLAGSHIP = "expand_hierarchy"
