"""All core queries and their SQL."""

from __future__ import annotations

from chronoloom.plans import core_queries, graph_queries, knowledge_queries, maintenance_queries, retrieval_queries, temporal_queries, text_queries

MODULES = (core_queries, temporal_queries, graph_queries, retrieval_queries, text_queries, maintenance_queries, knowledge_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
FLAGSHIP = "hybrid_search"
