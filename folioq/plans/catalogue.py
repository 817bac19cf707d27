"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from folioq.plans import graph_queries, page_queries, retrieval_queries, upkeep_queries

QUERIES, ORACLES = {}, {}
for _module in (retrieval_queries, page_queries, graph_queries, upkeep_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
