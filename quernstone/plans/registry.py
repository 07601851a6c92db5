"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from quernstone.plans import dialogue, graph, ingestion, resolution, retrieval

QUERIES = retrieval.QUERIES | ingestion.QUERIES | graph.QUERIES | dialogue.QUERIES | resolution.QUERIES
SQL = retrieval.SQL | ingestion.SQL | graph.SQL | dialogue.SQL | resolution.SQL
