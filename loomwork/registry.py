"""Queries by name over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from loomwork.plans import container_queries, edge_queries, more_queries, part_queries, schedule_queries, table_queries

QUERIES = {**schedule_queries.QUERIES, **table_queries.QUERIES, **container_queries.QUERIES, **more_queries.QUERIES, **part_queries.QUERIES, **edge_queries.QUERIES}
ORACLES = {**schedule_queries.ORACLES, **table_queries.ORACLES, **container_queries.ORACLES, **more_queries.ORACLES, **part_queries.ORACLES, **edge_queries.ORACLES}
