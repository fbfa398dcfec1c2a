"""The graph as temporary views, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Views that :func:`register` makes.
NAMES = ("pg_nodes", "pg_edges", "pg_calendar")


def register(nodes: DataFrame, edges: DataFrame, calendar: DataFrame) -> None:
    """``pg_nodes``, ``pg_edges`` and ``pg_calendar`` in the session of the frames."""
    for name, df in zip(NAMES, (nodes, edges, calendar), strict=True):
        df.createOrReplaceTempView(name)
