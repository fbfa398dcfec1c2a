"""Queries by name and their SQL twins."""

from __future__ import annotations

from tidegraph.plans.queries import QUERIES
from tidegraph.plans.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
