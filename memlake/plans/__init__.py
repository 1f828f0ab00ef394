"""Registered queries over the synthetic tables and their DuckDB oracle SQL."""

from memlake.plans.catalog import QUERIES, ORACLE_SQL, FLAGSHIP  # noqa: F401
