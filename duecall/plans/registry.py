"""All queries of the engine by name, with their oracles."""

from __future__ import annotations


def _modules() -> tuple:
    from duecall.plans import catalogue, history, joins, lookups, pages, rules, searches

    return catalogue, searches, lookups, pages, rules, joins, history


def queries() -> dict:
    """Name -> callable(spark, sf_dir) -> DataFrame."""
    found: dict = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    """Name -> DuckDB SQL with the same columns and rows."""
    found: dict = {}
    for module in _modules():
        found |= module.ORACLES
    return found
