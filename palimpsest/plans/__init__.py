"""Registered queries and their SQL."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    """All queries of the diff engine, and the SQL of those that SQL can express."""
    from . import join_oracles, joins, oracles, queries, streams, views

    return {**queries.QUERIES, **joins.QUERIES, **streams.QUERIES, **views.QUERIES}, {**oracles.ORACLE_SQL, **join_oracles.ORACLE_SQL, **streams.ORACLE_SQL, **views.ORACLE_SQL}
