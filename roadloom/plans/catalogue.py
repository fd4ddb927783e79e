"""Registered queries of the engine and their oracle SQL.

The driver's tables are not traffic data; each operator runs on them by a role mapping: nations are nodes, a
lineitem is a trip from the supplier's nation to the customer's, suppliers are stations, events are counts of
edges user -> event type, parts are road segments, an order's suppliers are a path.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return keep


from roadloom.plans import blocks, files, models, networks, panels, runs, series, stations  # noqa: E402, F401
