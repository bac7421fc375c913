"""Named queries and the SQL each is checked against."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame``, with its SQL where SQL can say it."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return add
