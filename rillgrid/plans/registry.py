"""Where queries are kept with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .proxies import cte

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` names the proxies that ``sql`` starts from."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            with_ = cte(*views.split()) if views else ""
            text = sql.strip()
            if text.startswith("WITH "):
                rest = text[5:]
                ORACLES[name] = f"WITH {rest}" if not with_ else (f"WITH RECURSIVE {with_},\n{rest[10:]}" if rest.startswith("RECURSIVE ") else f"WITH {with_},\n{rest}")
            else:
                ORACLES[name] = f"WITH {with_}\n{text}" if with_ else text
        return f

    return add
