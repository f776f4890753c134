"""The registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with their reference SQL where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql.strip()
            return query

        return register


def registry() -> Registry:
    """All queries of the package."""
    from tidelog.workload import acks, logs, messages, names, statements, streams

    merged = Registry()
    for part in (logs, acks, messages, names, statements, streams):
        merged.queries.update(part.R.queries)
        merged.sql.update(part.R.sql)
    return merged
