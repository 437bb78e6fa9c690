"""Registers a named query with its SQL."""

from __future__ import annotations

from corpusloom.session import tune
from corpusloom.sources.tables import table


class Tables:
    """Scans by name; the session and folder for what builds on other queries."""

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = tune(spark), folder

    def __call__(self, name: str):
        return table(self.spark, self.folder, name)


class Named:
    """Queries and their SQL by name; a query gets a function from table name to scan."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            def run(spark, d):
                return f(Tables(spark, d))

            run.__doc__ = f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add
