"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.session import ship_package, table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, *tables: str, sql: str | None = None):
        """Registers f(table, ...) under its name, as a query of (spark, sf_dir)."""

        def register(f):
            def run(spark: SparkSession, sf: str) -> DataFrame:
                ship_package(spark)
                return f(*(table(spark, sf, t) for t in tables))

            self.queries[f.__name__] = run
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register
