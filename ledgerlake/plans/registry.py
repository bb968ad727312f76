"""Named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.plans.fixtures import Inputs


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None) -> Callable:
        """Registers a function of ``Inputs`` under its name; ``sql`` is None where the other engine can't say it."""

        def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
            self.queries[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
