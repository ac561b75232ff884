"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weekcast.plans.testbed import tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(build(spark, folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def plain(sql: str, dates: tuple[str, ...] = (), doubles: tuple[str, ...] = ()) -> str:
    """Put the last SELECT of a statement into output form (text dates, rounded doubles)."""
    changes = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
    changes += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles]
    replace = f" REPLACE ({', '.join(changes)})" if changes else ""
    return f"SELECT *{replace} FROM ({sql}) AS answer"
