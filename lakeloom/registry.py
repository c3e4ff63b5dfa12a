"""One list of queries: a key, a function of (spark, sf_dir) and, where DuckDB can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register the function under its own name."""

    def wrap(run: Run) -> Run:
        if run.__name__ in REGISTRY:
            raise ValueError(f"two queries are called {run.__name__}")
        REGISTRY[run.__name__] = Query(run.__name__, run, sql)
        return run

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
