"""Name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from specweave.queries.inputs import Inputs
from specweave.queries.oracle import with_ctes


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Inputs(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def add(run: Callable[[Inputs], DataFrame]):
        REGISTRY[name] = Query(run, with_ctes(oracle) if oracle else None)
        return run

    return add
