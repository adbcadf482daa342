"""Name -> Spark query (spark, sf_dir) -> DataFrame, and name -> oracle SQL. Consumed by __spark_entry__.py.

Every query reads the driver's tables through the adapter. The silver stages that many queries share are built once for
each input folder and kept as Parquet in the checkpoint folder; everything above them is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from tessera.plans import queries  # noqa: F401
