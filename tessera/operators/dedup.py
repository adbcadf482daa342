"""Keep-first deduplication and duplicate-key counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Keeps, per ``key``, the row with the smallest ``order`` (ties broken by the next order column).

    Written as an aggregate (``min_by`` over a struct of the row) rather than ``row_number`` over a
    window: the aggregate combines map-side, so a key with millions of copies is collapsed inside each
    input task before the shuffle instead of landing whole in one window partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    row = F.struct(*[F.col(c) for c in df.columns])
    ordering = F.struct(*[F.col(c) for c in orders]) if len(orders) > 1 else F.col(orders[0])
    return df.groupBy(*keys).agg(F.min_by(row, ordering).alias("_row")).select("_row.*")


def duplicate_key_count(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: number of key values that occur more than once."""
    keys = [key] if isinstance(key, str) else list(key)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)).alias("duplicate_keys"))
    )
