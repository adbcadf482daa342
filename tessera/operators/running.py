"""Running sums per key that do not put a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.pairing import pack_key, time_bucket


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    out: str,
    bucket_seconds: int | None = 86400,
) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same keys up to and including this row in ``order_by``.

    The scan runs per (key, time bucket of ``order_by[0]``); each bucket adds the total of the key's earlier
    buckets, taken from a per-bucket summary (one row per key and bucket)."""
    order_by = list(order_by)
    staged = df.withColumn("_pk", pack_key(list(keys))).withColumn("_b", time_bucket(order_by[0], bucket_seconds))
    w = Window.partitionBy("_pk", "_b").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = staged.withColumn("_run", F.sum(value).over(w))
    totals = staged.groupBy("_pk", "_b").agg(F.sum(value).alias("_tot"))
    before = Window.partitionBy("_pk").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pk", "_b", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    return within.join(offsets, ["_pk", "_b"], "inner").select(
        *df.columns, (F.col("_off") + F.col("_run")).cast("long").alias(out)
    )
