"""Exact continuous percentile (percentile_cont) per group without a per-group value buffer.

``percentile`` keeps a map of every distinct value per group in one aggregation buffer: a global KPI over
billions of sessions puts all distinct durations into one task. Here:

1. a histogram of log-scale value buckets per group (map-side combined; at most a few thousand buckets per
   group, however many rows);
2. the cumulative bucket counts locate the bucket(s) holding the two ranks around ``p * (n - 1)``;
3. only rows in those buckets are ranked exactly (distinct values with counts), and the result
   interpolates as ``percentile_cont`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNB = Window.unboundedPreceding


def _log_bucket(v: Column, resolution: int) -> Column:
    """Monotone bucket: sign(v) * floor(log2(|v| + 1) * resolution)."""
    mag = F.floor(F.log2(F.abs(v) + 1) * resolution)
    return F.when(v < 0, -mag).otherwise(mag).cast("long")


def exact_percentile(df: DataFrame, groups: Sequence[str], value: str, p: float, out: str,
                     resolution: int = 64) -> DataFrame:
    """One row per group with at least one non-null value: ``out`` = percentile_cont(p) of ``value``."""
    groups = list(groups)
    base = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    base = base.withColumn("_b", _log_bucket(F.col("_v"), resolution))

    hist = base.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(*groups)
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(_UNB, -1)
    hist = hist.select(*groups, "_b", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_cb"),
                       F.sum("_c").over(wg).alias("_n"))
    pos = (F.col("_n") - 1) * F.lit(float(p))
    ranks = hist.select(*groups, "_b", "_c", "_cb", "_n",
                        F.floor(pos).cast("long").alias("_lo"), F.ceil(pos).cast("long").alias("_hi"), pos.alias("_pos"))
    holds = (F.col("_cb") <= F.col("_lo")) & (F.col("_lo") < F.col("_cb") + F.col("_c")) | (
        (F.col("_cb") <= F.col("_hi")) & (F.col("_hi") < F.col("_cb") + F.col("_c")))
    targets = ranks.filter(holds)  # at most two buckets per group

    # Exact ranks inside the target buckets only.
    vals = base.join(targets.select(*groups, "_b"), [*groups, "_b"], "left_semi").groupBy(*groups, "_b", "_v").agg(
        F.count(F.lit(1)).alias("_k"))
    wb = Window.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(_UNB, -1)
    vals = vals.withColumn("_kb", F.coalesce(F.sum("_k").over(wb), F.lit(0)))
    located = vals.join(targets, [*groups, "_b"], "inner").select(
        *groups, "_v", "_lo", "_hi", "_pos",
        (F.col("_cb") + F.col("_kb")).alias("_start"), (F.col("_cb") + F.col("_kb") + F.col("_k")).alias("_end"))
    at = lambda r: (F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_end"))
    picked = located.groupBy(*groups).agg(
        F.max(F.when(at("_lo"), F.col("_v"))).alias("_vlo"), F.max(F.when(at("_hi"), F.col("_v"))).alias("_vhi"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_pos").alias("_pos"))
    lo, hi, pos = F.col("_lo"), F.col("_hi"), F.col("_pos")
    res = F.when(lo == hi, F.col("_vlo")).otherwise((hi - pos) * F.col("_vlo") + (pos - lo) * F.col("_vhi"))
    return picked.select(*groups, res.alias(out))
