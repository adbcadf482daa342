"""Next-event pairing: attach to each row the next row of its partition, then keep the openers.

``lead`` over a window partitioned by an entity key puts every row of one entity into one task. For a
hot entity (one socket with a third of all events) that task is the whole job. ``lead_struct`` with
``bucket_seconds`` splits each entity by a time bucket: ``lead`` runs inside (entity, bucket), and the
last row of each bucket borrows the first row of the entity's next non-empty bucket from a small
per-bucket summary. The answer is the same as the plain window because the bucket is a monotone function
of the first ordering column.

The entity key is packed into one struct column ``_pk``: struct equality treats null fields as equal
(as window partitioning does), so the summary joins back with a plain equi-join on (``_pk``, ``_b``)
and reuses the window's hash partitioning instead of shuffling the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(ts: Column | str, bucket_seconds: int | None) -> Column:
    if not bucket_seconds:
        return F.lit(0).cast("long")
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col) / F.lit(bucket_seconds * 1_000_000)).cast("long")


#: Rows of one key that a window task should hold at most, on the key's busiest day.
ROWS_PER_BUCKET = 1_000_000
DAY = 86_400


def bucket_width(df: DataFrame, keys: Sequence[str], ts: str, rows: int = ROWS_PER_BUCKET) -> int:
    """Bucket width in seconds for windows over ``keys``: a day, or as much less as the busiest key needs so that none of
    its buckets holds more than ``rows`` (a second at least). Counts over the keys and times decide, usually once."""
    width = DAY
    while width > 1:
        busiest = df.groupBy(pack_key(keys).alias("_pk"), time_bucket(ts, width).alias("_b")).count().agg(F.max("count")).first()[0] or 0
        if busiest <= rows:
            break
        width = max(1, width // math.ceil(busiest / rows))
    return width


def pack_key(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def lead_struct(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    carry: Sequence[str],
    out: str = "next",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Adds ``out`` = struct(carry) of the next row in (partition_by) ordered by (order_by)."""
    partition_by, order_by = list(partition_by), list(order_by)
    packed = F.struct(*[F.col(c) for c in carry])
    if not bucket_seconds:
        w = Window.partitionBy(*partition_by).orderBy(*order_by)
        return df.withColumn(out, F.lead(packed).over(w))

    staged = df.withColumn("_pk", pack_key(partition_by)).withColumn("_b", time_bucket(order_by[0], bucket_seconds))
    w = Window.partitionBy("_pk", "_b").orderBy(*order_by)
    within = staged.withColumn(out, F.lead(packed).over(w)).withColumn("_rn", F.row_number().over(w))
    # Bucket heads come from the same window pass (row 1 of each bucket): no extra shuffle of the rows.
    heads = within.filter(F.col("_rn") == 1).select("_pk", "_b", packed.alias("_head"))
    wb = Window.partitionBy("_pk").orderBy("_b")
    nxt = heads.select("_pk", "_b", F.lead("_head").over(wb).alias("_next_head"))
    joined = within.join(nxt, ["_pk", "_b"], "left")
    return joined.select(*df.columns, F.coalesce(F.col(out), F.col("_next_head")).alias(out))
