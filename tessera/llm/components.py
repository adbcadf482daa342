"""Connected components of an edge list, by alternating large and small stars. Every round is a few joins and
aggregations over the edges, cut by a checkpoint; nothing is gathered on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge, the root being its component's least node. Loops and null ends are ignored."""
    now = C.cut(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that the join sees a plain shuffle on both sides, whose hubs Spark's skew handling splits
        least = C.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = C.cut(large)
        low = C.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = C.cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
