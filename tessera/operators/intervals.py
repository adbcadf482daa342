"""Interval statistics: for each interval [start, end] of a key, aggregate the points of the same key that
fall inside it (both ends inclusive, a null end means open).

The direct form is a range join on the key: every interval meets every point of its key, so a long-lived key with many intervals and many points emits all pairs before the range filter.
``interval_stats`` gives the same answer without pairs, for intervals made by pairing consecutive events of a
key (closed intervals of one key never overlap except at shared endpoints; open ones may overlap freely):

* closed intervals: each point belongs to the latest closed interval that starts strictly before it (an
  as-of lookup) and to the intervals that start exactly at its time (an equi-join on (key, time) against
  *distinct* intervals, of which at most two share a start). Points then aggregate per interval with any
  aggregate, distinct counts included.
* open intervals [a, inf): sums are suffix sums (total minus prefix strictly before ``a``), and a distinct
  count is the number of distinct values whose *last* point is at or after ``a``.

Prefix sums and as-of lookups run per (key, time bucket) with a small per-bucket carry, so a hot key is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.pairing import pack_key, time_bucket

_UNB = Window.unboundedPreceding

# Stream row kinds, in their order at equal times: an open interval start sees only points strictly
# before it; a point sees only closed intervals that started strictly before it.
_OPEN, _POINT, _CLOSED = 0, 1, 2


def interval_stats(
    intervals: DataFrame,
    points: DataFrame,
    *,
    id_col: str,
    keys: Sequence[str],
    start: str,
    end: str,
    time: str,
    count_col: str,
    sums: dict[str, str],
    distinct: tuple[str, str] | None,
    bucket_seconds: int | None = 86400,
) -> DataFrame:
    """Per interval ``id_col``: count of non-null ``count_col`` points, ``sums`` {out: point column},
    and ``distinct`` (out, point column) distinct count. Intervals or points with a null key or time match
    nothing. Intervals with no points get 0 everywhere.

    One ordered stream per (key, time bucket) carries points, open-interval starts, closed-interval starts
    and, for the distinct count, the last point of each distinct value. A single window pass gives each
    point its latest closed interval (as-of) and each open start its prefix sums; a per-bucket summary
    carries both across buckets.
    """
    keys = list(keys)
    ok_i, ok_p = F.col(start).isNotNull(), F.col(time).isNotNull()
    for k in keys:
        ok_i, ok_p = ok_i & F.col(k).isNotNull(), ok_p & F.col(k).isNotNull()
    iv = intervals.filter(ok_i).select(id_col, start, end, pack_key(keys).alias("_pk"))
    dcol = distinct[1] if distinct else None
    pay_cols = list(dict.fromkeys([time, count_col, *sums.values(), *([dcol] if dcol else [])]))
    pts = points.filter(ok_p).select(pack_key(keys).alias("_pk"), F.col(time).alias("_t"),
                                     F.struct(*[F.col(c) for c in pay_cols]).alias("_pl"))

    values = {"_cnt": F.col(f"_pl.{count_col}").isNotNull().cast("long")}
    for out, src in sums.items():
        values[f"_s_{out}"] = F.coalesce(F.col(f"_pl.{src}").cast("long"), F.lit(0).cast("long"))
    values["_last"] = F.lit(0).cast("long")
    zeros = {c: F.lit(0).cast("long") for c in values}
    iv_type = f"struct<_a:{iv.schema[start].dataType.simpleString()},_e:{iv.schema[end].dataType.simpleString()}>"
    pl_type = pts.schema["_pl"].dataType

    closed_iv = iv.filter(F.col(end).isNotNull()).select("_pk", F.col(start).alias("_a"), F.col(end).alias("_e")).distinct()
    open_starts = iv.filter(F.col(end).isNull()).select("_pk", F.col(start).alias("_t")).distinct()

    def rows(df: DataFrame, kind: int, iv_col: Column, pl_col: Column, vals: dict[str, Column]) -> DataFrame:
        return df.select("_pk", "_t", F.lit(kind).alias("_kind"), iv_col.alias("_iv"), pl_col.alias("_pl"),
                         *[v.alias(c) for c, v in vals.items()])

    no_iv, no_pl = F.lit(None).cast(iv_type), F.lit(None).cast(pl_type)
    parts = [
        rows(pts, _POINT, no_iv, F.col("_pl"), values),
        rows(open_starts, _OPEN, no_iv, no_pl, zeros),
        rows(closed_iv.withColumnRenamed("_a", "_t").withColumn("_a", F.col("_t")), _CLOSED,
             F.struct(F.col("_a"), F.col("_e")), no_pl, zeros),
    ]
    if distinct:
        lasts = pts.groupBy("_pk", F.col(f"_pl.{dcol}").alias("_d")).agg(F.max("_t").alias("_t")).filter(F.col("_d").isNotNull())
        parts.append(rows(lasts, _POINT, no_iv, no_pl, {**zeros, "_last": F.lit(1).cast("long")}))
    stream = parts[0]
    for p in parts[1:]:
        stream = stream.unionByName(p)
    stream = stream.withColumn("_b", time_bucket("_t", bucket_seconds))

    vals = list(values)
    # Of closed intervals that start together (a zero-length one and a longer one) the longest comes last, so the
    # as-of row and the bucket's carry are the one that can still hold later points.
    w = Window.partitionBy("_pk", "_b").orderBy("_t", "_kind", F.col("_iv._e")).rowsBetween(_UNB, Window.currentRow)
    scanned = stream.select(
        "_pk", "_b", "_t", "_kind", "_pl",
        F.last("_iv", ignorenulls=True).over(w).alias("_iv_in"),
        *[F.sum(v).over(w).alias(f"_run{v}") for v in vals],
    ).filter((F.col("_kind") == _OPEN) | F.col("_pl").isNotNull())
    summary = stream.groupBy("_pk", "_b").agg(
        F.max_by("_iv", F.when(F.col("_iv").isNotNull(), F.struct("_t", "_kind", F.col("_iv._e")))).alias("_bl"),
        *[F.sum(v).alias(f"_tot{v}") for v in vals],
    )
    before = Window.partitionBy("_pk").orderBy("_b").rowsBetween(_UNB, -1)
    whole = Window.partitionBy("_pk")
    carry = summary.select(
        "_pk", "_b",
        F.last("_bl", ignorenulls=True).over(before).alias("_carry"),
        *[F.coalesce(F.sum(f"_tot{v}").over(before), F.lit(0)).alias(f"_off{v}") for v in vals],
        *[F.sum(f"_tot{v}").over(whole).alias(f"_all{v}") for v in vals],
    )
    scanned = scanned.join(carry, ["_pk", "_b"], "inner")

    # closed intervals: memberships (as-of strictly before + exact start), then ordinary aggregates
    hit = F.coalesce(F.col("_iv_in"), F.col("_carry"))
    asof = scanned.filter((F.col("_kind") == _POINT) & hit.isNotNull() & (F.col("_t") <= hit["_e"])).select(
        "_pk", hit["_a"].alias("_a"), hit["_e"].alias("_e"), "_pl")
    at_start = (
        pts.join(closed_iv, (pts["_pk"] == closed_iv["_pk"]) & (pts["_t"] == closed_iv["_a"]), "inner")
        .filter(pts["_t"] <= closed_iv["_e"])
        .select(pts["_pk"], closed_iv["_a"], closed_iv["_e"], pts["_pl"])
    )
    members = asof.unionByName(at_start)
    aggs = [F.count(f"_pl.{count_col}").alias("_cnt")] + [F.sum(f"_pl.{src}").cast("long").alias(o) for o, src in sums.items()]
    if distinct:
        aggs.append(F.countDistinct(f"_pl.{dcol}").alias(distinct[0]))
    closed = members.groupBy("_pk", "_a", "_e").agg(*aggs).withColumnRenamed("_a", start).withColumnRenamed("_e", end)
    outs = ["_cnt", *sums.keys(), *([distinct[0]] if distinct else [])]
    closed_stats = iv.filter(F.col(end).isNotNull()).join(closed, ["_pk", start, end], "inner").select(id_col, *outs)

    # open intervals: suffix = key total - prefix strictly before the start
    suffix = scanned.filter(F.col("_kind") == _OPEN).select(
        "_pk", F.col("_t").alias(start),
        (F.col("_all_cnt") - F.col("_off_cnt") - F.col("_run_cnt")).alias("_cnt"),
        *[(F.col(f"_all_s_{o}") - F.col(f"_off_s_{o}") - F.col(f"_run_s_{o}")).alias(o) for o in sums],
        *([(F.col("_all_last") - F.col("_off_last") - F.col("_run_last")).alias(distinct[0])] if distinct else []),
    )
    open_stats = iv.filter(F.col(end).isNull()).join(suffix, ["_pk", start], "inner").select(id_col, *outs)

    stats = closed_stats.unionByName(open_stats)
    result = intervals.select(id_col).join(stats, id_col, "left")
    return result.select(id_col, *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in outs])
