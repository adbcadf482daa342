"""Operators the game computes online (server, client), rebuilt as Spark jobs over the event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators.pairing import ROWS_PER_BUCKET, bucket_width
from tessera.operators.running import running_sum


def leaderboard(moves: DataFrame) -> DataFrame:
    """On each snapped drop a player scores the groups it removed (at least 1); players are ranked per
    puzzle by score. A rank is one more than the number of players with a higher score, and scores are few: the window
    runs over per-(puzzle, score) counts, so a puzzle that holds most players is still a small window."""
    scores = (
        moves.filter((F.col("outcome") == "dropped") & F.col("snapped"))
        .groupBy("puzzle_id", "client_id")
        .agg(F.sum(F.greatest(F.col("merged_groups"), F.lit(1))).cast("long").alias("score"))
    )
    by_score = scores.groupBy(F.struct("puzzle_id").alias("in_puzzle"), "score").agg(F.count("*").alias("players"))
    above = Window.partitionBy("in_puzzle").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_score.select("in_puzzle", "score", (F.coalesce(F.sum("players").over(above), F.lit(0)) + 1).cast("int").alias("rank"))
    return scores.withColumn("in_puzzle", F.struct("puzzle_id")).join(ranks, ["in_puzzle", "score"]).select("puzzle_id", "client_id", "score", "rank")


def room_concurrency(events: DataFrame, bucket_seconds: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Players in the room after each join (+1) and leave (-1), as a running sum per room in event
    order; computed per (room, time bucket) with a carried offset. Without a given width the buckets follow the busiest
    room-day, so that a room that holds most of the log is spread over many tasks."""
    presence = events.filter(F.col("event_type").isin(*C.PRESENCE_EVENTS) & F.col("room_slug").isNotNull())
    delta = F.when(F.col("event_type") == C.PLAYER_JOINED, 1).otherwise(-1).cast("long")
    staged = presence.select("event_id", "room_slug", "occurred_at", "source_id", "event_type", delta.alias("delta"))
    width = bucket_seconds or bucket_width(staged, ["room_slug"], "occurred_at", rows_per_bucket)
    return running_sum(staged, ["room_slug"], ["occurred_at", "source_id"], "delta", "players_in_room", width)


def hold_timeouts(moves: DataFrame, events: DataFrame, timeout_ms: int = C.HOLD_TIMEOUT_MS) -> DataFrame:
    """Per local day and traffic class, the open holds that are older than the lock timeout at the end
    of the log (candidates for a timeout release; drags are not logged, so this is an estimate) beside
    the abandons recorded with reason `timeout`."""
    log_end = events.agg(F.max("occurred_at").alias("log_end")).scalar()
    stale = F.col("grabbed_at") + F.expr(f"INTERVAL {timeout_ms // 1000} SECONDS") <= log_end
    flagged = moves.select(
        "event_date", "traffic_type",
        ((F.col("outcome") == "open") & stale).cast("long").alias("open_candidates"),
        ((F.col("outcome") == "abandoned") & (F.col("abandon_reason") == "timeout")).cast("long").alias("recorded_timeouts"),
    )
    return flagged.groupBy("event_date", "traffic_type").agg(
        F.sum("open_candidates").alias("open_candidates"), F.sum("recorded_timeouts").alias("recorded_timeouts")
    )


def expired_rooms(events: DataFrame, now: Column, ttl_ms: int = C.ROOM_TTL_MS, batch: int | None = None) -> DataFrame:
    """Private rooms idle longer than the TTL at ``now``, oldest activity first, with age and idle time; all of
    them, or at most ``batch`` if the caller works in passes."""
    rooms = events.filter(F.col("room_slug").isNotNull() & (F.col("room_type") == "private")).groupBy("room_slug").agg(
        F.min("occurred_at").alias("created_at"), F.max("occurred_at").alias("last_activity_at")
    )
    ms = lambda a, b: ((F.unix_micros(a) - F.unix_micros(b)) / 1000).cast("long")
    cutoff = now - F.expr(f"INTERVAL {ttl_ms // 1000} SECONDS")
    idle = (
        rooms.filter(F.col("last_activity_at") < cutoff)
        .select("room_slug", "created_at", "last_activity_at",
                ms(now, F.col("created_at")).alias("age_ms"), ms(now, F.col("last_activity_at")).alias("idle_ms"))
        .orderBy("last_activity_at", "room_slug")
    )
    return idle if batch is None else idle.limit(batch)


def friction_counts(events: DataFrame) -> DataFrame:
    """Join failures, grab conflicts and rotations per local day, room type and reason."""
    from tessera.functions import payload

    reason = (
        F.when(F.col("event_type") == C.JOIN_FAILED, payload("error"))
        .when(F.col("event_type") == C.GLOBAL_ROTATED, payload("trigger"))
    )
    return (
        events.filter(F.col("event_type").isin(*C.FRICTION_EVENTS))
        .groupBy("event_date", "room_type", "event_type", reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("client_id").alias("players"))
    )


def queue_heads(items: DataFrame, key: str, order: Sequence[str], k: int = 1, waiting: Column | None = None) -> DataFrame:
    """The first ``k`` waiting items of each key by ``order`` (which must tell all items of a key apart), with their
    ``place`` from 1. The head is an aggregate, ``min`` of a struct, so tasks combine before anything is shuffled and a key of
    any size costs one row for each task; the next places are the heads of what is left, one such pass each (k is small)."""
    queue = items if waiting is None else items.where(waiting)
    rest = [c for c in items.columns if c != key and c not in order]
    packed = F.struct(*order, *rest)
    heads = queue.groupBy(key).agg(F.min(packed).alias("head"))
    out = heads.select(key, F.lit(1).alias("place"), "head.*")
    for place in range(2, k + 1):
        last = heads.select(F.col(key).alias("_key"), F.struct(*[F.col(f"head.{c}") for c in order]).alias("_last"))
        behind = queue.join(last, F.col(key).eqNullSafe(F.col("_key"))).where(F.struct(*order) > F.col("_last"))
        heads = behind.groupBy(key).agg(F.min(packed).alias("head"))
        out = out.unionByName(heads.select(key, F.lit(place).alias("place"), "head.*"))
    return out


def ingest_batches(events: DataFrame, tick_ms: int = 2_000, batch: int = 500) -> DataFrame:
    """The batch that writes each event, by its arrival: the fixed tick it falls in, and within the tick a new batch after
    each ``batch`` events. Columns: event_id, tick, batch_no (from 0). A tick is a bounded stretch of time, so its running
    count is a window over one tick's events."""
    ticked = events.select("event_id", "ingested_at", "source_id", F.floor(F.unix_micros("ingested_at") / F.lit(tick_ms * 1_000)).alias("tick"))
    nth = F.row_number().over(Window.partitionBy("tick").orderBy("ingested_at", "source_id"))
    return ticked.select("event_id", "tick", F.floor((nth - 1) / F.lit(batch)).cast("long").alias("batch_no"))
