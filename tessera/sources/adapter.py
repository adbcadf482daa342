"""Driver table ``events`` (event_id, ts, user_id, event_type, value, props) seen as the game's event log.

A pure projection: every source row becomes one bronze row, so Spark and the SQL oracle can both express it
and the work grows with the table. ``k`` is ``$.k`` of ``props``; ``m`` is ``event_id % 10``; the arrival id
is ``event_id + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C

# --- fixed values: mapping of driver event types to game event types, by m = event_id % 10 ---
#   driver type   m = 0              m = 5              otherwise
TYPE_MAP = {
    "signup": (C.PUZZLE_STARTED, C.ROOM_CREATED, C.PLAYER_JOINED),
    "error": (C.PUZZLE_COMPLETED, C.ROOM_EXPIRED, C.PLAYER_LEFT),
    "click": (C.PIECE_GRABBED, C.PIECE_GRABBED, C.PIECE_GRABBED),
    "purchase": (C.PIECE_DROPPED, C.GLOBAL_ROTATED, C.PIECE_DROPPED),
    "view": (C.GRAB_CONFLICT, C.JOIN_FAILED, C.PIECE_ABANDONED),
}
PIECES = (24, 48, 96, 150)  # by k % 4
SOURCES = ("create", "restart", "queue", "reshuffle", "default")  # by k % 5
LEAVE_REASONS = ("disconnect", "switch")  # by k % 2
ABANDON_REASONS = ("left", "regrab", "timeout")  # by k % 3

BRONZE_COLUMNS = [
    "id", "event_id", "event_type", "schema_version", "occurred_at", "ingested_at", "session_id",
    "client_id", "room_slug", "room_type", "puzzle_id", "payload", "is_synthetic",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: tuple, index: Column) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def _event_type(driver_type: Column, m: Column) -> Column:
    expr = None
    for dtype, (at0, at5, other) in TYPE_MAP.items():
        mapped = F.when(m == 0, at0).when(m == 5, at5).otherwise(other)
        expr = F.when(driver_type == dtype, mapped) if expr is None else expr.when(driver_type == dtype, mapped)
    return expr


def _payload(et: Column, k: Column, value: Column, uid: Column) -> Column:
    """One JSON object per event with only the fields of its type (``to_json`` drops null fields)."""

    def only(types, col):
        types = (types,) if isinstance(types, str) else types
        return F.when(et.isin(*types), col)

    hold = F.round(value * 1000).cast("long")
    duration = F.round(value * 60000).cast("long")
    pieces = _pick(PIECES, k % 4)
    snapped = (k % 2) == 0
    contributor = F.struct(
        F.concat(F.lit("u-"), uid.cast("string")).alias("client_id"),
        F.concat(F.lit("n-"), (k % 10).cast("string")).alias("name"),
        (k + 1).alias("count"),
    )
    fields = [
        only(C.ROOM_CREATED, pieces).alias("pieces_requested"),
        only((C.ROOM_CREATED, C.PUZZLE_STARTED), F.lit(4) + k % 3).alias("rows"),
        only((C.ROOM_CREATED, C.PUZZLE_STARTED), F.lit(6) + k % 5).alias("cols"),
        only(C.ROOM_CREATED, F.lit(640) + k).alias("image_width"),
        only(C.ROOM_CREATED, F.lit(480) + k).alias("image_height"),
        only((C.PUZZLE_STARTED, C.PUZZLE_COMPLETED), pieces).alias("pieces"),
        only((C.PUZZLE_STARTED, C.GLOBAL_ROTATED), _pick(SOURCES, k % 5)).alias("source"),
        only(C.PLAYER_JOINED, F.concat(F.lit("n-"), (k % 10).cast("string"))).alias("name"),
        only(C.PLAYER_JOINED, F.concat(F.lit("#c"), (k % 10).cast("string"))).alias("color"),
        only((C.PLAYER_JOINED, C.PLAYER_LEFT, C.PUZZLE_COMPLETED), F.lit(1) + k % 8).alias("players_in_room"),
        only(C.JOIN_FAILED, F.lit("room_full")).alias("error"),
        only(C.PLAYER_LEFT, _pick(LEAVE_REASONS, k % 2))
        .when(et == C.PIECE_ABANDONED, _pick(ABANDON_REASONS, k % 3))
        .alias("reason"),
        only((C.PLAYER_LEFT, C.PUZZLE_COMPLETED), duration).alias("duration_ms"),
        only((C.PIECE_GRABBED, C.GRAB_CONFLICT, C.PIECE_DROPPED, C.PIECE_ABANDONED), k % 3).alias("group_id"),
        only((C.PIECE_GRABBED, C.PIECE_DROPPED), F.lit(1) + k % 5).alias("group_size"),
        only(C.GRAB_CONFLICT, hold).alias("held_ms"),
        only((C.PIECE_DROPPED, C.PIECE_ABANDONED), hold).alias("hold_ms"),
        only(C.PIECE_DROPPED, snapped).alias("snapped"),
        only(C.PIECE_DROPPED, (k % 4) == 0).alias("frame"),
        only(C.PIECE_DROPPED, F.when(snapped, 1).otherwise(0)).alias("merged_groups"),
        only(C.PUZZLE_COMPLETED, F.array_repeat(contributor, (F.lit(1) + k % 3).cast("int"))).alias("contributors"),
        only(C.GLOBAL_ROTATED, F.when(k % 2 == 0, "auto").otherwise("admin")).alias("trigger"),
        only(C.ROOM_EXPIRED, F.round(value * 3_600_000).cast("long")).alias("age_ms"),
        only(C.ROOM_EXPIRED, F.round(value * 60_000).cast("long")).alias("idle_ms"),
    ]
    return F.to_json(F.struct(*fields))


def bronze_from_events(events: DataFrame, dup_key: bool = False) -> DataFrame:
    """Bronze-shaped rows (13 source columns). With ``dup_key`` every 20th row repeats the event_id of
    the row before it, giving the dedup, merge and skip-duplicate operators real copies to resolve."""
    uid = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    m = F.col("event_id") % 10
    occurred = F.col("ts").cast("timestamp")
    et = _event_type(F.col("event_type"), m)
    room = F.concat(F.lit("r-"), (uid % 8).cast("string"))
    key = F.col("event_id")
    if dup_key:
        key = F.when(F.col("event_id") % 20 == 19, F.col("event_id") - 1).otherwise(F.col("event_id"))
    staged = events.select(
        # Arrival ids start at 1, like a bigserial: watermark 0 means "nothing loaded yet".
        (F.col("event_id") + 1).alias("id"),
        key.cast("string").alias("event_id"),
        et.alias("event_type"),
        F.lit(1).alias("schema_version"),
        occurred.alias("occurred_at"),
        (occurred + F.expr("INTERVAL '0.300' SECOND")).alias("ingested_at"),
        F.concat(F.lit("s-"), uid.cast("string")).alias("session_id"),
        F.concat(F.when(uid % 5 == 0, F.lit("bot-")).otherwise(F.lit("u-")), uid.cast("string")).alias("client_id"),
        room.alias("room_slug"),
        F.when(uid % 8 == 0, "global").otherwise("private").alias("room_type"),
        F.concat(room, F.lit(":"), F.date_format(occurred, "yyyyMMdd")).alias("puzzle_id"),
        _payload(et, k, F.col("value"), uid).alias("payload"),
        ((uid % 7) == 0).alias("is_synthetic"),
    )
    return staged


def bronze_events(spark: SparkSession, sf_dir: str, dup_key: bool = False) -> DataFrame:
    return bronze_from_events(read_table(spark, sf_dir, "events"), dup_key=dup_key)
