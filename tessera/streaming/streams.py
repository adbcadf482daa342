"""Z1-Z4 (see package docstring)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import payload, traffic_type
from tessera.plans.silver import silver_projection, to_silver_events
from tessera.sources.adapter import bronze_from_events
from tessera.sources.events_source import insert_only_merge
from tessera.sources.lake import Lake

def driver_event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The driver's ``events.parquet`` as a file stream, mapped to the bronze shape."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return bronze_from_events(reader.parquet(sf_dir))


def silver_stream(bronze: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Typed events for the windowed streams (Z2-Z4): copies of an event_id are dropped while the first is inside the
    watermark, which also bounds the state. Rows later than the watermark are dropped there; ``late_rows`` counts them.
    ``ingest`` has no watermark and stores every event."""
    deduped = bronze.withWatermark("occurred_at", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return silver_projection(deduped)


def late_rows(query) -> int:
    """Rows that a query's stateful operators have dropped as later than the watermark, over its recent progress."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def ingest(bronze: DataFrame, target_path: str, checkpoint: str):
    """Each micro-batch keeps the first copy of each event_id, drops those the target has (insert-only merge) and
    appends the rest, however late they are. Returns the started query; with ``availableNow`` it stops by itself."""
    spark = bronze.sparkSession
    parent, name = target_path.rstrip("/").rsplit("/", 1)
    parent = Lake(spark, parent)

    def merge(batch: DataFrame, _epoch: int) -> None:
        existing = spark.read.parquet(target_path).select("event_id") if parent.glob(name) else None
        fresh = insert_only_merge(existing, to_silver_events(batch), "event_id")
        fresh.write.mode("append").partitionBy("event_date").parquet(target_path)

    return bronze.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _watermarked(events: DataFrame, watermark: str | None) -> DataFrame:
    """Streams from ``silver_stream`` already carry the event-time watermark; set one only if asked."""
    return events.withWatermark("occurred_at", watermark) if watermark else events


def activity(events: DataFrame, every: str = "1 day", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Events, moves and snaps per window and traffic class (tumbling; sliding with ``slide``). Windows of days are
    the zone's own days, as in batch: the events of a local day (``event_date``), whatever the clock rule of its year.
    They are grouped inside a two-day event-time window that holds the day, so the watermark can close them."""
    marked = _watermarked(events, watermark).withColumn("traffic_type", traffic_type("is_synthetic", "is_bot"))
    counts = [
        F.count(F.lit(1)).alias("events"),
        F.count(F.when(F.col("event_type") == C.PIECE_GRABBED, F.lit(1))).alias("moves"),
        F.count(F.when((F.col("event_type") == C.PIECE_DROPPED) & payload("snapped", "boolean"), F.lit(1))).alias("snaps"),
    ]
    if every == "1 day" and slide is None:
        # Local days start up to a day away from UTC days: the window [start of the zone's day, + 1 day] by event time.
        day_start = F.to_utc_timestamp(F.col("event_date").cast("timestamp"), C.TIME_ZONE)
        day_end = F.to_utc_timestamp(F.date_add("event_date", 1).cast("timestamp"), C.TIME_ZONE)
        inside = marked.withColumn("span", F.window("occurred_at", "2 days", "1 day")).where(
            (F.col("span.start") <= day_start) & (day_start < F.col("span.start") + F.expr("INTERVAL 1 DAY")) & (day_end <= F.col("span.end"))
        )
        grouped = inside.groupBy("span", day_start.alias("window_start"), day_end.alias("window_end"), "traffic_type").agg(*counts)
        return grouped.select("window_start", "window_end", "traffic_type", "events", "moves", "snaps")
    w = F.window("occurred_at", every, slide or every)
    return marked.groupBy(w.alias("window"), "traffic_type").agg(*counts).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "traffic_type", "events", "moves", "snaps",
    )


def _stretches(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Per key, activity that no silence of ``gap`` cuts: key, s (from the first event to ``gap`` after the last), events,
    first_at, last_at. Events of one tumbling window of length ``gap`` are never cut apart, so a stored table is first reduced to
    a row for each (key, window), map side, and a key that holds most of the log costs one row for each ``gap``. A stream has
    its sessions merged before the shuffle instead (``session.settings``)."""
    if events.isStreaming:
        return events.groupBy(F.session_window("occurred_at", gap).alias("s"), key).agg(
            F.count(F.lit(1)).alias("events"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    parts = events.groupBy(key, F.window("occurred_at", gap)).agg(
        F.count(F.lit(1)).alias("events"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    lasts = F.unix_micros(F.col("last_at") + F.expr(f"INTERVAL {gap}")) - F.unix_micros("first_at")
    return parts.groupBy(F.session_window("first_at", F.concat(lasts.cast("string"), F.lit(" microseconds"))).alias("s"), key).agg(
        F.sum("events").alias("events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def inactivity_sessions(events: DataFrame, gap: str = "24 hours", watermark: str | None = None) -> DataFrame:
    """Z3: per player, activity separated by more than ``gap`` of silence."""
    return _stretches(_watermarked(events.filter(F.col("client_id").isNotNull()), watermark), "client_id", gap).select(
        "client_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events", "first_at", "last_at")


def room_expiries(events: DataFrame, watermark: str | None = None, ttl_ms: int = C.ROOM_TTL_MS) -> DataFrame:
    """Z3 for rooms: one row each time a private room has been silent for ``ttl_ms``, once the watermark has passed that moment.
    A room that is used again afterwards expires again at its next silence. As a stream the state is one row for each room in use."""
    used = _watermarked(events.filter(F.col("room_slug").isNotNull() & (F.col("room_type") == "private")), watermark)
    return _stretches(used, "room_slug", f"{ttl_ms} milliseconds").select(
        "room_slug", F.col("first_at").alias("active_from"), F.col("last_at").alias("last_activity_at"), F.col("s.end").alias("expired_at"), "events")


def hold_outcomes(events: DataFrame, watermark: str | None = None, timeout_ms: int = C.HOLD_TIMEOUT_MS) -> DataFrame:
    """Streaming W2 with a hold timeout in event time: what became of each grab within ``timeout_ms``. The socket's next move
    event of that time closes the hold (``dropped``, ``abandoned``) or leaves it ``open``; without one it is a ``timeout``. This
    is the batch pairing with answers later than the timeout left out, whatever the order and the batches of arrival.

    A grab needs only the next ``timeout_ms``, so each event enters two windows of twice that length, begun ``timeout_ms`` apart,
    and a window answers the grabs of its first half from its own sorted events. One aggregate by (window, socket) holds the
    state: a busy socket is spread over its windows, no pairs of events are made and nothing leaves the JVM."""
    moves = _watermarked(
        events.filter(F.col("event_type").isin(*C.MOVE_EVENTS) & F.col("session_id").isNotNull())
        .select("event_id", "session_id", "event_type", "occurred_at", "source_id", payload("group_id", "int").alias("group_id")),
        watermark,
    )
    length = F.expr(f"INTERVAL {timeout_ms} MILLISECONDS")
    line = F.sort_array(F.collect_list(F.struct("occurred_at", "source_id", "event_id", "event_type", "group_id")))
    span = F.window("occurred_at", f"{2 * timeout_ms} milliseconds", f"{timeout_ms} milliseconds").alias("span")
    lines = moves.groupBy(span, "session_id").agg(line.alias("line"))
    turns = F.transform("line", lambda e, i: F.struct(e.alias("grab"), F.get("line", i + 1).alias("nxt")))
    mine = F.filter(turns, lambda t: (t["grab"]["event_type"] == C.PIECE_GRABBED) & (t["grab"]["occurred_at"] < F.col("span.start") + length))
    turn = lines.select("session_id", F.explode(mine).alias("t")).select("session_id", "t.grab", "t.nxt")
    answered = F.coalesce(F.col("nxt.occurred_at") <= F.col("grab.occurred_at") + length, F.lit(False))
    closed = answered & F.coalesce(F.col("nxt.event_type").isin(*C.MOVE_CLOSERS) & (F.col("nxt.group_id") == F.col("grab.group_id")), F.lit(False))
    outcome = F.when(~answered, "timeout").when(~closed, "open").when(F.col("nxt.event_type") == C.PIECE_DROPPED, "dropped").otherwise("abandoned")
    return turn.select(
        F.col("grab.event_id").alias("move_id"), "session_id", F.col("grab.group_id").alias("group_id"), F.col("grab.occurred_at").alias("grabbed_at"),
        F.when(closed, F.col("nxt.occurred_at")).alias("ended_at"), outcome.alias("outcome"),
    )
