"""Streams equal the batch operators on closed input (windows the watermark has passed)."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.plans import silver
from tessera.sources.adapter import bronze_events
from tessera.streaming import streams as Z
from tests.conftest import SF_SMALL


def _run_to_memory(df, name, mode="append"):
    ckpt = tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(600)
    return q


def test_ingest_dedups_and_merges_like_batch(spark):
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-ingest-", dir="/tmp"), "silver")
    bronze = Z.driver_event_stream(spark, SF_SMALL)
    q = Z.ingest(bronze, target, tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp"))
    q.awaitTermination(600)
    got = spark.read.parquet(target)
    want = silver.to_silver_events(bronze_events(spark, SF_SMALL))
    assert got.count() == want.count() == 1000
    assert got.select("event_id").distinct().count() == 1000


def test_daily_activity_stream_equals_batch_on_closed_days(spark):
    ev = Z.silver_stream(Z.driver_event_stream(spark, SF_SMALL))
    q = _run_to_memory(Z.activity(ev), "z2_daily")
    stream = spark.sql("SELECT * FROM z2_daily")
    batch_ev = silver.to_silver_events(bronze_events(spark, SF_SMALL))
    from pyspark.sql import DataFrame

    batch: DataFrame = Z.activity(batch_ev)
    emitted = stream.collect()
    assert Z.late_rows(q) >= 0
    assert q.lastProgress is not None and len(emitted) > 0
    # Every emitted (closed) window equals its batch row.
    assert stream.exceptAll(batch.select(*stream.columns)).count() == 0


def test_inactivity_sessions_stream_equals_batch(spark):
    ev = Z.silver_stream(Z.driver_event_stream(spark, SF_SMALL))
    _run_to_memory(Z.inactivity_sessions(ev, gap="2 hours"), "z3_sessions")
    stream = spark.sql("SELECT * FROM z3_sessions")
    batch = Z.inactivity_sessions(silver.to_silver_events(bronze_events(spark, SF_SMALL)), gap="2 hours")
    assert stream.count() > 0
    assert stream.exceptAll(batch.select(*stream.columns)).count() == 0


MINUTES = 60_000


def _w2_with_timeouts(events, timeout_ms):
    """The batch moves, with holds that nothing answers in time as timeouts."""
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("occurred_at", "source_id")
    following = events.where(F.col("event_type").isin("piece_grabbed", "piece_dropped", "piece_abandoned") & F.col("session_id").isNotNull()).select(
        F.col("event_id").alias("move_id"), F.lead("occurred_at").over(order).alias("next_at"))
    late = F.col("next_at").isNull() | (F.unix_micros("next_at") - F.unix_micros("grabbed_at") > timeout_ms * 1000)
    return silver.build_moves(events).join(following, "move_id").select(
        "move_id", "session_id", "group_id", "grabbed_at", F.when(~late, F.col("ended_at")).alias("ended_at"), F.when(late, "timeout").otherwise(F.col("outcome")).alias("outcome"))


def test_hold_stream_equals_batch_moves_with_timeouts(spark):
    """Every grab of a window that the watermark has passed, with the batch pairing's outcome, ends and open holds included."""
    batch_events = silver.to_silver_events(bronze_events(spark, SF_SMALL))
    for timeout_ms in (30 * MINUTES, 600 * MINUTES):
        q = _run_to_memory(Z.hold_outcomes(Z.silver_stream(Z.driver_event_stream(spark, SF_SMALL)), timeout_ms=timeout_ms), f"z4_holds_{timeout_ms}")
        assert Z.late_rows(q) == 0
        passed = F.to_timestamp(F.lit(q.lastProgress["eventTime"]["watermark"]))
        start = F.window("grabbed_at", f"{timeout_ms} milliseconds")["start"]
        want = _w2_with_timeouts(batch_events, timeout_ms).where(start + F.expr(f"INTERVAL {2 * timeout_ms} MILLISECONDS") <= passed)
        want = want.select("move_id", "session_id", "group_id", "grabbed_at", "ended_at", "outcome")
        got = spark.table(f"z4_holds_{timeout_ms}")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert {r[0] for r in got.select("outcome").distinct().collect()} >= {"timeout", "open"}


HOLDS = """
0     grab    a@r/p id=in-time group_id=1
30    drop    a@r/p group_id=1
40    grab    a@r/p id=too-late group_id=1
70.1  drop    a@r/p group_id=1
80    grab    a@r/p id=other group_id=1
81    drop    a@r/p group_id=2
89    grab    a@r/p id=regrab group_id=2
89    grab    a@r/p id=over-edge group_id=3
91    abandon a@r/p group_id=3
100   grab    a@r/p id=no-group
101   drop    a@r/p
119   grab    b@r/p id=alone group_id=1
120   drop    -@r/p group_id=1
"""
WANT_HOLDS = {"in-time": "dropped", "too-late": "timeout", "other": "open", "regrab": "open", "over-edge": "abandoned", "no-group": "open", "alone": "timeout"}


def test_hold_outcomes_of_a_written_history_in_any_arrival_order(spark, scratch):
    """Answers at and past the timeout, another group's answer, ties, windows' edges, null groups and sockets; the events
    arrive in three batches, later ones first, and one copy twice."""
    from tests import model

    rows = model.events(HOLDS)
    closing = model.events("9000 join z@r")  # moves the watermark past everything
    stored = silver.to_silver_events(model.frame(spark, rows))
    assert {r["move_id"]: r["outcome"] for r in Z.hold_outcomes(stored).collect()} == WANT_HOLDS
    assert Z.hold_outcomes(stored.limit(0)).count() == 0
    for k, part in enumerate((rows[7:], rows[:7] + rows[8:9], [closing[0] | {"id": 99, "event_id": "end", "event_type": "piece_dropped"}])):
        model.frame(spark, part).coalesce(1).write.parquet(f"{scratch}/in/{k}")
    stream = spark.readStream.schema(model.SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    _run_to_memory(Z.hold_outcomes(Z.silver_stream(stream)), "z4_written")
    got = spark.table("z4_written").collect()
    assert len(got) == len(WANT_HOLDS) and {r["move_id"]: r["outcome"] for r in got} == WANT_HOLDS


def test_room_expiries_once_each_and_equal_to_the_expired_rooms(spark, scratch):
    """The stream emits each silence once; the rooms expired at the watermark are those whose last silence was emitted."""
    from tessera.plans import extras
    from tests import model

    hour = 3600
    rows = model.events(f"""
0            join a@quiet
{1 * hour}   join b@back
{2 * hour}   join c@open type=public
{20 * hour}  join a@quiet
{30 * hour}  join d@busy
{40 * hour}  join b@back
{50 * hour}  join d@busy
{60 * hour}  join d@busy
{70 * hour}  join d@busy
""")
    for k, part in enumerate((rows[:4], rows[4:6], rows[6:])):
        model.frame(spark, part).coalesce(1).write.parquet(f"{scratch}/in/{k}")
    stream = spark.readStream.schema(model.SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    q = _run_to_memory(Z.room_expiries(Z.silver_stream(stream)), "z3_rooms")
    got = spark.table("z3_rooms")
    hours = lambda t: (t - model.START).total_seconds() / hour
    assert sorted((r["room_slug"], hours(r["active_from"]), hours(r["last_activity_at"]), hours(r["expired_at"])) for r in got.collect()) == [
        ("back", 1, 1, 25), ("back", 40, 40, 64), ("quiet", 0, 20, 44)]
    events = silver.to_silver_events(model.frame(spark, rows))
    now = F.to_timestamp(F.lit(q.lastProgress["eventTime"]["watermark"]))
    expired = extras.expired_rooms(events, now).select("room_slug", "last_activity_at")
    last = got.groupBy("room_slug").agg(F.max("last_activity_at").alias("last_activity_at"))
    assert sorted(last.collect()) == sorted(expired.collect())


def test_ingest_stores_events_that_come_days_late(spark, scratch):
    """Two files in two batches: the second holds events older than everything before it, and repeated ids."""
    from tests import model

    new = model.events("\n".join(f"{86400 * 5 + k} join a@r" for k in range(20)))
    late = [r | {"event_id": f"late{r['id']}", "id": r["id"] + 100} for r in model.events("\n".join(f"{k} grab b@r/p group_id=1" for k in range(20)))]
    for k, rows in enumerate((new, late + new[:5] + late[:3])):
        model.frame(spark, rows).coalesce(1).write.parquet(f"{scratch}/in/{k}")
    stream = spark.readStream.schema(model.SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    for _ in range(2):
        Z.ingest(stream, f"{scratch}/out", f"{scratch}/ckpt").awaitTermination(600)
    got = [r["event_id"] for r in spark.read.parquet(f"{scratch}/out").collect()]
    assert len(got) == 40 and set(got) == {r["event_id"] for r in new + late}


def test_local_days_follow_the_clock_rule_of_their_year(spark):
    """Before the rule of 2022 the zone kept summer time: a day of July 2021 starts at 05:00 UTC."""
    from datetime import datetime

    from tests import model

    rows = [r | {"occurred_at": datetime(2021, 7, 5, h, 30)} for h, r in zip((4, 5, 23), model.events("0 join a@r\n1 join a@r\n2 join a@r"))]
    got = Z.activity(silver.to_silver_events(model.frame(spark, rows))).orderBy("window_start").collect()
    assert [(r["window_start"].day, r["window_start"].hour, r["events"]) for r in got] == [(4, 5, 1), (5, 5, 2)]
