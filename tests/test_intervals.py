"""Property tests: the pair-free interval statistics and the bucketed scans equal their brute-force forms
on random histories (many overlapping open sessions, equal timestamps, zero-length sessions)."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import open_end
from tessera.operators.intervals import interval_stats
from tessera.operators.running import running_sum
from tessera.plans import silver
from tests.model import SCHEMA as BRONZE_SCHEMA

def range_join(
    intervals, points, *, id_col, keys, start, end, time, count_col, sums, distinct):
    """Brute force: every interval meets every point of its key in an inclusive range join."""
    i, p = intervals.alias("i"), points.alias("p")
    cond = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys]
    cond += [F.col(f"p.{time}") >= F.col(f"i.{start}"), F.col(f"p.{time}") <= open_end(F.col(f"i.{end}"))]
    aggs = [F.count(F.col(f"p.{count_col}")).alias("_cnt")]
    aggs += [F.sum(F.col(f"p.{src}").cast("long")).alias(out) for out, src in sums.items()]
    if distinct:
        aggs.append(F.countDistinct(F.col(f"p.{distinct[1]}")).alias(distinct[0]))
    stats = i.join(p, cond, "left").groupBy(F.col(f"i.{id_col}").alias(id_col)).agg(*aggs)
    outs = ["_cnt", *sums.keys(), *([distinct[0]] if distinct else [])]
    return stats.select(id_col, *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in outs])


BASE = datetime(2026, 1, 1)
KINDS = ["player_joined", "player_left", "piece_grabbed", "piece_dropped", "piece_abandoned"]

history = st.lists(
    st.tuples(
        st.sampled_from(["s1", "s2"]),           # socket
        st.sampled_from(["r1", "r2", None]),     # room
        st.integers(0, 40),                      # time step (many ties)
        st.sampled_from(KINDS),
        st.integers(0, 2),                       # group
        st.sampled_from(["p1", "p2", "p3", None]),
    ),
    min_size=1,
    max_size=60,
)


def _bronze(spark, rows, step_seconds):
    out = []
    for i, (sock, room, t, kind, group, puzzle) in enumerate(rows, start=1):
        ts = BASE + timedelta(seconds=t * step_seconds)
        payload = f'{{"group_id": {group}, "snapped": {"true" if i % 2 else "false"}, "merged_groups": {i % 2}}}'
        out.append((i, f"e{i}", kind, 1, ts, ts, sock, "c-" + sock, room, "private", puzzle, payload, False))
    return spark.createDataFrame(out, BRONZE_SCHEMA)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=history, step=st.sampled_from([1, 1800, 7200]))
def test_interval_stats_equal_range_join(spark, rows, step):
    evs = silver.to_silver_events(_bronze(spark, rows, step)).cache()
    moves = silver.build_moves(evs, bucket_seconds=3600)
    sessions = silver.pair_sessions(evs, bucket_seconds=3600)
    kw = dict(id_col="session_key", keys=["session_id", "room_slug"], start="joined_at", end="left_at",
              time="grabbed_at", count_col="move_id", sums={"snaps": "snap_i", "groups_merged": "merged_groups"},
              distinct=("puzzles_played", "puzzle_id"))
    pts = moves.withColumn("snap_i", F.col("snapped").cast("int"))
    brute = range_join(sessions, pts, **kw)
    for b in (None, 3600):
        fast = interval_stats(sessions, pts, bucket_seconds=b, **kw)
        assert sorted(brute.collect()) == sorted(fast.collect())
    plain_moves = silver.build_moves(evs, bucket_seconds=None)
    assert sorted(plain_moves.collect()) == sorted(moves.collect())
    evs.unpersist()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=history)
def test_running_sum_equals_window(spark, rows):
    from pyspark.sql import Window

    df = _bronze(spark, rows, 1800).select("id", "room_slug", "occurred_at", (F.col("id") % 3 - 1).alias("v"))
    got = running_sum(df, ["room_slug"], ["occurred_at", "id"], "v", "run", bucket_seconds=3600)
    w = Window.partitionBy("room_slug").orderBy("occurred_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("v").over(w).cast("long"))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.tuples(st.sampled_from(["a", "b", "c"]),
                                 st.one_of(st.none(), st.integers(-5000, 10**9))), min_size=1, max_size=80),
       p=st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_exact_percentile_equals_percentile(spark, values, p):
    from tessera.operators.quantile import exact_percentile

    df = spark.createDataFrame(values, "g string, v long")
    got = {r["g"]: r["q"] for r in exact_percentile(df, ["g"], "v", p, "q").collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", p).alias("q")).collect() if r["q"] is not None}
    assert set(got) == set(want)
    for g in want:
        assert abs(got[g] - want[g]) <= 1e-9 * max(1.0, abs(want[g])), (g, got[g], want[g])
