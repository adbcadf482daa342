"""Data-quality gates as one DataFrame of check rows (name, severity, passed, value, detail).

Q1-Q4 come from one aggregate over silver (grouped by event_id) and one over bronze; after an append, from
the new rows and their collisions with committed ids only. The others come from one aggregate each. Error checks gate publishing; warn checks are recorded only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import ratio_half_up
from tessera.operators.intervals import interval_stats
from tessera.operators.pairing import lead_struct
from tessera.plans.silver import OPEN_MOVES

# --- fixed values: check names, severities and thresholds ---------------------------------
UNIQUE_EVENT_ID = "silver_events_unique_event_id"
REQUIRED_FIELDS = "silver_events_required_fields"
NOT_IN_FUTURE = "silver_events_not_in_future"
RECONCILE = "bronze_silver_reconciliation"
UNIQUE_PUZZLE = "fact_puzzle_unique_puzzle_id"
MOVES_RESOLVED = "moves_resolved_in_finished_sessions"
MERGE_COUNT = "completed_puzzles_merge_count"
COUNTS_MATCH = "warehouse_row_counts_match_gold"
MOVES_RESOLVED_MAX = 0.01
MERGE_COUNT_MAX = 0.02

CHECK_SCHEMA = "name string, severity string, passed boolean, value double, detail string"


def _row(name: str, severity: str, passed: Column, value: Column, detail: str) -> list[Column]:
    return [
        F.lit(name).alias("name"), F.lit(severity).alias("severity"), passed.alias("passed"),
        value.cast("double").alias("value"), F.lit(detail).alias("detail"),
    ]


def event_checks(bronze: DataFrame, events: DataFrame, now: Column | None = None) -> DataFrame:
    """Q1-Q4. ``now`` defaults to the current time; pass a column (e.g. the last ingest time) to make
    the check reproducible."""
    now = now if now is not None else F.current_timestamp()
    late = F.col("occurred_at") > now + F.expr(f"INTERVAL {C.FUTURE_TOLERANCE_MINUTES} MINUTES")
    missing = F.col("event_type").isNull() | F.col("occurred_at").isNull() | F.col("event_id").isNull()
    per_key = events.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(missing.cast("long")).alias("missing"),
        F.sum(F.coalesce(late, F.lit(False)).cast("long")).alias("late"),
    )
    silver = per_key.select(
        (F.col("n") > 1).cast("long").alias("dup"), F.col("n").alias("rows"), "missing", "late",
        F.lit(0).cast("long").alias("bronze_ids"),
    )
    bronze_ids = bronze.select("event_id").distinct().select(
        *[F.lit(0).cast("long").alias(c) for c in ("dup", "rows", "missing", "late")],
        F.lit(1).cast("long").alias("bronze_ids"),
    )
    t = silver.unionByName(bronze_ids).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in silver.columns])
    diff = F.col("rows") - F.col("bronze_ids")
    rows = [
        _row(UNIQUE_EVENT_ID, "error", F.col("dup") == 0, F.col("dup"), "ids that several rows hold"),
        _row(REQUIRED_FIELDS, "error", F.col("missing") == 0, F.col("missing"),
             "rows without an id, a type or a time"),
        _row(NOT_IN_FUTURE, "error", F.col("late") == 0, F.col("late"), "rows dated beyond the tolerated clock"),
        _row(RECONCILE, "error", diff == 0, diff, "kept rows less extracted ids"),
    ]
    # All four rows from the one aggregate row (no re-evaluation per check).
    return t.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("c")).select("c.*")


def event_checks_incremental(old_bronze: DataFrame, new_bronze: DataFrame, old_events: DataFrame,
                             inserted: DataFrame, now: Column | None = None) -> DataFrame:
    """Q1-Q4 after an append, with the same values as ``event_checks`` over the whole tables.

    The committed tables passed Q1-Q4 when they were published (error checks gate every commit), so the
    committed silver ids are unique, complete and not late, and their count equals the distinct
    committed bronze ids (so that count cancels out of Q4). Only the new rows and their collisions with
    committed ids remain. The committed ids are scanned once in a semi-join with the new ids, whose side Spark
    broadcasts if it is small, instead of grouping every event_id of the log.
    """
    now = now if now is not None else F.current_timestamp()
    late = F.col("occurred_at") > now + F.expr(f"INTERVAL {C.FUTURE_TOLERANCE_MINUTES} MINUTES")
    missing = F.col("event_type").isNull() | F.col("occurred_at").isNull() | F.col("event_id").isNull()
    new_ids = new_bronze.select("event_id").distinct()
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")

    # Q1: id values seen more than once among the inserted rows plus the committed rows sharing their ids.
    colliding = old_events.select("event_id").join(new_ids, "event_id", "left_semi")
    per_key = inserted.select("event_id").unionByName(colliding).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    dup = per_key.select((F.col("n") > 1).cast("long").alias("dup"), *[zero.alias(c) for c in
                         ("rows", "missing", "late", "new_ids", "known_ids")])
    # Q2, Q3 on the inserted rows; Q4 parts: inserted rows, new distinct ids, new ids already in bronze.
    fresh = inserted.select(zero.alias("dup"), one.alias("rows"), missing.cast("long").alias("missing"),
                            F.coalesce(late, F.lit(False)).cast("long").alias("late"), zero.alias("new_ids"),
                            zero.alias("known_ids"))
    distinct_new = new_ids.select(*[zero.alias(c) for c in ("dup", "rows", "missing", "late")], one.alias("new_ids"),
                                  zero.alias("known_ids"))
    known = old_bronze.select("event_id").join(new_ids, "event_id", "left_semi").distinct().select(
        *[zero.alias(c) for c in ("dup", "rows", "missing", "late", "new_ids")], one.alias("known_ids"))
    t = dup.unionByName(fresh).unionByName(distinct_new).unionByName(known).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in dup.columns])
    # silver rows - distinct bronze ids = (prior + inserted) - (prior + new ids not yet in bronze)
    diff = F.col("rows") - (F.col("new_ids") - F.col("known_ids"))
    rows = [
        _row(UNIQUE_EVENT_ID, "error", F.col("dup") == 0, F.col("dup"), "ids that several rows hold"),
        _row(REQUIRED_FIELDS, "error", F.col("missing") == 0, F.col("missing"),
             "rows without an id, a type or a time"),
        _row(NOT_IN_FUTURE, "error", F.col("late") == 0, F.col("late"), "rows dated beyond the tolerated clock"),
        _row(RECONCILE, "error", diff == 0, diff, "kept rows less extracted ids"),
    ]
    return t.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("c")).select("c.*")


def puzzle_unique_check(f_puzzle: DataFrame) -> DataFrame:
    """Q5."""
    dup = f_puzzle.groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("dup")
    )
    return dup.select(*_row(UNIQUE_PUZZLE, "error", F.col("dup") == 0, F.col("dup"), "puzzles with several fact rows"))


def open_moves_in_finished_sessions(moves: DataFrame, sessions: DataFrame) -> DataFrame:
    """Number of (open move, finished session) pairs with the grab inside the session, counted with the
    pair-free interval operator. One row: pairs, moves."""
    finished = sessions.filter(F.col("left_at").isNotNull()).select("session_key", "session_id", "room_slug", "joined_at", "left_at")
    opened = moves.filter(F.col("outcome") == "open").select("session_id", "room_slug", "grabbed_at", "move_id")
    stats = interval_stats(
        finished, opened, id_col="session_key", keys=["session_id", "room_slug"], start="joined_at", end="left_at",
        time="grabbed_at", count_col="move_id", sums={}, distinct=None,
    )
    pairs = stats.agg(F.coalesce(F.sum("_cnt"), F.lit(0)).cast("long").alias("pairs"), F.lit(0).cast("long").alias("moves"))
    total = moves.agg(F.lit(0).cast("long").alias("pairs"), F.count(F.lit(1)).alias("moves"))
    return pairs.unionByName(total).agg(F.sum("pairs").alias("pairs"), F.sum("moves").alias("moves"))


def _resolved_row(counts: DataFrame) -> DataFrame:
    share = ratio_half_up("pairs", F.greatest(F.col("moves"), F.lit(1)), 5)
    return counts.select(*_row(MOVES_RESOLVED, "warn", share <= MOVES_RESOLVED_MAX, share,
                               "open grabs of ended visits, per grab"))


def moves_resolved_check(moves: DataFrame, sessions: DataFrame) -> DataFrame:
    """Q6: share of grabs left open although the player's session finished (<= 1 %)."""
    return _resolved_row(open_moves_in_finished_sessions(moves, sessions))


def moves_resolved_check_counted(moves: DataFrame, sessions: DataFrame) -> DataFrame:
    """Q6 where each session carries its number of open moves: two sums, without meeting sessions and moves again."""
    ended = sessions.agg(F.coalesce(F.sum(F.when(F.col("left_at").isNotNull(), F.col(OPEN_MOVES))), F.lit(0)).alias("pairs"), F.lit(0).cast("long").alias("moves"))
    all_moves = moves.agg(F.lit(0).cast("long").alias("pairs"), F.count(F.lit(1)).alias("moves"))
    return _resolved_row(ended.unionByName(all_moves).agg(F.sum("pairs").alias("pairs"), F.sum("moves").alias("moves")))


def merge_count_check(f_puzzle: DataFrame) -> DataFrame:
    """Q7: completed, fully tracked puzzles need pieces - 1 merges (<= 2 % may differ)."""
    tracked = F.col("is_completed") & F.col("started_at").isNotNull() & (F.col("source") != "unknown")
    wrong = tracked & (F.col("groups_merged") != F.col("pieces") - 1)
    counts = f_puzzle.agg(
        F.count(F.when(tracked, F.lit(1))).alias("tracked"), F.count(F.when(wrong, F.lit(1))).alias("wrong")
    )
    share = F.coalesce(ratio_half_up("wrong", "tracked", 5), F.lit(0.0))
    return counts.select(*_row(MERGE_COUNT, "warn", share <= MERGE_COUNT_MAX, share,
                               "finished puzzles whose merges are not one less than their pieces, per finished puzzle"))


def run_checks(bronze: DataFrame, events: DataFrame, moves: DataFrame, sessions: DataFrame, f_puzzle: DataFrame,
               now: Column | None = None, event_rows: DataFrame | None = None) -> DataFrame:
    """Q1-Q7 as one DataFrame of check rows. ``event_rows`` replaces the whole-table Q1-Q4 (an incremental
    run passes ``event_checks_incremental``)."""
    return (
        (event_rows if event_rows is not None else event_checks(bronze, events, now))
        .unionByName(puzzle_unique_check(f_puzzle))
        .unionByName((moves_resolved_check_counted if OPEN_MOVES in sessions.columns else moves_resolved_check)(moves, sessions))
        .unionByName(merge_count_check(f_puzzle))
    )


def check_row(name: str, severity: str, passed: bool, value: float, detail: str) -> dict:
    """A check row that was decided outside a query."""
    return {"name": name, "severity": severity, "passed": passed, "value": float(value), "detail": detail}


def failed_errors(checks: list[dict]) -> list[str]:
    """Q9: names of failed error checks (the publish gate)."""
    return [c["name"] for c in checks if c["severity"] == "error" and not c["passed"]]


# ---- invariants of generated histories (X9, X10) --------------------------------------------

def session_order_violations(events: DataFrame, bucket_seconds: int | None = 86400) -> DataFrame:
    """X9 per socket and room: presence must start with a join, have at most one leave and end with it;
    a socket's grabs never overlap (a grab right after an open grab is a violation)."""
    presence = events.filter(F.col("event_type").isin(*C.PRESENCE_EVENTS) & F.col("session_id").isNotNull())
    order = ["occurred_at", "source_id"]
    first_last = presence.groupBy("session_id", "room_slug").agg(
        F.min_by("event_type", F.struct(*order)).alias("first_type"),
        F.max_by("event_type", F.struct(*order)).alias("last_type"),
        F.count(F.when(F.col("event_type") == C.PLAYER_LEFT, F.lit(1))).alias("leaves"),
    )
    presence_bad = first_last.select(
        (F.col("first_type") != C.PLAYER_JOINED).cast("long").alias("join_not_first"),
        (F.col("leaves") > 1).cast("long").alias("many_leaves"),
        ((F.col("leaves") == 1) & (F.col("last_type") != C.PLAYER_LEFT)).cast("long").alias("leave_not_last"),
        F.lit(0).cast("long").alias("overlapping_grabs"),
    )
    mv = events.filter(F.col("event_type").isin(*C.MOVE_EVENTS) & F.col("session_id").isNotNull())
    # A grab whose next move event is another grab: bucketed pairing, so a hot socket is not one task.
    nxt = lead_struct(mv.select("session_id", "event_type", *order), ["session_id"], order, ["event_type"],
                      bucket_seconds=bucket_seconds)
    grabs = nxt.select(
        *[F.lit(0).cast("long").alias(c) for c in ("join_not_first", "many_leaves", "leave_not_last")],
        ((F.col("event_type") == C.PIECE_GRABBED) & (F.col("next.event_type") == C.PIECE_GRABBED))
        .cast("long").alias("overlapping_grabs"),
    )
    return presence_bad.unionByName(grabs).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
          for c in ("join_not_first", "many_leaves", "leave_not_last", "overlapping_grabs")]
    )


def puzzle_lifecycle_violations(events: DataFrame, f_puzzle: DataFrame) -> DataFrame:
    """Completed puzzles that never started, that completed more than once, and whose merges are
    not pieces - 1."""
    completions = events.filter(F.col("event_type") == C.PUZZLE_COMPLETED).groupBy("puzzle_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    started = events.filter(F.col("event_type") == C.PUZZLE_STARTED).select("puzzle_id")
    never_started = completions.join(started, "puzzle_id", "left_anti").select(
        F.lit(1).cast("long").alias("completed_not_started"), F.lit(0).cast("long").alias("completed_twice"),
        F.lit(0).cast("long").alias("wrong_merges"),
    )
    twice = completions.select(
        F.lit(0).cast("long").alias("completed_not_started"), (F.col("n") > 1).cast("long").alias("completed_twice"),
        F.lit(0).cast("long").alias("wrong_merges"),
    )
    merges = f_puzzle.filter(F.col("is_completed")).select(
        F.lit(0).cast("long").alias("completed_not_started"), F.lit(0).cast("long").alias("completed_twice"),
        (F.col("groups_merged") != F.col("pieces") - 1).cast("long").alias("wrong_merges"),
    )
    return never_started.unionByName(twice).unionByName(merges).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
          for c in ("completed_not_started", "completed_twice", "wrong_merges")]
    )
