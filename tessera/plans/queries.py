"""Registered queries (keys of ``queries()`` / ``oracle_sql()``), grouped as in the operator inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import oracle as O
from tessera.plans import gold, silver
from tessera.plans.lineage import shared_model
from tessera.registry import register

SILVER_COLS = [c for c in silver.SILVER_EVENT_COLUMNS if c != "payload"]
MOVE_COLS = [
    "move_id", "session_id", "client_id", "room_slug", "room_type", "puzzle_id", "group_id", "group_size_before",
    "grabbed_at", "ended_at", "outcome", "hold_ms", "abandon_reason", "snapped", "frame", "merged_groups",
    "group_size_after", "event_date", "hour_local", "weekday", "is_bot", "is_synthetic", "traffic_type",
]
SESSION_COLS = [
    "session_key", "session_id", "client_id", "player_name", "room_slug", "room_type", "joined_at", "left_at",
    "left_reason", "duration_ms", "players_at_join", "event_date", "hour_local", "weekday", "is_bot", "is_synthetic",
    "traffic_type", "moves", "snaps", "groups_merged", "puzzles_played",
]


def _cols(cols: list[str]) -> str:
    return ", ".join(cols)


# ---------------------------------------------------------------- windows / silver ----------

@register("dedup_first", O.with_(f"SELECT {_cols(SILVER_COLS)} FROM silver_dup", "silver_dup"))
def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + M1 over a log where every 20th row repeats the previous event_id: first copy wins."""
    return shared_model(spark, sf_dir, dup_key=True).events.select(*SILVER_COLS)


@register("silver_events", O.with_(f"SELECT {_cols(SILVER_COLS)} FROM silver", "silver"))
def q_silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: typed, flagged, localized events."""
    return shared_model(spark, sf_dir).events.select(*SILVER_COLS)


@register("silver_moves", O.with_(f"SELECT {_cols(MOVE_COLS)} FROM moves", "moves"))
def q_silver_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + M2: grabs paired with their closing drop/abandon."""
    return shared_model(spark, sf_dir).moves.select(*MOVE_COLS)


@register("silver_sessions", O.with_(f"SELECT {_cols(SESSION_COLS)} FROM sessions", "sessions"))
def q_silver_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 + J5 + A9 + J6 + M3: room visits with their move statistics."""
    return shared_model(spark, sf_dir).sessions.select(*SESSION_COLS)


@register(
    "session_move_stats",
    O.with_("SELECT session_key, CAST(moves AS BIGINT) AS moves, CAST(snaps AS BIGINT) AS snaps, "
            "CAST(groups_merged AS BIGINT) AS groups_merged, CAST(puzzles_played AS BIGINT) AS puzzles_played "
            "FROM sessions", "sessions"),
)
def q_session_move_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + A9: interval statistics per session, computed without session x move pairs."""
    m = shared_model(spark, sf_dir)
    return silver.session_move_stats(m.session_pairs, m.moves)


# ---------------------------------------------------------------- gold ----------------------

def _gold(name: str, doc: str):
    @register(name, O.with_(f"SELECT * FROM {name}", name))
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(shared_model(spark, sf_dir), name)

    q.__doc__ = doc
    return q


for _name, _doc in [
    ("dim_date", "M4: calendar spine between first and last local day."),
    ("dim_player", "M5: players with visit statistics."),
    ("dim_room", "M6: rooms with creation settings and expiry."),
    ("fact_puzzle", "M7: puzzle fact with the 5-way traffic class."),
    ("fact_session", "M8: session fact."),
    ("fact_move", "M9: move fact."),
    ("agg_daily_activity", "M10: sessions and moves per local day, room type, traffic class."),
    ("agg_daily_puzzles", "M11: puzzles per local day, room type, traffic class."),
    ("agg_hourly_heatmap", "M12: sessions and moves per weekday and local hour."),
    ("agg_difficulty", "M13: completion funnel by puzzle size."),
]:
    _gold(_name, _doc)


@register(
    "daily_moves",
    O.with_("""SELECT date_key, room_type, traffic_type, count(*) AS moves,
                      CAST(sum(CAST(snapped AS INTEGER)) AS BIGINT) AS snaps,
                      """ + O.ratio("sum(CAST(snapped AS INTEGER))", "count(*)") + """ AS snap_rate
               FROM fact_move GROUP BY date_key, room_type, traffic_type""", "fact_move"),
)
def q_daily_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: moves and snap rate per local day, room type and traffic class."""
    from tessera.functions import ratio_half_up

    agg = shared_model(spark, sf_dir).fact_move.groupBy("date_key", "room_type", "traffic_type").agg(
        F.count(F.lit(1)).alias("moves"), F.sum(F.col("snapped").cast("int")).alias("snaps")
    )
    return agg.withColumn("snap_rate", ratio_half_up("snaps", "moves"))


# ---------------------------------------------------------------- shared scalars -------------
# Parameters that would come from the clock are derived from the data, so the query is reproducible.

def _scalar(df: DataFrame):
    return df.first()[0]


def _log_now(m) -> F.Column:
    """`now` for the quality gate: the last ingest time of the log."""
    return F.lit(_scalar(m.bronze.agg(F.max("ingested_at")))).cast("timestamp")


def _today(m):
    """The (partial) current local day: the last local event date."""
    return _scalar(m.events.agg(F.max("event_date")))


O.cte("log_now", ["bronze"], "SELECT max(ingested_at) AS now FROM bronze")
O.cte("as_of_day", ["silver"], "SELECT max(event_date) AS today FROM silver")


def _per_sql(days: int) -> str:
    return f"""
SELECT hi AS to_d, hi - {days - 1} AS frm_d, hi - {days} AS prev_to_d, hi - {2 * days - 1} AS prev_from_d,
       {O.dkey('hi')} AS to_k, {O.dkey(f'hi - {days - 1}')} AS frm_k, {O.dkey(f'hi - {days}')} AS prev_to_k,
       {O.dkey(f'hi - {2 * days - 1}')} AS prev_from_k
FROM (SELECT max(d.date) AS hi FROM dim_date d, as_of_day WHERE d.date < as_of_day.today)"""


for _d in (7, 14, 30, 90):
    O.cte(f"per{_d}", ["dim_date", "as_of_day"], _per_sql(_d))


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ---------------------------------------------------------------- quality -------------------
from tessera.plans import quality as Q  # noqa: E402

_Q_SQL = f"""
SELECT * FROM (
  SELECT '{Q.UNIQUE_EVENT_ID}' AS name, 'error' AS severity, dup = 0 AS passed, CAST(dup AS DOUBLE) AS value,
         'ids that several rows hold' AS detail FROM qt
  UNION ALL SELECT '{Q.REQUIRED_FIELDS}', 'error', missing = 0, CAST(missing AS DOUBLE),
         'rows without an id, a type or a time' FROM qt
  UNION ALL SELECT '{Q.NOT_IN_FUTURE}', 'error', late = 0, CAST(late AS DOUBLE),
         'rows dated beyond the tolerated clock' FROM qt
  UNION ALL SELECT '{Q.RECONCILE}', 'error', rows_ = bronze_ids, CAST(rows_ - bronze_ids AS DOUBLE),
         'kept rows less extracted ids' FROM qt
  UNION ALL SELECT '{Q.UNIQUE_PUZZLE}', 'error', dup = 0, CAST(dup AS DOUBLE), 'puzzles with several fact rows'
    FROM (SELECT count(*) FILTER (WHERE n > 1) AS dup FROM (SELECT puzzle_id, count(*) AS n FROM fact_puzzle GROUP BY puzzle_id))
  UNION ALL SELECT '{Q.MOVES_RESOLVED}', 'warn', share <= {Q.MOVES_RESOLVED_MAX}, share,
         'open grabs of ended visits, per grab' FROM qmr
  UNION ALL SELECT '{Q.MERGE_COUNT}', 'warn', share <= {Q.MERGE_COUNT_MAX}, share,
         'finished puzzles whose merges are not one less than their pieces, per finished puzzle' FROM qmc)"""

O.cte("qt", ["silver", "bronze", "log_now"], """
SELECT coalesce(sum(CAST(n > 1 AS BIGINT)), 0) AS dup, coalesce(sum(n), 0) AS rows_,
       coalesce(sum(missing), 0) AS missing, coalesce(sum(late), 0) AS late,
       (SELECT count(*) FROM (SELECT DISTINCT event_id FROM bronze)) AS bronze_ids
FROM (SELECT event_id, count(*) AS n,
             sum(CAST(event_type IS NULL OR occurred_at IS NULL OR event_id IS NULL AS BIGINT)) AS missing,
             sum(CAST(coalesce(occurred_at > (SELECT now FROM log_now) + INTERVAL 10 MINUTE, false) AS BIGINT)) AS late
      FROM silver GROUP BY event_id)""")
O.cte("qmr", ["moves", "sessions"], f"""
SELECT {O.ratio('pairs', 'greatest(total, 1)', 5)} AS share
FROM (SELECT (SELECT count(*) FROM moves m JOIN sessions s
                ON m.session_id = s.session_id AND m.room_slug = s.room_slug
               AND s.left_at IS NOT NULL AND m.outcome = 'open'
               AND m.grabbed_at BETWEEN s.joined_at AND s.left_at) AS pairs,
             (SELECT count(*) FROM moves) AS total)""")
O.cte("qmc", ["fact_puzzle"], f"""
SELECT coalesce({O.ratio('wrong', 'tracked', 5)}, 0.0) AS share
FROM (SELECT count(*) FILTER (WHERE tr) AS tracked, count(*) FILTER (WHERE tr AND groups_merged != pieces - 1) AS wrong
      FROM (SELECT *, is_completed AND started_at IS NOT NULL AND source != 'unknown' AS tr FROM fact_puzzle))""")


@register("quality_checks", O.with_(_Q_SQL, "qt", "fact_puzzle", "qmr", "qmc"))
def q_quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q7 as one DataFrame of check rows (the publish gate's input)."""
    m = shared_model(spark, sf_dir)
    return Q.run_checks(m.bronze, m.events, m.moves, m.sessions, m.fact_puzzle, now=_log_now(m))


@register("q_duplicates", O.with_(
    "SELECT count(*) AS duplicate_keys FROM (SELECT event_id FROM bronze_dup GROUP BY event_id HAVING count(*) > 1)",
    "bronze_dup"))
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id values with more than one copy in a log with repeated ids."""
    from tessera.operators.dedup import duplicate_key_count

    return duplicate_key_count(shared_model(spark, sf_dir, dup_key=True).bronze, "event_id")


@register("q_reconcile", O.with_("""
SELECT (SELECT count(*) FROM silver_dup) AS silver_rows,
       (SELECT count(*) FROM (SELECT DISTINCT event_id FROM bronze_dup)) AS bronze_ids""", "silver_dup"))
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 + Q4 on a log with repeated ids: silver rows equal distinct bronze event_ids."""
    m = shared_model(spark, sf_dir, dup_key=True)
    a = m.events.agg(F.count(F.lit(1)).alias("silver_rows"), F.lit(0).cast("long").alias("bronze_ids"))
    b = m.bronze.select("event_id").distinct().agg(F.lit(0).cast("long").alias("silver_rows"),
                                                     F.count(F.lit(1)).alias("bronze_ids"))
    return a.unionByName(b).agg(F.sum("silver_rows").alias("silver_rows"), F.sum("bronze_ids").alias("bronze_ids"))


O.cte("pres", ["silver"], """
SELECT session_id, room_slug, first(event_type ORDER BY occurred_at, source_id) AS first_type,
       first(event_type ORDER BY occurred_at DESC, source_id DESC) AS last_type,
       count(*) FILTER (WHERE event_type = 'player_left') AS leaves
FROM silver WHERE event_type IN ('player_joined', 'player_left') AND session_id IS NOT NULL
GROUP BY session_id, room_slug""")
O.cte("grb", ["silver"], """
SELECT event_type, lag(event_type) OVER (PARTITION BY session_id ORDER BY occurred_at, source_id) AS prev
FROM silver WHERE event_type IN ('piece_grabbed', 'piece_dropped', 'piece_abandoned') AND session_id IS NOT NULL""")


@register("q_session_order", O.with_("""
SELECT coalesce((SELECT sum(CAST(first_type != 'player_joined' AS BIGINT)) FROM pres), 0) AS join_not_first,
       coalesce((SELECT sum(CAST(leaves > 1 AS BIGINT)) FROM pres), 0) AS many_leaves,
       coalesce((SELECT sum(CAST(leaves = 1 AND last_type != 'player_left' AS BIGINT)) FROM pres), 0) AS leave_not_last,
       (SELECT count(*) FROM grb WHERE event_type = 'piece_grabbed' AND prev = 'piece_grabbed') AS overlapping_grabs""",
    "pres", "grb"))
def q_session_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session invariants (join first, at most one leave and it is last, no overlapping grabs)."""
    return Q.session_order_violations(shared_model(spark, sf_dir).events)


@register("q_puzzle_lifecycle", O.with_("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT puzzle_id FROM silver WHERE event_type = 'puzzle_completed') c
        WHERE NOT EXISTS (SELECT 1 FROM silver s WHERE s.event_type = 'puzzle_started' AND s.puzzle_id = c.puzzle_id))
         AS completed_not_started,
       (SELECT count(*) FROM (SELECT puzzle_id FROM silver WHERE event_type = 'puzzle_completed'
                              GROUP BY puzzle_id HAVING count(*) > 1)) AS completed_twice,
       (SELECT count(*) FROM fact_puzzle WHERE is_completed AND groups_merged != pieces - 1) AS wrong_merges""",
    "silver", "fact_puzzle"))
def q_puzzle_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzle invariants (completed puzzles started, completed once, merges = pieces - 1)."""
    m = shared_model(spark, sf_dir)
    return Q.puzzle_lifecycle_violations(m.events, m.fact_puzzle)


# ---------------------------------------------------------------- serving ------------------
from tessera import constants as C  # noqa: E402
from tessera.plans import serving as S  # noqa: E402


def _periods(m, days: int):
    return S.periods(m.dim_date, _today(m), days)


def _kpi_sql(days: int, fact: str, types: list[str], figures: str, defaults: str) -> str:
    """One row for each period: the fact's rows meet the periods by date range, periods without rows stay."""
    return f"""
SELECT w.period, {defaults}
FROM (SELECT 'current' AS period, frm_k AS lo, to_k AS hi FROM per{days}
      UNION ALL SELECT 'previous', prev_from_k, prev_to_k FROM per{days}) w
LEFT JOIN LATERAL (SELECT {figures} FROM {fact} f
                   WHERE f.date_key >= w.lo AND f.date_key <= w.hi AND list_contains({types!r}, f.traffic_type)) a ON true"""


def _kpis_sessions_sql(days: int, traffic: str) -> str:
    return _kpi_sql(
        days, "fact_session", C.session_types(traffic),
        "count(DISTINCT f.client_id) AS n_players, count(*) AS n_sessions, quantile_cont(f.duration_ms, 0.5) AS mid_ms, sum(f.snaps) AS n_snaps, sum(f.moves) AS n_moves",
        "coalesce(n_players, 0) AS players, coalesce(n_sessions, 0) AS sessions, mid_ms / 60000.0 AS median_min, "
        "CASE WHEN n_moves > 0 THEN CAST(n_snaps AS DOUBLE) / n_moves END AS snap_rate",
    )


def _kpis_puzzles_sql(days: int, traffic: str) -> str:
    return _kpi_sql(
        days, "fact_puzzle", C.puzzle_types(traffic), "count_if(f.is_completed) AS n_done, count_if(f.moves > 0) AS n_played",
        "CAST(coalesce(n_done, 0) AS BIGINT) AS completed, CASE WHEN n_played > 0 THEN CAST(n_done AS DOUBLE) / n_played END AS completion_rate",
    )


@register("kpis_sessions", O.with_(_kpis_sessions_sql(7, "all"), "fact_session", "per7"))
def q_kpis_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + P21 + P22: session KPIs for the last 7 complete days and the 7 before, all traffic."""
    m = shared_model(spark, sf_dir)
    return S.kpis_sessions(spark, m.fact_session, _periods(m, 7), "all")


@register("kpis_puzzles", O.with_(_kpis_puzzles_sql(7, "human"), "fact_puzzle", "per7"))
def q_kpis_puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzle KPIs for two 7-day periods, human traffic (mixed puzzles count as human)."""
    m = shared_model(spark, sf_dir)
    return S.kpis_puzzles(spark, m.fact_puzzle, _periods(m, 7), "human")


_KPIS14 = f"""
SELECT s.period, s.players, s.sessions, s.median_min, s.snap_rate, p.completed, p.completion_rate
FROM ({_kpis_sessions_sql(14, 'synthetic')}) s JOIN ({_kpis_puzzles_sql(14, 'synthetic')}) p USING (period)"""


@register("kpis_previous", O.with_(_KPIS14, "fact_session", "fact_puzzle", "per14"))
def q_kpis_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 KPIs for the current and previous 14-day periods, synthetic traffic."""
    m = shared_model(spark, sf_dir)
    return S.kpis(spark, m.fact_session, m.fact_puzzle, _periods(m, 14), "synthetic")


def _delta_sql(days: int, traffic: str) -> str:
    tag = f"{days}_{traffic}"
    O.cte(f"kp_{tag}", [f"per{days}", "fact_session", "fact_puzzle"], f"""
SELECT s.period, s.players, s.sessions, s.median_min, s.snap_rate, p.completed, p.completion_rate
FROM ({_kpis_sessions_sql(days, traffic)}) s JOIN ({_kpis_puzzles_sql(days, traffic)}) p USING (period)""")
    for per in ("current", "previous"):
        O.cte(f"kd_{per}_{tag}", [f"kp_{tag}"], " UNION ALL ".join(
            f"SELECT '{c}' AS kpi, CAST({c} AS DOUBLE) AS v FROM kp_{tag} WHERE period = '{per}'" for c in S.KPI_COLUMNS))
    return O.with_(f"""
SELECT kpi, now, before, CASE WHEN ok THEN chg END AS change,
       CASE WHEN NOT ok THEN NULL WHEN abs(chg) < 0.005 THEN 'flat' WHEN chg > 0 THEN 'up' ELSE 'down' END AS direction,
       CASE WHEN ok AND abs(chg) >= 0.005 THEN CAST(abs(floor(chg * 100 + 0.5)) AS BIGINT) END AS percent
FROM (SELECT kpi, c.v AS now, p.v AS before,
             coalesce(c.v IS NOT NULL AND p.v IS NOT NULL AND p.v != 0, false) AS ok,
             CASE WHEN p.v != 0 THEN (c.v - p.v) / p.v END AS chg
      FROM kd_current_{tag} c FULL OUTER JOIN kd_previous_{tag} p USING (kpi))""",
                   f"kd_current_{tag}", f"kd_previous_{tag}")


@register("kpi_delta", _delta_sql(7, "all"))
def q_kpi_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI change against the previous 7-day period, all traffic."""
    m = shared_model(spark, sf_dir)
    return S.kpi_delta(S.kpis(spark, m.fact_session, m.fact_puzzle, _periods(m, 7), "all"))


# Sessions, completed puzzles and empty days as one list of contributions, summed by day.
_DAILY14 = f"""
SELECT day AS date, count(DISTINCT who) AS players, CAST(sum(visits) AS BIGINT) AS sessions, CAST(sum(played) AS BIGINT) AS moves, CAST(sum(done) AS BIGINT) AS completed
FROM (SELECT date_key, client_id AS who, 1 AS visits, moves AS played, 0 AS done FROM fact_session WHERE list_contains({C.session_types('human')!r}, traffic_type)
      UNION ALL SELECT date_key, NULL, 0, 0, 1 FROM fact_puzzle WHERE is_completed AND list_contains({C.puzzle_types('human')!r}, traffic_type)
      UNION ALL SELECT date_key, NULL, 0, 0, 0 FROM dim_date) c
JOIN (SELECT date_key, date AS day FROM dim_date, per14 WHERE date >= frm_d AND date <= to_d) d USING (date_key)
GROUP BY day"""


@register("api_daily", O.with_(_DAILY14, "dim_date", "fact_session", "fact_puzzle", "per14"))
def q_api_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 + A19 + T1: zero-filled daily series for the last 14 complete days, human traffic."""
    m = shared_model(spark, sf_dir)
    return S.api_daily(m.dim_date, m.fact_session, m.fact_puzzle, _periods(m, 14), "human")


@register("api_heatmap", O.with_(f"""
SELECT weekday, hour_local AS hour, count(*) AS sessions FROM fact_session, per30
WHERE date_key BETWEEN frm_k AND to_k AND traffic_type IN {_in(C.session_types('all'))}
GROUP BY weekday, hour_local""", "fact_session", "per30"))
def q_api_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by weekday and hour for the last 30 complete days."""
    m = shared_model(spark, sf_dir)
    return S.api_heatmap(m.fact_session, _periods(m, 30), "all")


# --- fixed values: size buckets as bounds, the global room apart ---
_SIZES = "(VALUES ('24', 0, 36), ('48', 37, 72), ('96', 73, 120), ('150', 121, 2147483647)) b(label, low, high)"
_SIZED = f"""SELECT f.*, CASE f.room_type WHEN 'global' THEN 'global' ELSE b.label END AS size, CASE f.room_type WHEN 'global' THEN 0 ELSE f.pieces END AS sort_key
FROM fact_puzzle f JOIN {_SIZES} ON greatest(f.pieces, 0) BETWEEN b.low AND b.high"""
_DIFF30 = f"""
SELECT size, count(*) AS started, CAST(count_if(moves > 0) AS BIGINT) AS played, CAST(count_if(is_completed) AS BIGINT) AS completed,
       median(duration_ms) FILTER (WHERE is_completed) / 60000.0 AS median_min, min(sort_key) AS sort_key
FROM ({_SIZED}) s SEMI JOIN per30 p ON s.date_key >= p.frm_k AND s.date_key <= p.to_k
WHERE list_contains({C.puzzle_types('all')!r}, s.traffic_type) GROUP BY size"""


@register("api_difficulty", O.with_(_DIFF30, "fact_puzzle", "per30"))
def q_api_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 + P16 + T2: funnel by size bucket for the last 30 complete days, with the exact median."""
    m = shared_model(spark, sf_dir)
    return S.api_difficulty(m.fact_puzzle, _periods(m, 30), "all")


@register("last_complete_day", O.with_(
    "SELECT max(d.date) AS max_date FROM dim_date d, as_of_day WHERE d.date < as_of_day.today", "dim_date", "as_of_day"))
def q_last_complete_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving range ends at the last complete local day (the last event day is partial)."""
    m = shared_model(spark, sf_dir)
    return S.last_complete_day(m.dim_date, _today(m))


@register("heatmap_dense", O.with_(f"""
SELECT weekday, hour, sessions,
       CASE WHEN sessions > 0 AND mx > 0 THEN least((sessions * 7) // mx, 6) END AS step
FROM (SELECT c.weekday, c.hour, coalesce(h.sessions, 0) AS sessions, max(coalesce(h.sessions, 0)) OVER () AS mx
      FROM (SELECT CAST(i // 24 + 1 AS INTEGER) AS weekday, CAST(i % 24 AS INTEGER) AS hour FROM range(168) t(i)) c
      LEFT JOIN (SELECT weekday, hour_local AS hour, count(*) AS sessions FROM fact_session, per30
                 WHERE date_key BETWEEN frm_k AND to_k GROUP BY weekday, hour_local) h USING (weekday, hour))""",
    "fact_session", "per30"))
def q_heatmap_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 7 x 24 grid with zeros and 7 intensity steps, last 30 complete days."""
    m = shared_model(spark, sf_dir)
    return S.heatmap_dense(S.api_heatmap(m.fact_session, _periods(m, 30), "all"))


# ---- public datasets and charts ----

def _names(table: str, labels: dict) -> None:
    """A label list as a table (code, label)."""
    rows = ", ".join(f"({k!r}, {v!r})" for k, v in labels.items())
    O.cte(table, [], f"SELECT * FROM (VALUES {rows}) t(code, label)")


_names("traffic_names", C.TRAFFIC_LABELS)
_names("weekday_names", C.WEEKDAY_LABELS)
_names("size_names", C.SIZE_LABELS)
_TRAFFIC = f"(SELECT coalesce(max(label), '{C.TRAFFIC_LABEL_OTHER}') FROM traffic_names n WHERE n.code = a.traffic_type) AS traffic"
_DAY = "(SELECT date FROM dim_date d WHERE d.date_key = a.date_key)"
O.cte("v_daily_activity", ["agg_daily_activity", "dim_date", "traffic_names"], f"""
SELECT {_DAY} AS date, room_type, {_TRAFFIC}, sessions, active_players, moves, snaps, median_session_min
FROM agg_daily_activity a WHERE date_key IN (SELECT date_key FROM dim_date)""")
O.cte("v_daily_puzzles", ["agg_daily_puzzles", "dim_date", "traffic_names"], f"""
SELECT {_DAY} AS date, if(room_type IS NOT DISTINCT FROM 'global', '{C.ROOM_LABELS['global']}', '{C.ROOM_LABEL_OTHER}') AS room, {_TRAFFIC},
       puzzles_started, puzzles_played, puzzles_completed, median_duration_min
FROM agg_daily_puzzles a WHERE date_key IN (SELECT date_key FROM dim_date)""")
O.cte("v_heatmap", ["agg_hourly_heatmap", "traffic_names", "weekday_names"], f"""
SELECT w.label AS day, format('{{:02d}}', hour_local) AS hour, {_TRAFFIC}, sessions, moves
FROM agg_hourly_heatmap a JOIN weekday_names w ON w.code = a.weekday""")
O.cte("v_difficulty", ["agg_difficulty", "traffic_names", "size_names"], f"""
SELECT z.label AS size, {_TRAFFIC}, started, played, completed, median_duration_min
FROM agg_difficulty a JOIN {_SIZES} ON a.pieces BETWEEN b.low AND b.high
JOIN size_names z ON z.code = if(a.room_type IS NOT DISTINCT FROM 'global', 'global', b.label)""")
O.cte("chart_asof", ["dim_date"], "SELECT max(date) AS d FROM dim_date")


def _views(m) -> dict[str, DataFrame]:
    return {
        "v_daily_activity": S.v_daily_activity(m.agg_daily_activity, m.dim_date),
        "v_daily_puzzles": S.v_daily_puzzles(m.agg_daily_puzzles, m.dim_date),
        "v_heatmap": S.v_heatmap(m.agg_hourly_heatmap),
        "v_difficulty": S.v_difficulty(m.agg_difficulty),
    }


for _v, _doc in [("v_daily_activity", "V1"), ("v_daily_puzzles", "V2"), ("v_heatmap", "V3"), ("v_difficulty", "V4")]:
    def _mk(v=_v, doc=_doc):
        @register(v, O.with_(f"SELECT * FROM {v}", v))
        def q(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _views(shared_model(spark, sf_dir))[v]

        q.__doc__ = f"{doc}: public dataset over aggregates only (labels, no names or ids)."

    _mk()


def _chart_asof(m):
    return _scalar(m.dim_date.agg(F.max("date")))


def _last_sql(months: int) -> str:
    return f"date >= (SELECT d FROM chart_asof) - INTERVAL {months} MONTH AND date < (SELECT d FROM chart_asof)"


@register("chart_kpi_sessions", O.with_(
    f"SELECT sum(sessions) AS sessions FROM v_daily_activity WHERE {_last_sql(1)}", "v_daily_activity", "chart_asof"))
def q_chart_kpi_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in the last month."""
    m = shared_model(spark, sf_dir)
    return S.chart_kpi_sessions(_views(m)["v_daily_activity"], _chart_asof(m))


@register("chart_kpi_completed", O.with_(
    f"SELECT sum(puzzles_completed) AS completed FROM v_daily_puzzles WHERE {_last_sql(1)}", "v_daily_puzzles", "chart_asof"))
def q_chart_kpi_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed puzzles in the last month."""
    m = shared_model(spark, sf_dir)
    return S.chart_kpi_completed(_views(m)["v_daily_puzzles"], _chart_asof(m))


@register("chart_kpi_completion", O.with_(
    f"SELECT sum(puzzles_completed) * 1.0 / nullif(sum(puzzles_played), 0) AS completion FROM v_daily_puzzles "
    f"WHERE {_last_sql(1)}", "v_daily_puzzles", "chart_asof"))
def q_chart_kpi_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion rate in the last month."""
    m = shared_model(spark, sf_dir)
    return S.chart_kpi_completion(_views(m)["v_daily_puzzles"], _chart_asof(m))


@register("chart_sessions_by_day", O.with_(
    f"SELECT date, traffic, sum(sessions) AS sessions FROM v_daily_activity WHERE {_last_sql(3)} GROUP BY date, traffic",
    "v_daily_activity", "chart_asof"))
def q_chart_sessions_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: sessions by day and traffic over the last quarter."""
    m = shared_model(spark, sf_dir)
    return S.chart_sessions_by_day(_views(m)["v_daily_activity"], _chart_asof(m))


@register("chart_puzzles_by_day", O.with_(
    f"SELECT date, room, sum(puzzles_completed) AS completed FROM v_daily_puzzles WHERE {_last_sql(3)} GROUP BY date, room",
    "v_daily_puzzles", "chart_asof"))
def q_chart_puzzles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed puzzles by day and room over the last quarter."""
    m = shared_model(spark, sf_dir)
    return S.chart_puzzles_by_day(_views(m)["v_daily_puzzles"], _chart_asof(m))


@register("chart_heatmap", O.with_("""
SELECT day, hour, sessions, CASE WHEN mx > 0 THEN sessions / mx END AS intensity
FROM (SELECT day, hour, sum(sessions) AS sessions, max(sum(sessions)) OVER () AS mx FROM v_heatmap GROUP BY day, hour)""",
    "v_heatmap"))
def q_chart_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by day label and hour, normalized across the heatmap."""
    return S.chart_heatmap(_views(shared_model(spark, sf_dir))["v_heatmap"])


@register("chart_difficulty", O.with_(
    "SELECT size, sum(completed) * 1.0 / nullif(sum(played), 0) AS completion FROM v_difficulty GROUP BY size",
    "v_difficulty"))
def q_chart_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion by puzzle size."""
    return S.chart_difficulty(_views(shared_model(spark, sf_dir))["v_difficulty"])


@register("chart_filter_traffic", O.with_(
    f"SELECT date, traffic, sum(sessions) AS sessions FROM v_daily_activity WHERE {_last_sql(3)} "
    "AND traffic IN ('Humanos') GROUP BY date, traffic", "v_daily_activity", "chart_asof"))
def q_chart_filter_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard traffic filter (Humanos) applied to the sessions-by-day chart."""
    m = shared_model(spark, sf_dir)
    return S.chart_sessions_by_day(_views(m)["v_daily_activity"], _chart_asof(m), traffic=["Humanos"])


# ---------------------------------------------------------------- re-aimed operators -------
from tessera.plans import extras as X  # noqa: E402


@register("leaderboard", O.with_("""
SELECT puzzle_id, client_id, CAST(sum(greatest(merged_groups, 1)) AS BIGINT) AS score,
       CAST(rank() OVER (PARTITION BY puzzle_id ORDER BY sum(greatest(merged_groups, 1)) DESC) AS INTEGER) AS rank
FROM moves WHERE outcome = 'dropped' AND snapped GROUP BY puzzle_id, client_id""", "moves"))
def q_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-puzzle scores and ranks."""
    return X.leaderboard(shared_model(spark, sf_dir).moves)


@register("room_concurrency", O.with_("""
SELECT event_id, room_slug, occurred_at, source_id, event_type,
       CAST(CASE WHEN event_type = 'player_joined' THEN 1 ELSE -1 END AS BIGINT) AS delta,
       CAST(sum(CASE WHEN event_type = 'player_joined' THEN 1 ELSE -1 END)
            OVER (PARTITION BY room_slug ORDER BY occurred_at, source_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
         AS players_in_room
FROM silver WHERE event_type IN ('player_joined', 'player_left') AND room_slug IS NOT NULL""", "silver"))
def q_room_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players in the room after every join and leave (bucketed running sum)."""
    return X.room_concurrency(shared_model(spark, sf_dir).events)


@register("hold_timeout", O.with_("""
SELECT event_date, traffic_type,
       sum(CAST(outcome = 'open' AND grabbed_at + INTERVAL 30 SECOND <= (SELECT max(occurred_at) FROM silver) AS BIGINT))
         AS open_candidates,
       sum(CAST(outcome = 'abandoned' AND coalesce(abandon_reason = 'timeout', false) AS BIGINT)) AS recorded_timeouts
FROM moves GROUP BY event_date, traffic_type""", "moves", "silver"))
def q_hold_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale open holds (timeout candidates) beside recorded timeout releases, per day and class."""
    m = shared_model(spark, sf_dir)
    return X.hold_timeouts(m.moves, m.events)


@register("expired_rooms", O.with_("""
SELECT room_slug, created_at, last_activity_at,
       (epoch_us(n.now) - epoch_us(created_at)) // 1000 AS age_ms,
       (epoch_us(n.now) - epoch_us(last_activity_at)) // 1000 AS idle_ms
FROM (SELECT room_slug, min(occurred_at) AS created_at, max(occurred_at) AS last_activity_at FROM silver
      WHERE room_slug IS NOT NULL AND room_type = 'private' GROUP BY room_slug) r,
     (SELECT max(occurred_at) + INTERVAL 2 DAY AS now FROM silver) n
WHERE last_activity_at < n.now - INTERVAL 86400 SECOND
ORDER BY last_activity_at, room_slug""", "silver"))
def q_expired_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private rooms idle over 24 h, two days after the last event."""
    m = shared_model(spark, sf_dir)
    now = _scalar(m.events.agg(F.max("occurred_at") + F.expr("INTERVAL 2 DAYS")))
    return X.expired_rooms(m.events, F.lit(now).cast("timestamp"))


@register("friction_counts", O.with_("""
SELECT event_date, room_type, event_type,
       CASE WHEN event_type = 'join_failed' THEN p_error WHEN event_type = 'global_rotated' THEN p_trigger END AS reason,
       count(*) AS events, count(DISTINCT client_id) AS players
FROM silver WHERE event_type IN ('join_failed', 'grab_conflict', 'global_rotated')
GROUP BY ALL""", "silver"))
def q_friction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join failures, grab conflicts and rotations per day, room type and reason."""
    return X.friction_counts(shared_model(spark, sf_dir).events)


# ---------------------------------------------------------------- sources / incremental load
from tessera.plans import refresh as R  # noqa: E402
from tessera.sources import events_source as ES  # noqa: E402
from tessera.sources.adapter import read_table  # noqa: E402

BRONZE_PLAIN = ["id", "event_id", "event_type", "schema_version", "occurred_at", "ingested_at", "session_id",
                "client_id", "room_slug", "room_type", "puzzle_id", "is_synthetic"]


def _split_id(spark, sf_dir) -> int:
    """The watermark of a first load: half the largest source id (data-derived)."""
    return int(_scalar(read_table(spark, sf_dir, "events").agg(F.max("event_id") + 1))) // 2


O.cte("wm", ["src"], "SELECT max(id) // 2 AS w FROM src")
O.cte("bronze_dup_lo", ["bronze_dup", "wm"], "SELECT b.* FROM bronze_dup b, wm WHERE b.id <= wm.w")
O.cte("bronze_dup_hi", ["bronze_dup", "wm"], "SELECT b.* FROM bronze_dup b, wm WHERE b.id > wm.w - 100")
O.cte("silver_lo", ["bronze_dup_lo"], O._silver_sql("bronze_dup_lo"))
O.cte("silver_hi", ["bronze_dup_hi"], O._silver_sql("bronze_dup_hi"))


@register("src_max_id", O.with_("SELECT coalesce(max(id), 0) AS max_id FROM bronze", "bronze"))
def q_src_max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's high-water id."""
    return shared_model(spark, sf_dir).bronze.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("max_id"))


@register("src_incremental_scan", O.with_(
    f"SELECT {_cols(BRONZE_PLAIN)} FROM bronze, wm WHERE id > wm.w AND id <= (SELECT max(id) FROM bronze)",
    "bronze", "wm"))
def q_src_incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded scan (watermark, max id], pushed to the Parquet reader."""
    src = ES.ParquetEventSource(spark, sf_dir)
    return src.read(_split_id(spark, sf_dir), src.max_id()).select(*BRONZE_PLAIN)


@register("bronze_metadata", O.with_(
    f"SELECT id, CAST(7 AS BIGINT) AS _run_id, CAST({O.local('ingested_at')} AS DATE) AS ingest_date FROM bronze",
    "bronze"))
def q_bronze_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: run id and local ingest date added on extraction (the extraction time is the clock and is
    left out of the comparison)."""
    src = ES.ParquetEventSource(spark, sf_dir)
    return ES.with_bronze_metadata(src.read(0, src.max_id()), 7).select("id", "_run_id", "ingest_date")


@register("merge_insert_only", O.with_(
    f"SELECT {_cols(SILVER_COLS)} FROM silver_hi WHERE event_id NOT IN (SELECT event_id FROM silver_lo)",
    "silver_hi", "silver_lo"))
def q_merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second load re-reads 100 ids below the watermark (late commits, trap 11) from a
    log with repeated ids; only event_ids not yet in silver are inserted, first copy first."""
    from tessera.sources.adapter import bronze_from_events

    w = _split_id(spark, sf_dir)
    bronze = bronze_from_events(read_table(spark, sf_dir, "events"), dup_key=True)
    existing = silver.to_silver_events(bronze.filter(F.col("id") <= w))
    incoming = silver.to_silver_events(bronze.filter(F.col("id") > w - 100))
    return ES.insert_only_merge(existing, incoming, "event_id").select(*SILVER_COLS)


@register("ingest_skip_duplicates", O.with_("""
SELECT (SELECT count(*) FROM bronze_dup_hi) AS offered,
       (SELECT count(*) FROM (SELECT DISTINCT event_id FROM bronze_dup_hi)
        WHERE event_id NOT IN (SELECT event_id FROM bronze_dup_lo)) AS inserted,
       (SELECT count(*) FROM bronze_dup_hi) - (SELECT count(*) FROM (SELECT DISTINCT event_id FROM bronze_dup_hi)
        WHERE event_id NOT IN (SELECT event_id FROM bronze_dup_lo)) AS skipped""", "bronze_dup_hi", "bronze_dup_lo"))
def q_ingest_skip_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 + X11: an insert that skips stored and repeated keys, reporting offered / inserted / skipped."""
    from tessera.sources.adapter import bronze_from_events

    w = _split_id(spark, sf_dir)
    bronze = bronze_from_events(read_table(spark, sf_dir, "events"), dup_key=True)
    offered = bronze.filter(F.col("id") > w - 100)
    inserted = ES.skip_duplicates(bronze.filter(F.col("id") <= w), offered, "event_id", "id")
    a = offered.agg(F.count(F.lit(1)).alias("offered"), F.lit(0).cast("long").alias("inserted"))
    b = inserted.agg(F.lit(0).cast("long").alias("offered"), F.count(F.lit(1)).alias("inserted"))
    return a.unionByName(b).agg(F.sum("offered").alias("offered"), F.sum("inserted").alias("inserted")).select(
        "offered", "inserted", (F.col("offered") - F.col("inserted")).alias("skipped"))


@register("purge_synthetic", O.with_(
    f"SELECT {_cols(SILVER_COLS)} FROM silver WHERE NOT coalesce(is_synthetic, false)", "silver"))
def q_purge_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without synthetic history (the rebuild after a purge starts from this)."""
    return ES.purge(shared_model(spark, sf_dir).events, F.col("is_synthetic")).select(*SILVER_COLS)


_PK_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) FILTER (WHERE n > 1) AS duplicate_keys, "
    f"CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS null_keys "
    f"FROM (SELECT {k} AS k, count(*) AS n FROM {t} GROUP BY {k})"
    for t, k in R.PRIMARY_KEYS.items())


@register("pk_violations", O.with_(_PK_SQL, *R.PRIMARY_KEYS))
def q_pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate and null primary keys of the published dimensions and facts."""
    m = shared_model(spark, sf_dir)
    return R.pk_violations({t: getattr(m, t) for t in R.PRIMARY_KEYS})


# ---------------------------------------------------------------- scalar functions ----------

@register("traffic_class", O.with_("""
SELECT is_synthetic, is_bot, traffic_type, count(*) AS events FROM silver GROUP BY ALL""", "silver"))
def q_traffic_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P2: flags and the synthetic > bot > human class."""
    from tessera.functions import traffic_type

    ev = shared_model(spark, sf_dir).events
    return ev.groupBy("is_synthetic", "is_bot", traffic_type().alias("traffic_type")).agg(F.count(F.lit(1)).alias("events"))


@register("local_calendar", O.with_("""
SELECT event_date, hour_local, weekday, count(*) AS events FROM silver GROUP BY ALL""", "silver"))
def q_local_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local date, hour and ISO weekday in the configured zone."""
    return shared_model(spark, sf_dir).events.groupBy("event_date", "hour_local", "weekday").agg(
        F.count(F.lit(1)).alias("events"))


@register("json_field", O.with_("""
SELECT event_id, p_group_id AS group_id, p_hold_ms AS hold_ms, p_snapped AS snapped, p_reason AS reason,
       p_duration_ms AS duration_ms, p_pieces AS pieces
FROM silver""", "silver"))
def q_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + P27: typed payload fields (integers through double and round; absent fields are null)."""
    from tessera.functions import payload

    return shared_model(spark, sf_dir).events.select(
        "event_id", payload("group_id", "int").alias("group_id"), payload("hold_ms", "long").alias("hold_ms"),
        payload("snapped", "boolean").alias("snapped"), payload("reason").alias("reason"),
        payload("duration_ms", "long").alias("duration_ms"), payload("pieces", "int").alias("pieces"))


@register("json_array_size", O.with_("""
SELECT event_id, p_contributors AS contributors FROM silver WHERE event_type IN ('puzzle_completed', 'puzzle_started')""",
    "silver"))
def q_json_array_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: element count of the contributors array (null when the field is absent)."""
    from tessera.functions import json_array_size, payload

    ev = shared_model(spark, sf_dir).events
    return ev.filter(F.col("event_type").isin("puzzle_completed", "puzzle_started")).select(
        "event_id", json_array_size(payload("contributors")).alias("contributors"))


@register("date_key", O.with_(f"SELECT event_id, {O.dkey('event_date')} AS date_key FROM silver", "silver"))
def q_date_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yyyyMMdd integer keys."""
    from tessera.functions import date_key

    return shared_model(spark, sf_dir).events.select("event_id", date_key("event_date").alias("date_key"))


@register("filter_predicates", O.with_("""
SELECT outcome, count(*) AS moves FROM moves
WHERE (outcome IN ('dropped', 'abandoned') AND hold_ms BETWEEN 1000 AND 20000 AND group_id IS NOT NULL)
   OR (abandon_reason = 'timeout' AND hold_ms > 30000) OR (outcome != 'open' AND ended_at IS NULL)
GROUP BY outcome""", "moves"))
def q_filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isin, between, null tests, comparisons, and/or."""
    c = F.col
    pred = ((c("outcome").isin("dropped", "abandoned") & c("hold_ms").between(1000, 20000) & c("group_id").isNotNull())
            | ((c("abandon_reason") == "timeout") & (c("hold_ms") > 30000))
            | ((c("outcome") != "open") & c("ended_at").isNull()))
    return shared_model(spark, sf_dir).moves.filter(pred).groupBy("outcome").agg(F.count(F.lit(1)).alias("moves"))


@register("size_bucket", O.with_("""
SELECT puzzle_id, CASE WHEN room_type = 'global' THEN 'global' WHEN pieces <= 36 THEN '24' WHEN pieces <= 72 THEN '48'
                       WHEN pieces <= 120 THEN '96' ELSE '150' END AS size,
       CASE WHEN room_type = 'global' THEN 0 ELSE pieces END AS sort_key
FROM fact_puzzle WHERE pieces IS NOT NULL""", "fact_puzzle"))
def q_size_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzle size bucket and its sort key (global first)."""
    from tessera.functions import size_bucket, size_sort_key

    fp = shared_model(spark, sf_dir).fact_puzzle
    return fp.filter(F.col("pieces").isNotNull()).select("puzzle_id", size_bucket().alias("size"),
                                                        size_sort_key().alias("sort_key"))


@register("safe_ratio", O.with_("""
SELECT puzzle_id, CAST(snaps AS BIGINT) * 1000000000 + 29723691904407 AS n, CAST(moves AS BIGINT) * 4000000000 + 131559062756421 * CAST(moves > 0 AS BIGINT) AS d,
       CASE WHEN moves > 0 THEN CAST((2 * 10000::HUGEINT * (CAST(snaps AS BIGINT) * 1000000000 + 29723691904407) + (CAST(moves AS BIGINT) * 4000000000 + 131559062756421))
            // (2 * (CAST(moves AS BIGINT) * 4000000000 + 131559062756421)) AS DOUBLE) / 10000 END AS ratio,
       CASE WHEN moves > 0 THEN CAST((20000 * CAST(snaps AS BIGINT) + moves) // (2 * CAST(moves AS BIGINT)) AS DOUBLE) / 10000 END AS small_ratio
FROM fact_puzzle""", "fact_puzzle"))
def q_safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: exact HALF_UP ratios, null without a denominator, for small counts and for counts beyond a double's digits."""
    from tessera.functions import safe_ratio

    f = shared_model(spark, sf_dir).fact_puzzle
    n = F.col("snaps") * F.lit(1_000_000_000) + F.lit(29_723_691_904_407)
    d = F.col("moves") * F.lit(4_000_000_000) + F.lit(131_559_062_756_421) * (F.col("moves") > 0).cast("long")
    return f.select("puzzle_id", n.alias("n"), d.alias("d"), safe_ratio(n, d).alias("ratio"), safe_ratio("snaps", "moves").alias("small_ratio"))


@register("fill_defaults", O.with_("""
SELECT d.date_key, coalesce(s.sessions, 0) AS sessions, coalesce(s.moves, 0) AS moves, coalesce(s.reason, 'none') AS reason
FROM dim_date d LEFT JOIN (SELECT date_key, count(*) AS sessions, CAST(sum(moves) AS BIGINT) AS moves, max(left_reason) AS reason
                           FROM fact_session WHERE left_reason IS NOT NULL AND players_at_join = 8 GROUP BY date_key) s USING (date_key)""", "dim_date", "fact_session"))
def q_fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults by column type for what a left join does not find."""
    m = shared_model(spark, sf_dir)
    some = m.fact_session.where("left_reason is not null and players_at_join = 8").groupBy("date_key").agg(
        F.count("*").alias("sessions"), F.sum("moves").alias("moves"), F.max("left_reason").alias("reason"))
    return m.dim_date.select("date_key").join(some, "date_key", "left").fillna({"sessions": 0, "moves": 0, "reason": "none"})


@register("label_maps", O.with_(f"""
SELECT a.weekday, a.hour_local, a.traffic_type, w.label AS day, format('{{:02d}}', a.hour_local) AS hour, {_TRAFFIC}, a.sessions
FROM agg_hourly_heatmap a JOIN weekday_names w ON w.code = a.weekday""", "agg_hourly_heatmap", "weekday_names", "traffic_names"))
def q_label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 + P18: codes beside their labels."""
    from tessera.functions import padded_hour, traffic_label, weekday_label

    return shared_model(spark, sf_dir).agg_hourly_heatmap.select(
        "weekday", "hour_local", "traffic_type", weekday_label().alias("day"), padded_hour().alias("hour"), traffic_label().alias("traffic"), "sessions")


@register("daily_table", O.with_(f"""
SELECT date, players, sessions, moves, completed, CASE WHEN sum(sessions) OVER () > 0 THEN CAST(sessions * 10000 // sum(sessions) OVER () AS BIGINT) END AS share_bp
FROM ({_DAILY14}) ORDER BY date DESC""", "dim_date", "fact_session", "fact_puzzle", "per14"))
def q_daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series as a table, newest day first."""
    m = shared_model(spark, sf_dir)
    return S.daily_table(S.api_daily(m.dim_date, m.fact_session, m.fact_puzzle, _periods(m, 14), "human"))


# ---------------------------------------------------------------- queue, batches, run log -------

@register("queue_head", """
SELECT o_custkey, CAST(place AS INTEGER) AS place, o_orderdate, o_orderkey, o_totalprice, o_orderpriority
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') WHERE place <= 3""")
def q_queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three open orders of each customer, oldest first."""
    orders = read_table(spark, sf_dir, "orders")
    heads = X.queue_heads(orders, "o_custkey", ["o_orderdate", "o_orderkey"], 3, F.col("o_orderstatus") == "O")
    return heads.select("o_custkey", "place", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")


@register("ingest_batches", O.with_("""
SELECT event_id, epoch_us(ingested_at) // 2000000 AS tick,
       (row_number() OVER (PARTITION BY epoch_us(ingested_at) // 2000000 ORDER BY ingested_at, source_id) - 1) // 500 AS batch_no
FROM silver""", "silver"))
def q_ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write batch of each event: two-second ticks, 500 events at most."""
    return X.ingest_batches(shared_model(spark, sf_dir).events)


def _run_log(m) -> DataFrame:
    """A run log that the event log derives: each local day's load is a run, whose rows say "running" and then how it ended;
    a day of fewer than 20 sessions failed, and a day without a completed puzzle never ended."""
    days = m.events.groupBy("event_date").agg(
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.max("source_id").alias("top"), F.min("source_id").alias("low"),
        F.count_if(F.col("event_type") == "player_joined").alias("joins"), F.count_if(F.col("event_type") == "puzzle_completed").alias("done"),
    ).withColumn("run_id", F.datediff("event_date", F.lit("2020-01-01").cast("date")).cast("long"))
    null = lambda kind: F.lit(None).cast(kind)
    good = F.col("joins") >= 20
    checks = F.to_json(F.array(F.struct(F.lit("joins").alias("name"), good.alias("passed")), F.struct(F.lit("done").alias("name"), (F.col("done") > 1).alias("passed"))))
    began = days.select("run_id", F.lit(1).cast("long").alias("seq"), "started_at", null("timestamp").alias("finished_at"), F.lit("running").alias("status"),
                        F.lit(False).alias("full_refresh"), (F.col("low") - 1).alias("watermark_from"), null("long").alias("watermark_to"), null("string").alias("row_counts"),
                        null("string").alias("checks"), null("string").alias("error"))
    ended = days.where("done > 0").select(
        "run_id", F.lit(2).cast("long").alias("seq"), "started_at", F.col("ended_at").alias("finished_at"), F.when(good, "success").otherwise("failed").alias("status"),
        F.lit(False).alias("full_refresh"), (F.col("low") - 1).alias("watermark_from"), F.when(good, F.col("top")).alias("watermark_to"), null("string").alias("row_counts"),
        checks.alias("checks"), F.when(~good, F.lit("too few joins")).alias("error"))
    return began.unionByName(ended)


O.cte("daily_runs", ["silver"], """
SELECT datediff('day', DATE '2020-01-01', event_date) AS run_id, min(occurred_at) AS started_at, max(occurred_at) AS ended_at, max(source_id) AS top,
       count(*) FILTER (event_type = 'player_joined') AS joins, count(*) FILTER (event_type = 'puzzle_completed') AS done
FROM silver GROUP BY event_date""")


@register("last_run", O.with_("""
SELECT run_id, CASE WHEN done = 0 THEN 'running' WHEN joins >= 20 THEN 'success' ELSE 'failed' END AS status, started_at,
       CASE WHEN done > 0 THEN ended_at END AS finished_at, CASE WHEN done > 0 AND joins < 20 THEN 'too few joins' END AS error,
       CASE WHEN done > 0 THEN CAST(joins >= 20 AS BIGINT) + CAST(done > 1 AS BIGINT) ELSE 0 END AS passed, CASE WHEN done > 0 THEN 2 ELSE 0 END AS total
FROM daily_runs ORDER BY run_id DESC LIMIT 1""", "daily_runs"))
def q_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 + P19 + P20: the newest run with its error and its passed and total checks."""
    from tessera.plans import runs

    return runs.last_run(_run_log(shared_model(spark, sf_dir)))


@register("last_watermark", O.with_("SELECT CAST(coalesce(max(top) FILTER (done > 0 AND joins >= 20), 0) AS BIGINT) AS watermark FROM daily_runs", "daily_runs"))
def q_last_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest watermark of a successful run."""
    from tessera.plans import runs

    return runs.watermark(_run_log(shared_model(spark, sf_dir)))


# ---------------------------------------------------------------- streaming plans over the stored events
from tessera.streaming import streams as Z  # noqa: E402


def _islands(key: str, where: str, gap: str, columns: str) -> str:
    """Stretches of activity of a key that no silence of ``gap`` cuts."""
    return O.with_(f"""
SELECT {columns} FROM (
  SELECT {key}, occurred_at, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY {key} ORDER BY occurred_at, source_id ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT {key}, occurred_at, source_id,
               coalesce(occurred_at > lag(occurred_at) OVER (PARTITION BY {key} ORDER BY occurred_at, source_id) + INTERVAL {gap}, true) AS starts
        FROM silver WHERE {where}))
GROUP BY {key}, island""", "silver")


@register("stream_daily_activity", O.with_(f"""
SELECT CAST(timezone('UTC', timezone('{C.TIME_ZONE}', CAST(event_date AS TIMESTAMP))) AS TIMESTAMP) AS window_start,
       CAST(timezone('UTC', timezone('{C.TIME_ZONE}', CAST(event_date + 1 AS TIMESTAMP))) AS TIMESTAMP) AS window_end,
       CASE WHEN is_synthetic THEN 'synthetic' WHEN is_bot THEN 'bot' ELSE 'human' END AS traffic_type, count(*) AS events,
       count(*) FILTER (event_type = 'piece_grabbed') AS moves, count(*) FILTER (event_type = 'piece_dropped' AND p_snapped) AS snaps
FROM silver GROUP BY ALL""", "silver"))
def q_stream_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, moves and snaps per local day and traffic class."""
    return Z.activity(shared_model(spark, sf_dir).events)


@register("stream_inactivity_sessions", _islands(
    "client_id", "client_id IS NOT NULL", "6 HOUR",
    "client_id, min(occurred_at) AS session_start, max(occurred_at) + INTERVAL 6 HOUR AS session_end, count(*) AS events, min(occurred_at) AS first_at, max(occurred_at) AS last_at",
))
def q_stream_inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: each player's activity, cut at silences of six hours."""
    return Z.inactivity_sessions(shared_model(spark, sf_dir).events, "6 hours")


@register("stream_room_expiries", _islands(
    "room_slug", "room_slug IS NOT NULL AND room_type = 'private'", f"{C.ROOM_TTL_MS // 1000} SECOND",
    f"room_slug, min(occurred_at) AS active_from, max(occurred_at) AS last_activity_at, max(occurred_at) + INTERVAL {C.ROOM_TTL_MS // 1000} SECOND AS expired_at, count(*) AS events",
))
def q_stream_room_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: each time a private room falls silent for the room's time to live."""
    return Z.room_expiries(shared_model(spark, sf_dir).events)


_HOLD_TIMES = (C.HOLD_TIMEOUT_MS, 12 * 3600 * 1000)


def _hold_sql(ms: int) -> str:
    return f"""
SELECT event_id AS move_id, session_id, p_group_id AS group_id, occurred_at AS grabbed_at,
       CASE WHEN outcome IN ('dropped', 'abandoned') THEN nxt_at END AS ended_at, outcome, CAST({ms} AS BIGINT) AS timeout_ms
FROM (SELECT *, CASE WHEN nxt_at IS NULL OR nxt_at - occurred_at > INTERVAL {ms // 1000} SECOND THEN 'timeout'
                     WHEN nxt_type = 'piece_dropped' AND nxt_group = p_group_id THEN 'dropped'
                     WHEN nxt_type = 'piece_abandoned' AND nxt_group = p_group_id THEN 'abandoned' ELSE 'open' END AS outcome
      FROM (SELECT *, lead(occurred_at) OVER w AS nxt_at, lead(event_type) OVER w AS nxt_type, lead(p_group_id) OVER w AS nxt_group FROM silver
            WHERE event_type IN ('piece_grabbed', 'piece_dropped', 'piece_abandoned') AND session_id IS NOT NULL
            WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at, source_id)))
WHERE event_type = 'piece_grabbed'"""


@register("stream_hold_outcomes", O.with_(" UNION ALL ".join(map(_hold_sql, _HOLD_TIMES)), "silver"))
def q_stream_hold_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each grab within the hold timeout, and within half a day (sockets of the given events seldom act
    twice in 30 seconds)."""
    events = shared_model(spark, sf_dir).events
    short, long = (Z.hold_outcomes(events, timeout_ms=ms).withColumn("timeout_ms", F.lit(ms).cast("long")) for ms in _HOLD_TIMES)
    return short.unionByName(long)
