"""Independent SQL (DuckDB dialect) for every registered query, over the driver's raw tables.

Each query is ``WITH <the CTEs it needs> SELECT ...``. The CTEs restate the adapter, silver, gold and serving
semantics in plain SQL (window ``lead`` pairing and a real range join), so they share no code with the
Spark side. Local time is ``timezone(zone, timezone('UTC', ts))`` so the result does not depend on the
DuckDB session zone. Ratios and minutes use exact integer HALF_UP rounding, like the Spark side.
"""

from __future__ import annotations

from tessera import constants as C

TZ = C.TIME_ZONE

_CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    _CTES[name] = (deps, sql)


def ratio(num: str, den: str, digits: int = 4) -> str:
    scale = 10**digits
    return (
        f"(CASE WHEN ({den}) > 0 THEN CAST((CAST({num} AS BIGINT) * {2 * scale} + ({den})) "
        f"// (2 * CAST({den} AS BIGINT)) AS DOUBLE) / {scale} END)"
    )


def minutes(ms: str, digits: int = 2) -> str:
    return ratio(ms, "60000", digits)


def local(ts: str) -> str:
    return f"timezone('{TZ}', timezone('UTC', {ts}))"


def dkey(d: str) -> str:
    return f"CAST(strftime({d}, '%Y%m%d') AS INTEGER)"


def with_(final_sql: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    body = ",\n".join(f"{n} AS (\n{_CTES[n][1]}\n)" for n in order)
    return f"WITH {body}\n{final_sql}"


def _pieces(k: str) -> str:
    return f"(CASE {k} % 4 WHEN 0 THEN 24 WHEN 1 THEN 48 WHEN 2 THEN 96 ELSE 150 END)"


# ---------------------------------------------------------------- adapter -------------------
cte("src", [], """
SELECT event_id AS eid, event_id + 1 AS id, CAST(ts AS TIMESTAMP) AS ts, user_id AS uid, event_type AS dtype, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 10 AS m
FROM events""")

_ET = """CASE dtype
  WHEN 'signup' THEN CASE WHEN m = 0 THEN 'puzzle_started' WHEN m = 5 THEN 'room_created' ELSE 'player_joined' END
  WHEN 'error' THEN CASE WHEN m = 0 THEN 'puzzle_completed' WHEN m = 5 THEN 'room_expired' ELSE 'player_left' END
  WHEN 'click' THEN 'piece_grabbed'
  WHEN 'purchase' THEN CASE WHEN m = 5 THEN 'global_rotated' ELSE 'piece_dropped' END
  WHEN 'view' THEN CASE WHEN m = 0 THEN 'grab_conflict' WHEN m = 5 THEN 'join_failed' ELSE 'piece_abandoned' END
END"""


def _bronze_sql(dup: bool) -> str:
    key = "CASE WHEN eid % 20 = 19 THEN eid - 1 ELSE eid END" if dup else "eid"
    return f"""
SELECT id, CAST({key} AS VARCHAR) AS event_id, {_ET} AS event_type, 1 AS schema_version,
       ts AS occurred_at, ts + INTERVAL 300 MILLISECOND AS ingested_at,
       's-' || CAST(uid AS VARCHAR) AS session_id,
       (CASE WHEN uid % 5 = 0 THEN 'bot-' ELSE 'u-' END) || CAST(uid AS VARCHAR) AS client_id,
       'r-' || CAST(uid % 8 AS VARCHAR) AS room_slug,
       CASE WHEN uid % 8 = 0 THEN 'global' ELSE 'private' END AS room_type,
       'r-' || CAST(uid % 8 AS VARCHAR) || ':' || strftime(ts, '%Y%m%d') AS puzzle_id,
       uid % 7 = 0 AS is_synthetic, k, value
FROM src"""


cte("bronze", ["src"], _bronze_sql(False))
cte("bronze_dup", ["src"], _bronze_sql(True))

_PAYLOAD = f"""
  CASE WHEN event_type IN ('piece_grabbed','grab_conflict','piece_dropped','piece_abandoned') THEN k % 3 END AS p_group_id,
  CASE WHEN event_type IN ('piece_grabbed','piece_dropped') THEN 1 + k % 5 END AS p_group_size,
  CASE WHEN event_type IN ('piece_dropped','piece_abandoned') THEN CAST(round(value * 1000) AS BIGINT) END AS p_hold_ms,
  CASE WHEN event_type = 'piece_dropped' THEN k % 2 = 0 END AS p_snapped,
  CASE WHEN event_type = 'piece_dropped' THEN k % 4 = 0 END AS p_frame,
  CASE WHEN event_type = 'piece_dropped' THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS p_merged_groups,
  CASE WHEN event_type = 'player_left' THEN CASE k % 2 WHEN 0 THEN 'disconnect' ELSE 'switch' END
       WHEN event_type = 'piece_abandoned' THEN CASE k % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'regrab' ELSE 'timeout' END
  END AS p_reason,
  CASE WHEN event_type IN ('player_left','puzzle_completed') THEN CAST(round(value * 60000) AS BIGINT) END AS p_duration_ms,
  CASE WHEN event_type IN ('puzzle_started','puzzle_completed') THEN {_pieces('k')} END AS p_pieces,
  CASE WHEN event_type = 'room_created' THEN {_pieces('k')} END AS p_pieces_requested,
  CASE WHEN event_type = 'room_created' THEN 640 + k END AS p_image_width,
  CASE WHEN event_type = 'room_created' THEN 480 + k END AS p_image_height,
  CASE WHEN event_type IN ('puzzle_started','global_rotated') THEN
       CASE k % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'restart' WHEN 2 THEN 'queue' WHEN 3 THEN 'reshuffle' ELSE 'default' END
  END AS p_source,
  CASE WHEN event_type = 'player_joined' THEN 'n-' || CAST(k % 10 AS VARCHAR) END AS p_name,
  CASE WHEN event_type IN ('player_joined','player_left','puzzle_completed') THEN 1 + k % 8 END AS p_players_in_room,
  CASE WHEN event_type = 'puzzle_completed' THEN 1 + k % 3 END AS p_contributors,
  CASE WHEN event_type = 'join_failed' THEN 'room_full' END AS p_error,
  CASE WHEN event_type = 'global_rotated' THEN CASE WHEN k % 2 = 0 THEN 'auto' ELSE 'admin' END END AS p_trigger,
  CASE WHEN event_type = 'room_expired' THEN CAST(round(value * 3600000) AS BIGINT) END AS p_age_ms,
  CASE WHEN event_type = 'room_expired' THEN CAST(round(value * 60000) AS BIGINT) END AS p_idle_ms,
  CASE WHEN event_type = 'grab_conflict' THEN CAST(round(value * 1000) AS BIGINT) END AS p_held_ms"""


def _silver_sql(source: str) -> str:
    return f"""
SELECT event_id, id AS source_id, event_type, CAST(schema_version AS SMALLINT) AS schema_version, occurred_at,
       ingested_at, session_id, client_id, room_slug, room_type, puzzle_id,
       coalesce(is_synthetic, false) AS is_synthetic, coalesce(starts_with(client_id, 'bot-'), false) AS is_bot,
       CAST({local('occurred_at')} AS DATE) AS event_date,
       CAST(hour({local('occurred_at')}) AS INTEGER) AS hour_local,
       CAST(isodow({local('occurred_at')}) AS INTEGER) AS weekday,
       CASE WHEN coalesce(is_synthetic, false) THEN 'synthetic'
            WHEN coalesce(starts_with(client_id, 'bot-'), false) THEN 'bot' ELSE 'human' END AS traffic_type,
       {_PAYLOAD}
FROM {source}
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id) = 1"""


cte("silver", ["bronze"], _silver_sql("bronze"))
cte("silver_dup", ["bronze_dup"], _silver_sql("bronze_dup"))

# ---------------------------------------------------------------- silver moves / sessions ---
# The numbered events of a socket (or of a socket in a room): an opener's row ends with the event of the next number, if that
# is a closer of it.
cte("numbered_moves", ["silver"], """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, source_id) AS n
FROM silver WHERE session_id IS NOT NULL AND event_type IN ('piece_grabbed', 'piece_dropped', 'piece_abandoned')""")

cte("moves", ["numbered_moves"], """
SELECT g.event_id AS move_id, g.session_id, g.client_id, g.room_slug, g.room_type, g.puzzle_id, g.p_group_id AS group_id,
       g.p_group_size AS group_size_before, g.occurred_at AS grabbed_at, e.occurred_at AS ended_at,
       coalesce(e.event_type[7:], 'open') AS outcome, e.p_hold_ms AS hold_ms, e.p_reason AS abandon_reason,
       e.p_snapped IS TRUE AS snapped, e.p_frame IS TRUE AS frame, coalesce(e.p_merged_groups, 0) AS merged_groups,
       e.p_group_size AS group_size_after, g.event_date, g.hour_local, g.weekday, g.is_bot, g.is_synthetic, g.traffic_type
FROM numbered_moves g
LEFT JOIN numbered_moves e ON e.session_id = g.session_id AND e.n = g.n + 1 AND e.p_group_id = g.p_group_id AND e.event_type <> 'piece_grabbed'
WHERE g.event_type = 'piece_grabbed'""")

cte("numbered_presence", ["silver"], """
SELECT *, row_number() OVER (PARTITION BY session_id, room_slug ORDER BY occurred_at, source_id) AS n
FROM silver WHERE session_id IS NOT NULL AND event_type IN ('player_joined', 'player_left')""")

cte("visits", ["numbered_presence"], """
SELECT j.event_id AS session_key, j.session_id, j.client_id, j.p_name AS player_name, j.room_slug, j.room_type, j.occurred_at AS joined_at,
       l.occurred_at AS left_at, l.p_reason AS left_reason, l.p_duration_ms AS duration_ms, j.p_players_in_room AS players_at_join,
       j.event_date, j.hour_local, j.weekday, j.is_bot, j.is_synthetic, j.traffic_type
FROM numbered_presence j
LEFT JOIN numbered_presence l ON l.session_id = j.session_id AND l.room_slug IS NOT DISTINCT FROM j.room_slug AND l.n = j.n + 1 AND l.event_type = 'player_left'
WHERE j.event_type = 'player_joined'""")

cte("sessions", ["visits", "moves"], """
SELECT visits.*, count(move_id) AS moves, count(*) FILTER (snapped) AS snaps, CAST(coalesce(sum(merged_groups), 0) AS BIGINT) AS groups_merged,
       count(DISTINCT puzzle_id) AS puzzles_played
FROM visits LEFT JOIN (SELECT session_id, room_slug, grabbed_at, move_id, snapped, merged_groups, puzzle_id FROM moves) AS m
  ON (m.session_id, m.room_slug) = (visits.session_id, visits.room_slug) AND grabbed_at BETWEEN joined_at AND coalesce(left_at, 'infinity')
GROUP BY ALL""")

# ---------------------------------------------------------------- gold ----------------------
cte("dim_date", ["silver"], f"""
SELECT {dkey('d')} AS date_key, d AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
       CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS weekday, dayname(d) AS weekday_name,
       CAST(week(d) AS INTEGER) AS iso_week, isodow(d) IN (6, 7) AS is_weekend
FROM (SELECT CAST(unnest(generate_series(CAST(min(event_date) AS TIMESTAMP), CAST(max(event_date) AS TIMESTAMP),
                                         INTERVAL 1 DAY)) AS DATE) AS d
      FROM silver)""")

cte("dim_player", ["silver", "sessions"], """
SELECT client_id, min(occurred_at) AS first_seen_at, max(occurred_at) AS last_seen_at, bool_or(is_bot) AS is_bot, bool_or(is_synthetic) AS is_synthetic,
       (SELECT player_name FROM sessions v WHERE v.client_id = c.client_id ORDER BY joined_at DESC, session_key DESC LIMIT 1) AS latest_name,
       (SELECT count(*) FROM sessions v WHERE v.client_id = c.client_id) AS sessions,
       (SELECT CAST(coalesce(sum(v.moves), 0) AS BIGINT) FROM sessions v WHERE v.client_id = c.client_id) AS moves,
       (SELECT count(DISTINCT v.event_date) FROM sessions v WHERE v.client_id = c.client_id) AS active_days,
       ['human', 'bot', 'synthetic'][1 + max(CASE WHEN is_synthetic THEN 2 WHEN is_bot THEN 1 ELSE 0 END)] AS traffic_type
FROM silver c WHERE client_id IS NOT NULL GROUP BY client_id""")

cte("dim_room", ["silver"], """
SELECT named.room_slug, named.room_type, (SELECT count(DISTINCT puzzle_id) FROM silver x WHERE x.room_slug = named.room_slug AND x.room_type IS NOT NULL) AS puzzles,
       (SELECT bool_or(is_synthetic) FROM silver x WHERE x.room_slug = named.room_slug AND x.room_type IS NOT NULL) AS is_synthetic,
       coalesce(made.occurred_at, named.occurred_at) AS created_at, made.p_pieces_requested AS pieces_requested, made.p_image_width AS image_width,
       made.p_image_height AS image_height, (SELECT max(occurred_at) FROM silver x WHERE x.room_slug = named.room_slug AND x.event_type = 'room_expired') AS expired_at
FROM (SELECT DISTINCT ON (room_slug) * FROM silver WHERE room_type IS NOT NULL AND room_slug IS NOT NULL ORDER BY room_slug, occurred_at, source_id) named
LEFT JOIN (SELECT DISTINCT ON (room_slug) * FROM silver WHERE event_type = 'room_created' ORDER BY room_slug, occurred_at, source_id) made USING (room_slug)""")

# The first event of either kind of each puzzle; the puzzle's synthetic flag is that of any event of the kind that counts.
cte("milestones", ["silver"], """
SELECT DISTINCT ON (puzzle_id, event_type) *, bool_or(is_synthetic) OVER (PARTITION BY puzzle_id, event_type) AS any_synthetic
FROM silver WHERE puzzle_id IS NOT NULL AND event_type IN ('puzzle_started', 'puzzle_completed') ORDER BY puzzle_id, event_type, occurred_at, source_id""")

cte("fact_puzzle", ["milestones", "moves"], f"""
SELECT puzzle_id, room_slug, room_type, {dkey("CAST(" + local("coalesce(started_at, first_move_at, completed_at)") + " AS DATE)")} AS date_key, source, pieces,
       started_at, first_move_at, completed_at, completed_at IS NOT NULL AS is_completed, duration_ms, moves, snaps, abandoned_moves, groups_merged, players,
       contributors, {ratio("snaps", "moves")} AS snap_rate,
       CASE WHEN synthetic THEN 'synthetic' WHEN moves = 0 THEN 'none' WHEN bots = 0 THEN 'human' WHEN bots < moves THEN 'mixed' ELSE 'bot' END AS traffic_type
FROM (SELECT puzzle_id, first(room_slug ORDER BY event_type DESC) AS room_slug, first(room_type ORDER BY event_type DESC) AS room_type,
             coalesce(any_value(p_source) FILTER (event_type = 'puzzle_started'), 'unknown') AS source, any_value(p_pieces ORDER BY event_type DESC) AS pieces,
             any_value(occurred_at) FILTER (event_type = 'puzzle_started') AS started_at, any_value(occurred_at) FILTER (event_type = 'puzzle_completed') AS completed_at,
             any_value(p_duration_ms) FILTER (event_type = 'puzzle_completed') AS duration_ms, any_value(p_contributors) AS contributors,
             first(any_synthetic ORDER BY event_type DESC) AS synthetic
      FROM milestones GROUP BY puzzle_id) milestones_of
LEFT JOIN LATERAL (SELECT count(*) AS moves, count(*) FILTER (m.snapped) AS snaps, count(*) FILTER (m.outcome = 'abandoned') AS abandoned_moves,
                          CAST(coalesce(sum(m.merged_groups), 0) AS BIGINT) AS groups_merged, count(DISTINCT m.client_id) AS players, count(*) FILTER (m.is_bot) AS bots,
                          min(m.grabbed_at) AS first_move_at
                   FROM moves m WHERE m.puzzle_id = milestones_of.puzzle_id) ON true""")

cte("fact_session", ["sessions"], f"""
SELECT session_key, session_id, client_id, room_slug, room_type, {dkey('event_date')} AS date_key, hour_local, weekday,
       joined_at, left_at, left_reason, duration_ms, players_at_join, moves, snaps, groups_merged, puzzles_played,
       traffic_type
FROM sessions""")

cte("fact_move", ["moves"], f"""
SELECT move_id, session_id, client_id, room_slug, room_type, puzzle_id, {dkey('event_date')} AS date_key, hour_local,
       weekday, group_id, group_size_before, group_size_after, grabbed_at, ended_at, outcome, abandon_reason, hold_ms,
       snapped, frame, merged_groups, traffic_type
FROM moves""")

cte("agg_daily_activity", ["fact_session", "fact_move"], f"""
SELECT coalesce(a.date_key, b.date_key) AS date_key, coalesce(a.room_type, b.room_type) AS room_type,
       coalesce(a.traffic_type, b.traffic_type) AS traffic_type, coalesce(a.sessions, 0) AS sessions,
       coalesce(a.active_players, 0) AS active_players, a.median_session_min, coalesce(b.moves, 0) AS moves,
       coalesce(b.snaps, 0) AS snaps, b.median_hold_ms, {ratio("coalesce(b.snaps, 0)", "coalesce(b.moves, 0)")} AS snap_rate
FROM (SELECT date_key, room_type, traffic_type, count(*) AS sessions, count(DISTINCT client_id) AS active_players,
             {minutes("quantile_disc(duration_ms, 0.5)")} AS median_session_min
      FROM fact_session GROUP BY date_key, room_type, traffic_type) a
FULL OUTER JOIN (SELECT date_key, room_type, traffic_type, count(*) AS moves,
                        CAST(sum(CAST(snapped AS INTEGER)) AS BIGINT) AS snaps,
                        quantile_disc(hold_ms, 0.5) AS median_hold_ms
                 FROM fact_move GROUP BY date_key, room_type, traffic_type) b
  ON a.date_key = b.date_key AND a.room_type = b.room_type AND a.traffic_type = b.traffic_type""")

cte("agg_daily_puzzles", ["fact_puzzle"], f"""
SELECT *, {ratio("puzzles_completed", "puzzles_played")} AS completion_rate
FROM (SELECT date_key, room_type, traffic_type, count(*) AS puzzles_started,
             CAST(sum(CAST(moves > 0 AS INTEGER)) AS BIGINT) AS puzzles_played,
             CAST(sum(CAST(is_completed AS INTEGER)) AS BIGINT) AS puzzles_completed,
             {minutes("quantile_disc(duration_ms, 0.5)")} AS median_duration_min
      FROM fact_puzzle GROUP BY date_key, room_type, traffic_type)""")

cte("agg_hourly_heatmap", ["fact_session", "fact_move"], """
SELECT coalesce(a.weekday, b.weekday) AS weekday, coalesce(a.hour_local, b.hour_local) AS hour_local,
       coalesce(a.traffic_type, b.traffic_type) AS traffic_type, coalesce(a.sessions, 0) AS sessions,
       coalesce(a.players, 0) AS players, coalesce(b.moves, 0) AS moves
FROM (SELECT weekday, hour_local, traffic_type, count(*) AS sessions, count(DISTINCT client_id) AS players
      FROM fact_session GROUP BY weekday, hour_local, traffic_type) a
FULL OUTER JOIN (SELECT weekday, hour_local, traffic_type, count(*) AS moves
                 FROM fact_move GROUP BY weekday, hour_local, traffic_type) b
  ON a.weekday = b.weekday AND a.hour_local = b.hour_local AND a.traffic_type = b.traffic_type""")

cte("agg_difficulty", ["fact_puzzle"], f"""
SELECT pieces, room_type, traffic_type, started, played, completed, median_duration_min,
       {ratio("done_moves", "done * pieces", 2)} AS moves_per_piece,
       {ratio("rate_bp", "rated", 0)} / 10000 AS avg_snap_rate,
       {ratio("played", "started")} AS play_rate, {ratio("completed", "played")} AS completion_rate
FROM (SELECT pieces, room_type, traffic_type, count(*) AS started,
             CAST(sum(CAST(moves > 0 AS INTEGER)) AS BIGINT) AS played,
             CAST(sum(CAST(is_completed AS INTEGER)) AS BIGINT) AS completed,
             {minutes("quantile_disc(duration_ms, 0.5)")} AS median_duration_min,
             sum(moves) FILTER (WHERE is_completed) AS done_moves, count(*) FILTER (WHERE is_completed) AS done,
             sum(CAST(round(snap_rate * 10000) AS BIGINT)) AS rate_bp, count(snap_rate) AS rated
      FROM fact_puzzle WHERE pieces IS NOT NULL GROUP BY pieces, room_type, traffic_type)""")
