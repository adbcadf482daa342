"""Fixed values of the event model. These must equal the game's own values for the results to agree."""

from __future__ import annotations

# --- fixed values: time zone of the local calendar -------------------------------------------
TIME_ZONE = "America/Mexico_City"

# --- fixed values: event types ---------------------------------------------------------------
ROOM_CREATED = "room_created"
PUZZLE_STARTED = "puzzle_started"
PLAYER_JOINED = "player_joined"
JOIN_FAILED = "join_failed"
PLAYER_LEFT = "player_left"
PIECE_GRABBED = "piece_grabbed"
GRAB_CONFLICT = "grab_conflict"
PIECE_DROPPED = "piece_dropped"
PIECE_ABANDONED = "piece_abandoned"
PUZZLE_COMPLETED = "puzzle_completed"
GLOBAL_ROTATED = "global_rotated"
ROOM_EXPIRED = "room_expired"

MOVE_EVENTS = (PIECE_GRABBED, PIECE_DROPPED, PIECE_ABANDONED)
MOVE_CLOSERS = (PIECE_DROPPED, PIECE_ABANDONED)
PRESENCE_EVENTS = (PLAYER_JOINED, PLAYER_LEFT)
FRICTION_EVENTS = (JOIN_FAILED, GRAB_CONFLICT, GLOBAL_ROTATED)

# --- fixed values: traffic classes -----------------------------------------------------------
SYNTHETIC, BOT, HUMAN, MIXED, NONE = "synthetic", "bot", "human", "mixed", "none"
BOT_PREFIX = "bot-"

# --- fixed values: game rules ----------------------------------------------------------------
HOLD_TIMEOUT_MS = 30_000  # an untouched hold is released after 30 s
ROOM_TTL_MS = 24 * 3600 * 1000  # private rooms expire after 24 h idle
FUTURE_TOLERANCE_MINUTES = 10
OPEN_END = "9999-12-31"  # open interval end for sessions without a leave

# --- fixed values: dashboard parameters ------------------------------------------------------
DASHBOARD_DAYS = (7, 14, 30, 90)
DEFAULT_DAYS = 30
TRAFFIC_FILTERS = ("all", "human", "bot", "synthetic")
HEATMAP_STEPS = 7

# --- fixed values: dashboard labels (Spanish, as shown to users) -----------------------------
WEEKDAY_LABELS = {1: "1 lun", 2: "2 mar", 3: "3 mié", 4: "4 jue", 5: "5 vie", 6: "6 sáb", 7: "7 dom"}
TRAFFIC_LABELS = {"human": "Humanos", "bot": "Bots", "synthetic": "Sintético", "mixed": "Humanos"}
TRAFFIC_LABEL_OTHER = "Sin jugadas"
ROOM_LABELS = {"global": "Sala global"}
ROOM_LABEL_OTHER = "Salas privadas"
SIZE_LABELS = {
    "global": "0 · Global 5×5",
    "24": "1 · 24 piezas",
    "48": "2 · 48 piezas",
    "96": "3 · 96 piezas",
    "150": "4 · 150 piezas",
}
# Puzzle size buckets: pieces <= 36 -> 24, <= 72 -> 48, <= 120 -> 96, else 150.
SIZE_BOUNDS = ((36, "24"), (72, "48"), (120, "96"))
SIZE_LARGEST = "150"


def session_types(traffic: str) -> list[str]:
    """Session traffic classes selected by a dashboard filter."""
    return [HUMAN, BOT, SYNTHETIC] if traffic == "all" else [traffic]


def puzzle_types(traffic: str) -> list[str]:
    """Puzzle traffic classes: `all` also covers mixed and none, `human` includes mixed."""
    if traffic == "all":
        return [HUMAN, MIXED, BOT, SYNTHETIC, NONE]
    if traffic == "human":
        return [HUMAN, MIXED]
    return [traffic]


def validate_dashboard_params(days, traffic) -> tuple[int, str]:
    """Unknown values fall back to 30 days and all traffic."""
    try:
        d = int(days)
    except (TypeError, ValueError):
        d = DEFAULT_DAYS
    if d not in DASHBOARD_DAYS:
        d = DEFAULT_DAYS
    t = traffic if traffic in TRAFFIC_FILTERS else "all"
    return d, t
