"""Event histories as text, and plain-Python models of pairing, session statistics and puzzle facts.

A history line is ``seconds kind socket@room/puzzle field=value ...``; a dash stands for null. Seconds count from noon UTC
of 2 March 2026 (06:00 in the zone of the local calendar).
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

SCHEMA = (
    "id long, event_id string, event_type string, schema_version int, occurred_at timestamp, ingested_at timestamp, session_id string, "
    "client_id string, room_slug string, room_type string, puzzle_id string, payload string, is_synthetic boolean"
)
START = datetime(2026, 3, 2, 12)
KINDS = {
    "join": "player_joined", "leave": "player_left", "grab": "piece_grabbed", "drop": "piece_dropped", "abandon": "piece_abandoned", "begin": "puzzle_started",
    "finish": "puzzle_completed", "create": "room_created", "expire": "room_expired",
}


def _value(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def events(history: str) -> list[dict]:
    """The bronze rows of a history. Fields that are columns (client, type, synthetic, id) are taken out of the payload."""
    rows = []
    for n, line in enumerate((x for x in history.strip().splitlines() if x.strip()), start=1):
        seconds, kind, where, *fields = line.split()
        socket, _, place = where.partition("@")
        room, _, puzzle = place.partition("/")
        given = {k: _value(v) for k, v in (f.split("=", 1) for f in fields)}
        null = lambda x: None if x in ("-", "") else x
        at = START + timedelta(seconds=float(seconds))
        rows.append({
            "id": n, "event_id": given.pop("id", f"ev{n}"), "event_type": KINDS[kind], "schema_version": 1, "occurred_at": at, "ingested_at": at, "session_id": null(socket),
            "client_id": given.pop("client", null(socket) and f"u-{socket}"), "room_slug": null(room), "room_type": given.pop("type", "private"), "puzzle_id": null(puzzle),
            "is_synthetic": given.pop("synthetic", False), "payload": given.pop("raw", None) or json.dumps(given),
        })
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows if isinstance(rows, list) else events(rows), SCHEMA)


def _next_of(rows, kinds, key):
    """(row, next row of the same key and kinds), in time order."""
    mine = sorted((r for r in rows if r["event_type"] in kinds and r["session_id"] is not None), key=lambda r: (r["occurred_at"], r["id"]))
    for i, r in enumerate(mine):
        yield r, next((x for x in mine[i + 1 :] if key(x) == key(r)), None)


def moves(rows) -> dict[str, dict]:
    out = {}
    for r, nxt in _next_of(rows, ("piece_grabbed", "piece_dropped", "piece_abandoned"), lambda x: x["session_id"]):
        if r["event_type"] != "piece_grabbed":
            continue
        own, end = json.loads(r["payload"]), json.loads(nxt["payload"]) if nxt else {}
        closed = nxt is not None and nxt["event_type"] != "piece_grabbed" and own.get("group_id") is not None and own.get("group_id") == end.get("group_id")
        end = end if closed else {}
        out[r["event_id"]] = {
            "session_id": r["session_id"], "room_slug": r["room_slug"], "puzzle_id": r["puzzle_id"], "grabbed_at": r["occurred_at"], "client_id": r["client_id"],
            "ended_at": nxt["occurred_at"] if closed else None, "outcome": {"piece_dropped": "dropped", "piece_abandoned": "abandoned"}[nxt["event_type"]] if closed else "open",
            "hold_ms": end.get("hold_ms"), "abandon_reason": end.get("reason"), "snapped": end.get("snapped", False), "merged_groups": end.get("merged_groups", 0),
            "group_size_after": end.get("group_size"),
        }
    return out


def sessions(rows) -> dict[str, dict]:
    """Joins with their leaves and what was grabbed between the two, by looking at every move for every session."""
    grabbed, out = moves(rows), {}
    for r, nxt in _next_of(rows, ("player_joined", "player_left"), lambda x: (x["session_id"], x["room_slug"])):
        if r["event_type"] != "player_joined":
            continue
        left = nxt if nxt is not None and nxt["event_type"] == "player_left" else None
        inside = [
            (k, m) for k, m in grabbed.items()
            if r["room_slug"] is not None and (m["session_id"], m["room_slug"]) == (r["session_id"], r["room_slug"])
            and m["grabbed_at"] >= r["occurred_at"] and (left is None or m["grabbed_at"] <= left["occurred_at"])
        ]
        out[r["event_id"]] = {
            "left_at": left and left["occurred_at"], "moves": len(inside), "snaps": sum(m["snapped"] for _, m in inside),
            "groups_merged": sum(m["merged_groups"] for _, m in inside), "puzzles_played": len({m["puzzle_id"] for _, m in inside} - {None}),
        }
    return out


def puzzles(rows) -> dict[str, dict]:
    """Started or completed puzzles: lifecycle from the earliest event of each type, counts from the moves."""
    out = {}
    for name in {r["puzzle_id"] for r in rows if r["event_type"] in ("puzzle_started", "puzzle_completed")} - {None}:
        first = {}
        for r in sorted(rows, key=lambda r: (r["occurred_at"], r["id"])):
            if r["puzzle_id"] == name:
                first.setdefault(r["event_type"], r)
        begun, done = first.get("puzzle_started"), first.get("puzzle_completed")
        mine = [m for m in moves(rows).values() if m["puzzle_id"] == name]
        bots = sum((m["client_id"] or "").startswith("bot-") for m in mine)
        snaps = sum(m["snapped"] for m in mine)
        text = lambda r, k: json.loads(r["payload"]).get(k) if r else None
        synthetic = (begun or done)["is_synthetic"]
        out[name] = {
            "pieces": text(begun, "pieces") if text(begun, "pieces") is not None else text(done, "pieces"), "source": text(begun, "source") or "unknown",
            "is_completed": done is not None, "duration_ms": text(done, "duration_ms"), "moves": len(mine), "snaps": snaps,
            "groups_merged": sum(m["merged_groups"] for m in mine), "players": len({m["client_id"] for m in mine} - {None}),
            "contributors": None if text(done, "contributors") is None else len(text(done, "contributors")),
            "snap_rate": None if not mine else int((20000 * snaps + len(mine)) // (2 * len(mine))) / 10000,
            "traffic_type": "synthetic" if synthetic else "none" if not mine else "bot" if bots == len(mine) else "mixed" if bots else "human",
        }
    return out
