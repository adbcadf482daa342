"""Serving: the admin dashboard (KPIs against the previous period, daily series, heatmap, difficulty, last
run), the public virtual datasets and their charts, all over the published gold tables.

Period bounds are two scalars (a max over the small calendar dimension), read once on the driver; every
other step is a distributed aggregate. ``as_of`` is the local "today": ranges end at the last *complete*
day before it, and nothing reads the clock.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators.quantile import exact_percentile
from tessera.functions import (
    padded_hour,
    room_label,
    size_bucket,
    size_label,
    size_sort_key,
    traffic_label,
    weekday_label,
)


@dataclass(frozen=True)
class Periods:
    to: dt.date
    frm: dt.date
    prev_to: dt.date
    prev_from: dt.date

    @staticmethod
    def key(d: dt.date) -> int:
        return int(d.strftime("%Y%m%d"))


def last_complete_day(dim_date: DataFrame, as_of) -> DataFrame:
    """max(date) before the (partial) current local day."""
    return dim_date.filter(F.col("date") < F.lit(as_of).cast("date")).agg(F.max("date").alias("max_date"))


def periods(dim_date: DataFrame, as_of, days: int) -> Periods | None:
    """[to - days + 1, to] and the preceding period of equal length; None when there is no data."""
    row = last_complete_day(dim_date, as_of).first()
    if row is None or row["max_date"] is None:
        return None
    to = row["max_date"]
    frm = to - dt.timedelta(days=days - 1)
    prev_to = frm - dt.timedelta(days=1)
    return Periods(to, frm, prev_to, prev_to - dt.timedelta(days=days - 1))


def _period_label(p: Periods) -> F.Column:
    k = F.col("date_key")
    return (
        F.when(k.between(p.key(p.frm), p.key(p.to)), "current")
        .when(k.between(p.key(p.prev_from), p.key(p.prev_to)), "previous")
    )


def _both_periods(spark: SparkSession, agg: DataFrame) -> DataFrame:
    spine = spark.createDataFrame([("current",), ("previous",)], "period string")
    return spine.join(agg, "period", "left")


def kpis_sessions(spark: SparkSession, f_session: DataFrame, p: Periods, traffic: str) -> DataFrame:
    """A17 for both periods in one aggregate: players, sessions, exact median minutes, snap rate."""
    rows = (
        f_session.filter(F.col("traffic_type").isin(*C.session_types(traffic)))
        .withColumn("period", _period_label(p))
        .filter(F.col("period").isNotNull())
    )
    agg = rows.groupBy("period").agg(
        F.countDistinct("client_id").alias("players"),
        F.count(F.lit(1)).alias("sessions"),
        (F.sum("snaps").cast("double") / F.nullif(F.sum("moves"), F.lit(0))).alias("snap_rate"),
    )
    # Exact median without a per-group value buffer (the period groups are as large as the data).
    median = exact_percentile(rows, ["period"], "duration_ms", 0.5, "_median_ms")
    agg = agg.join(median, "period", "left").withColumn("median_min", F.col("_median_ms") / 60000.0)
    return _both_periods(spark, agg).select(
        "period",
        F.coalesce("players", F.lit(0).cast("long")).alias("players"),
        F.coalesce("sessions", F.lit(0).cast("long")).alias("sessions"),
        "median_min",
        "snap_rate",
    )


def kpis_puzzles(spark: SparkSession, f_puzzle: DataFrame, p: Periods, traffic: str) -> DataFrame:
    """A18 for both periods: completed puzzles and completion rate (completed / played)."""
    done = F.count_if(F.col("is_completed"))
    agg = (
        f_puzzle.filter(F.col("traffic_type").isin(*C.puzzle_types(traffic)))
        .withColumn("period", _period_label(p))
        .filter(F.col("period").isNotNull())
        .groupBy("period")
        .agg(
            done.alias("completed"),
            (done.cast("double") / F.nullif(F.count_if(F.col("moves") > 0), F.lit(0))).alias("completion_rate"),
        )
    )
    return _both_periods(spark, agg).select(
        "period", F.coalesce("completed", F.lit(0).cast("long")).alias("completed"), "completion_rate"
    )


def kpis(spark: SparkSession, f_session: DataFrame, f_puzzle: DataFrame, p: Periods, traffic: str) -> DataFrame:
    """The six dashboard KPIs, one row per period."""
    return kpis_sessions(spark, f_session, p, traffic).join(kpis_puzzles(spark, f_puzzle, p, traffic), "period")


KPI_COLUMNS = ["players", "sessions", "completed", "completion_rate", "snap_rate", "median_min"]


def kpi_delta(kpi_table: DataFrame) -> DataFrame:
    """Change of each KPI against the previous period: null if either side is missing or the previous
    value is 0, `flat` under 0.5 %, else the rounded percentage with a direction."""
    cur = kpi_table.filter(F.col("period") == "current")
    prev = kpi_table.filter(F.col("period") == "previous")
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in KPI_COLUMNS)
    long_cur = cur.selectExpr(f"stack({len(KPI_COLUMNS)}, {stack}) AS (kpi, now)")
    long_prev = prev.selectExpr(f"stack({len(KPI_COLUMNS)}, {stack}) AS (kpi, before)")
    j = long_cur.join(long_prev, "kpi", "full_outer")
    change = (F.col("now") - F.col("before")) / F.col("before")
    valid = F.col("now").isNotNull() & F.col("before").isNotNull() & (F.col("before") != 0)
    return j.select(
        "kpi",
        "now",
        "before",
        F.when(valid, change).alias("change"),
        F.when(~valid, F.lit(None))
        .when(F.abs(change) < 0.005, "flat")
        .when(change > 0, "up")
        .otherwise("down")
        .alias("direction"),
        F.when(valid & (F.abs(change) >= 0.005), F.abs(F.floor(change * 100 + 0.5)).cast("long")).alias("percent"),
    )


def api_daily(dim_date: DataFrame, f_session: DataFrame, f_puzzle: DataFrame, p: Periods, traffic: str) -> DataFrame:
    """J11 + A19 + T1: one row per day of the current period, zero filled, oldest first."""
    s = f_session.filter(F.col("traffic_type").isin(*C.session_types(traffic))).groupBy("date_key").agg(
        F.countDistinct("client_id").alias("players"), F.count(F.lit(1)).alias("sessions"), F.sum("moves").alias("moves")
    )
    pz = f_puzzle.filter(F.col("traffic_type").isin(*C.puzzle_types(traffic))).groupBy("date_key").agg(
        F.count_if(F.col("is_completed")).alias("completed")
    )
    spine = dim_date.filter(F.col("date").between(F.lit(p.frm), F.lit(p.to))).select("date", "date_key")
    return (
        spine.join(s, "date_key", "left")
        .join(pz, "date_key", "left")
        .select(
            "date",
            F.coalesce("players", F.lit(0).cast("long")).alias("players"),
            F.coalesce("sessions", F.lit(0).cast("long")).alias("sessions"),
            F.coalesce("moves", F.lit(0).cast("long")).alias("moves"),
            F.coalesce("completed", F.lit(0).cast("long")).alias("completed"),
        )
        .orderBy("date")
    )


def api_heatmap(f_session: DataFrame, p: Periods, traffic: str) -> DataFrame:
    """Sessions by weekday and local hour in the current period."""
    return (
        f_session.filter(
            F.col("date_key").between(p.key(p.frm), p.key(p.to)) & F.col("traffic_type").isin(*C.session_types(traffic))
        )
        .groupBy("weekday", F.col("hour_local").alias("hour"))
        .agg(F.count(F.lit(1)).alias("sessions"))
    )


def api_difficulty(f_puzzle: DataFrame, p: Periods, traffic: str) -> DataFrame:
    """A21 + P16 + T2: funnel by size bucket with the exact median of completed durations."""
    done = F.col("is_completed")
    rows = f_puzzle.filter(
        F.col("date_key").between(p.key(p.frm), p.key(p.to))
        & F.col("traffic_type").isin(*C.puzzle_types(traffic))
        & F.col("pieces").isNotNull()
    ).select("*", size_bucket().alias("size"), size_sort_key().alias("sort_key"))
    agg = rows.groupBy("size").agg(
        F.count(F.lit(1)).alias("started"),
        F.count_if(F.col("moves") > 0).alias("played"),
        F.count_if(done).alias("completed"),
        F.min("sort_key").alias("sort_key"),
    )
    median = exact_percentile(rows.filter(done), ["size"], "duration_ms", 0.5, "_median_ms")
    return (
        agg.join(median, "size", "left")
        .select("size", "started", "played", "completed", (F.col("_median_ms") / 60000.0).alias("median_min"), "sort_key")
        .orderBy("sort_key")
    )


# --- fixed values: the tables that the public datasets read ---
PUBLIC_TABLES = ("agg_daily_activity", "agg_daily_puzzles", "agg_hourly_heatmap", "agg_difficulty", "dim_date")
DASHBOARD_TABLES = ("dim_date", "fact_session", "fact_puzzle")


def missing_tables(tables, needed=DASHBOARD_TABLES) -> list[str]:
    """The needed tables that are not there; ``tables`` holds names, or is a lake's gold layer."""
    there = tables.names("gold") if hasattr(tables, "names") else tables
    return [n for n in needed if n not in there]


def public_ready(tables) -> bool:
    """Whether all five public tables are published."""
    return not missing_tables(tables, PUBLIC_TABLES)


def dashboard(spark: SparkSession, tables: dict[str, DataFrame], days=C.DEFAULT_DAYS, traffic="all", as_of=None,
              runs: DataFrame | None = None) -> dict:
    """Everything the admin dashboard shows. Returns {"available": False, "reason": ...} when the
    warehouse is missing or has no complete day."""
    days, traffic = C.validate_dashboard_params(days, traffic)
    if missing := missing_tables(tables):
        return {"available": False, "reason": "no_warehouse", "missing": missing}
    as_of = as_of or dt.date.today()
    p = periods(tables["dim_date"], as_of, days)
    if p is None:
        return {"available": False, "reason": "no_data"}
    k = kpis(spark, tables["fact_session"], tables["fact_puzzle"], p, traffic)
    out = {
        "available": True,
        "range": {"from": p.frm.isoformat(), "to": p.to.isoformat(), "days": days},
        "dataThrough": p.to.isoformat(),
        "kpis": k,
        "delta": kpi_delta(k),
        "daily": api_daily(tables["dim_date"], tables["fact_session"], tables["fact_puzzle"], p, traffic),
        "heatmap": api_heatmap(tables["fact_session"], p, traffic),
        "difficulty": api_difficulty(tables["fact_puzzle"], p, traffic),
    }
    if runs is not None:
        from tessera.plans.runs import last_run

        out["lastRun"] = last_run(runs)
    return out


# ---- public virtual datasets (aggregates only: no names or ids) -------------------------------

def v_daily_activity(agg: DataFrame, dim_date: DataFrame) -> DataFrame:
    """V1."""
    return agg.join(dim_date.select("date_key", "date"), "date_key").select(
        "date", "room_type", traffic_label().alias("traffic"), "sessions", "active_players", "moves", "snaps",
        "median_session_min",
    )


def v_daily_puzzles(agg: DataFrame, dim_date: DataFrame) -> DataFrame:
    """V2."""
    return agg.join(dim_date.select("date_key", "date"), "date_key").select(
        "date", room_label().alias("room"), traffic_label().alias("traffic"), "puzzles_started", "puzzles_played",
        "puzzles_completed", "median_duration_min",
    )


def v_heatmap(agg: DataFrame) -> DataFrame:
    """V3."""
    return agg.select(weekday_label().alias("day"), padded_hour().alias("hour"), traffic_label().alias("traffic"),
                      "sessions", "moves")


def v_difficulty(agg: DataFrame) -> DataFrame:
    """V4."""
    return agg.select(size_label().alias("size"), traffic_label().alias("traffic"), "started", "played", "completed",
                      "median_duration_min")


PUBLIC_COLUMNS_FORBIDDEN = ("client_id", "session_id", "player_name", "latest_name", "session_key", "move_id")


# ---- charts ------------------------------------------------------------------------------------

def _last(df: DataFrame, as_of, months: int) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return df.filter((F.col("date") >= F.add_months(day, -months)) & (F.col("date") < day))


def _rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The caller's row limit; none by default."""
    return df if limit is None else df.limit(limit)


def _traffic(df: DataFrame, traffic: list[str] | None) -> DataFrame:
    """The dashboard's traffic filter, on the label column every public dataset has."""
    return df if not traffic else df.filter(F.col("traffic").isin(*traffic))


def chart_kpi_sessions(v_activity: DataFrame, as_of, traffic=None) -> DataFrame:
    """Sessions in the last month."""
    return _traffic(_last(v_activity, as_of, 1), traffic).agg(F.sum("sessions").alias("sessions"))


def chart_kpi_completed(v_puzzles: DataFrame, as_of, traffic=None) -> DataFrame:
    """C2."""
    return _traffic(_last(v_puzzles, as_of, 1), traffic).agg(F.sum("puzzles_completed").alias("completed"))


def chart_kpi_completion(v_puzzles: DataFrame, as_of, traffic=None) -> DataFrame:
    """sum(completed) / sum(played) in the last month."""
    d = _traffic(_last(v_puzzles, as_of, 1), traffic)
    return d.agg(
        (F.sum("puzzles_completed") * 1.0 / F.nullif(F.sum("puzzles_played"), F.lit(0))).alias("completion")
    )


def chart_sessions_by_day(v_activity: DataFrame, as_of, traffic=None, limit: int | None = None) -> DataFrame:
    """C4: sessions by day and traffic over the last quarter."""
    d = _traffic(_last(v_activity, as_of, 3), traffic)
    return _rows(d.groupBy("date", "traffic").agg(F.sum("sessions").alias("sessions")).orderBy("date", "traffic"), limit)


def chart_puzzles_by_day(v_puzzles: DataFrame, as_of, traffic=None, limit: int | None = None) -> DataFrame:
    """Completed puzzles by day and room over the last quarter."""
    d = _traffic(_last(v_puzzles, as_of, 3), traffic)
    return _rows(d.groupBy("date", "room").agg(F.sum("puzzles_completed").alias("completed")).orderBy("date", "room"), limit)


def chart_heatmap(v_heat: DataFrame, traffic=None, limit: int | None = None) -> DataFrame:
    """Sessions by day label and padded hour, normalized across the whole heatmap (value / max)."""
    d = _traffic(v_heat, traffic).groupBy("day", "hour").agg(F.sum("sessions").alias("sessions"))
    top = d.agg(F.max("sessions").alias("top")).scalar()
    cells = d.select("day", "hour", "sessions", F.when(top > 0, F.col("sessions") / top).alias("intensity"))
    return _rows(cells.orderBy(F.col("hour").asc(), F.col("day").desc()), limit)


def chart_difficulty(v_diff: DataFrame, traffic=None, limit: int | None = None) -> DataFrame:
    """Completion by size, sizes descending."""
    done = (F.sum("completed") * 1.0 / F.nullif(F.sum("played"), F.lit(0))).alias("completion")
    return _rows(_traffic(v_diff, traffic).groupBy("size").agg(done).orderBy(F.col("size").desc()), limit)


def heatmap_dense(heat: DataFrame, steps: int = C.HEATMAP_STEPS) -> DataFrame:
    """All 7 x 24 cells (missing = 0) with an intensity step floor(v / max * steps) capped at
    steps - 1; empty cells get no step."""
    spine = heat.sparkSession.range(0, 7 * 24).select(
        (F.col("id") / 24 + 1).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour")
    )
    cells = spine.join(heat.select("weekday", "hour", "sessions"), ["weekday", "hour"], "left").select(
        "weekday", "hour", F.coalesce("sessions", F.lit(0).cast("long")).alias("sessions")
    )
    top = cells.agg(F.max("sessions").alias("top")).scalar()
    v = F.col("sessions")
    step = F.least(F.call_function("div", v * steps, F.nullif(top, F.lit(0))), F.lit(steps - 1))
    return cells.select("weekday", "hour", "sessions", F.when((v > 0) & (top > 0), step).alias("step"))


def daily_table(daily: DataFrame) -> DataFrame:
    """The daily series as the dashboard's table shows it, newest day first, with the day's share of all sessions."""
    total = daily.agg(F.sum("sessions").alias("all")).scalar()
    return daily.select("date", "players", "sessions", "moves", "completed", F.call_function("div", F.col("sessions") * 10000, F.nullif(total, F.lit(0))).alias("share_bp")).orderBy(F.col("date").desc())
