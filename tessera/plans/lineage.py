"""Lazy lineage from the driver tables to every table of the model, for registered queries and tests."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tessera.plans import gold, silver
from tessera.session import checkpoint_dir
from tessera.sources.adapter import bronze_events


@dataclass
class Model:
    """Tables of one build, created on first access (DataFrames are lazy; nothing runs here)."""

    spark: SparkSession
    sf_dir: str
    dup_key: bool = False
    bucket_seconds: int | None = silver.DEFAULT_BUCKET_SECONDS
    # Silver stages read by many later plans are materialized:
    #   "checkpoint" - Parquet in the session's checkpoint dir (the shared folder on a cluster), read back: cuts the
    #                  lineage, so that a lost executor does not send Spark back to the raw log, and later plans
    #                  read only the columns and row groups they need;
    #   "persist"    - memory/disk cache (lineage kept);
    #   "none"       - fully lazy (one plan per query).
    materialize: str = "checkpoint"
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    MATERIALIZED = ("events", "moves", "session_pairs", "sessions")

    def _get(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            df = build()
            if name in self.MATERIALIZED:
                if self.materialize == "checkpoint":
                    path = f"{checkpoint_dir(self.spark)}/stage-{uuid.uuid4().hex}/{name}"
                    df.write.parquet(path)
                    df = self.spark.read.parquet(path)
                elif self.materialize == "persist":
                    df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._cache[name] = df
        return self._cache[name]

    def release(self) -> None:
        for name in self.MATERIALIZED:
            if name in self._cache and self.materialize == "persist":
                self._cache[name].unpersist()
        self._cache.clear()

    @property
    def bronze(self) -> DataFrame:
        return self._get("bronze", lambda: bronze_events(self.spark, self.sf_dir, dup_key=self.dup_key))

    @property
    def events(self) -> DataFrame:
        return self._get("events", lambda: silver.to_silver_events(self.bronze))

    @property
    def moves(self) -> DataFrame:
        return self._get("moves", lambda: silver.build_moves(self.events, self.bucket_seconds))

    @property
    def session_pairs(self) -> DataFrame:
        return self._get("session_pairs", lambda: silver.pair_sessions(self.events, self.bucket_seconds))

    @property
    def sessions(self) -> DataFrame:
        return self._get(
            "sessions", lambda: silver.attach_move_stats(self.session_pairs, self.moves, self.bucket_seconds)
        )

    @property
    def dim_date(self) -> DataFrame:
        return self._get("dim_date", lambda: gold.dim_date(self.events))

    @property
    def dim_player(self) -> DataFrame:
        return self._get("dim_player", lambda: gold.dim_player(self.events, self.sessions))

    @property
    def dim_room(self) -> DataFrame:
        return self._get("dim_room", lambda: gold.dim_room(self.events))

    @property
    def fact_puzzle(self) -> DataFrame:
        return self._get("fact_puzzle", lambda: gold.fact_puzzle(self.events, self.moves))

    @property
    def fact_session(self) -> DataFrame:
        return self._get("fact_session", lambda: gold.fact_session(self.sessions))

    @property
    def fact_move(self) -> DataFrame:
        return self._get("fact_move", lambda: gold.fact_move(self.moves))

    @property
    def agg_daily_activity(self) -> DataFrame:
        return self._get("agg_daily_activity", lambda: gold.agg_daily_activity(self.fact_session, self.fact_move))

    @property
    def agg_daily_puzzles(self) -> DataFrame:
        return self._get("agg_daily_puzzles", lambda: gold.agg_daily_puzzles(self.fact_puzzle))

    @property
    def agg_hourly_heatmap(self) -> DataFrame:
        return self._get("agg_hourly_heatmap", lambda: gold.agg_hourly_heatmap(self.fact_session, self.fact_move))

    @property
    def agg_difficulty(self) -> DataFrame:
        return self._get("agg_difficulty", lambda: gold.agg_difficulty(self.fact_puzzle))

    def gold_tables(self) -> dict[str, DataFrame]:
        names = [
            "dim_date", "dim_player", "dim_room", "fact_puzzle", "fact_session", "fact_move",
            "agg_daily_activity", "agg_daily_puzzles", "agg_hourly_heatmap", "agg_difficulty",
        ]
        return {n: getattr(self, n) for n in names}


_SHARED: dict[tuple, Model] = {}


def _version(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a file or folder from another: bytes, files and time of change."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(p)
    return size.getLength(), size.getFileCount(), fs.getFileStatus(p).getModificationTime()


def shared_model(spark: SparkSession, sf_dir: str, dup_key: bool = False) -> Model:
    """One build per (application, input folder and its state), shared by the registered queries."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _version(spark, f"{sf_dir.rstrip('/')}/events.parquet"), dup_key)
    model = _SHARED.get(key)
    if model is None:
        model = _SHARED[key] = Model(spark, sf_dir, dup_key=dup_key)
    return model
