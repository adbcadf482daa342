"""Run log (R1-R3, T3, P19, P20): append-only status rows under ``{lake}/_runs``; the latest row of a run
wins. Each status change is one small Parquet file."""

from __future__ import annotations

import datetime as dt
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.lake import Lake

RUN_SCHEMA = (
    "run_id long, seq long, started_at timestamp, finished_at timestamp, status string, full_refresh boolean, "
    "watermark_from long, watermark_to long, row_counts string, checks string, error string"
)
SHOWN_ERROR = 300


def latest_rows(log: DataFrame) -> DataFrame:
    """Current state of every run: its row with the highest ``seq``."""
    w = Window.partitionBy("run_id").orderBy(F.col("seq").desc())
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "seq")


def shown_error(col: str = "error", chars: int = SHOWN_ERROR):
    """P19 for display only: the beginning of an error; the log keeps the whole text."""
    return F.substring(col, 1, chars)


def last_run(log: DataFrame) -> DataFrame:
    """T3 + P20: the newest run with its whole error and the passed/total check counts read from the JSON check
    list. A display cuts the error with ``shown_error``."""
    checks = F.from_json(F.coalesce(F.col("checks"), F.lit("[]")), "array<struct<passed:boolean>>")
    return (
        latest_rows(log)
        .orderBy(F.col("run_id").desc())
        .limit(1)
        .select(
            "run_id", "status", "started_at", "finished_at", "error",
            F.size(F.filter(checks, lambda c: c["passed"])).cast("long").alias("passed"),
            F.size(checks).cast("long").alias("total"),
        )
    )


def watermark(log: DataFrame) -> DataFrame:
    """The largest watermark that a run has ended with in success, 0 if none has."""
    return latest_rows(log).filter(F.col("status") == "success").agg(F.coalesce(F.max("watermark_to"), F.lit(0)).alias("watermark"))


def error_summary(err: BaseException) -> str:
    """The first non-empty line of the error, else its type."""
    return next((line for line in str(err).splitlines() if line.strip()), type(err).__name__)


@dataclass
class RunLog:
    spark: SparkSession
    root: str

    @property
    def path(self) -> str:
        return f"{self.root}/_runs"

    def table(self) -> DataFrame:
        if not Lake(self.spark, self.root).glob("_runs"):  # no run yet
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.path)

    def _append(self, **row) -> None:
        full = {c.split()[0]: None for c in RUN_SCHEMA.split(", ")}
        full.update(row, seq=time.time_ns())
        self.spark.createDataFrame([full], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def last_watermark(self) -> int:
        """Largest watermark of a successful run (0 if none). A report: a job's own watermark is the one committed with
        the tables, since a run may end between its commit and its last log row."""
        return int(watermark(self.table()).first()[0])

    def start(self, watermark_from: int, full_refresh: bool) -> int:
        """R2: runs still marked running are abandoned; a new run row is inserted."""
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        cur = latest_rows(self.table())
        for r in cur.filter(F.col("status") == "running").collect():  # a handful at most
            self._append(**{**r.asDict(), "status": "failed", "finished_at": now, "error": "abandoned"})
        run_id = int(cur.agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0]) + 1
        self._append(run_id=run_id, started_at=now, status="running", full_refresh=full_refresh,
                     watermark_from=watermark_from)
        return run_id

    def finish(self, run_id: int, status: str, watermark_to: int | None, row_counts: dict, checks: list[dict],
               error: str | None = None) -> None:
        """Final status; a failed run records no watermark."""
        started = latest_rows(self.table()).filter(F.col("run_id") == run_id).first()
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self._append(
            run_id=run_id, started_at=started["started_at"] if started else now, finished_at=now, status=status,
            full_refresh=bool(started["full_refresh"]) if started else False,
            watermark_from=started["watermark_from"] if started else None,
            watermark_to=watermark_to if status == "success" else None,
            row_counts=json.dumps(row_counts), checks=json.dumps(checks, default=str),
            error=error,
        )
