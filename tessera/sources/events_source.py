"""The append-only event log as a source with an arrival id: Parquet (the driver tables through the
adapter) or JDBC (partitioned by id ranges). S1, S2, S3, S14, S15."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.sources.adapter import BRONZE_COLUMNS, bronze_from_events, read_table


@dataclass
class ParquetEventSource:
    """Driver ``events`` seen as the game's log. ``visible_up_to`` caps the ids that have "arrived", which
    lets tests and the benchmark grow the log between runs."""

    spark: SparkSession
    sf_dir: str
    visible_up_to: int | None = None
    num_partitions: int | None = None

    # The adapter's arrival id is ``event_id + 1``; id bounds are turned into raw-column bounds so the
    # predicates still reach the Parquet reader.
    def raw(self) -> DataFrame:
        df = read_table(self.spark, self.sf_dir, "events")
        if self.visible_up_to is not None:
            df = df.filter(F.col("event_id") <= self.visible_up_to - 1)
        return df

    def frame(self) -> DataFrame:
        return bronze_from_events(self.raw())

    def max_id(self) -> int:
        """coalesce(max(id), 0) over the raw id column (a scan of that column)."""
        return int(self.raw().agg(F.coalesce(F.max("event_id") + 1, F.lit(0)).cast("long")).first()[0])

    def read(self, after: int, up_to: int) -> DataFrame:
        """The bounded scan ``after < id <= up_to``; the predicate reaches the Parquet reader. With
        ``num_partitions`` the raw rows are spread over that many tasks before the projection, like the
        JDBC read's id ranges (useful when the input is a single file; a large log is already split by
        its files)."""
        raw = self.raw().filter((F.col("event_id") >= after) & (F.col("event_id") <= up_to - 1))
        if self.num_partitions:
            raw = raw.repartition(self.num_partitions)
        return bronze_from_events(raw).select(*BRONZE_COLUMNS)


@dataclass
class JdbcEventSource:
    """A relational event table. Each of ``num_partitions`` tasks asks the database for its own id range, which the
    database answers from the key's index."""

    spark: SparkSession
    url: str
    table: str = "analytics_events"
    properties: dict = field(default_factory=dict)
    num_partitions: int = 4
    fetch_size: int = 10_000

    def max_id(self) -> int:
        """The database computes the maximum; an empty table has none."""
        top = self.spark.read.format("jdbc").options(url=self.url, query=f"SELECT max(id) AS top FROM {self.table}", **self.properties).load()
        return int(top.first()[0] or 0)

    def ranges(self, after: int, up_to: int) -> list[str]:
        """Conditions that cut (after, up_to] into even id ranges, none of them empty unless the whole is."""
        n = max(1, min(self.num_partitions, up_to - after))
        edges = [after + (up_to - after) * k // n for k in range(n + 1)]
        return [f"id > {lo} AND id <= {hi}" for lo, hi in zip(edges, edges[1:])]

    def read(self, after: int, up_to: int) -> DataFrame:
        """S2, in the bronze columns; databases fold unquoted names to their own case, so columns are found without it."""
        rows = self.spark.read.jdbc(self.url, self.table, predicates=self.ranges(int(after), int(up_to)), properties={**self.properties, "fetchsize": str(self.fetch_size)})
        return rows.select(*[F.col(c).alias(c) for c in BRONZE_COLUMNS])


def with_bronze_metadata(df: DataFrame, run_id: int, extracted_at: Column | None = None) -> DataFrame:
    """S3: run id, extraction time and the local ingest date."""
    return df.select(
        *df.columns,
        F.lit(run_id).cast("long").alias("_run_id"),
        (extracted_at if extracted_at is not None else F.current_timestamp()).alias("_extracted_at"),
        F.to_date(F.from_utc_timestamp("ingested_at", C.TIME_ZONE)).alias("ingest_date"),
    )


def insert_only_merge(existing: DataFrame | None, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing`` (first write wins across batches; callers
    dedup within the batch first).

    The stored keys meet the new ones in a semi-join whose small side is the batch, so an append that Spark can broadcast
    only scans one column of the history; what comes back is at most the batch's keys."""
    if existing is None:
        return incoming
    stored = existing.select(key).join(incoming.select(key), key, "left_semi").distinct()
    return incoming.join(stored, key, "left_anti")


def skip_duplicates(existing: DataFrame | None, offered: DataFrame, key: str, order: str) -> DataFrame:
    """An insert of ``offered`` that skips keys already stored and repeated keys within the batch
    (the first by ``order`` is kept)."""
    from tessera.operators.dedup import dedup_first

    return insert_only_merge(existing, dedup_first(offered, key, order), key)


def skipped_warning(offered: int, inserted: int, first_load: bool) -> str | None:
    """X11: a first load that skips rows has met ids that repeat within the source itself."""
    skipped = offered - inserted
    return f"first load skipped {skipped} of {offered} rows: their ids repeat in the source" if first_load and skipped else None


def purge(df: DataFrame, predicate: Column) -> DataFrame:
    """The table without the rows matching ``predicate`` (nulls are kept)."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))
