"""Tables as plain Parquet run folders ``{root}/{layer}/{name}/run=<n>/`` and one pointer file that names the current run.

A run writes its own folders; a retry after a failure has the same n and overwrites them. Replacing the pointer publishes all
its tables and the watermark together (S4, S6, S8). A table of ``DAY`` has the newest folder of each day, one of ``LOGS`` all
folders since the last full refresh, any other its newest folder. One job writes at a time; retention is the storage's.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOGS = ("events",)
DAY = {"moves": "event_date", "sessions": "event_date", "fact_move": "date_key", "fact_session": "date_key", "hours": "date_key", "agg_daily_activity": "date_key"}
EMPTY = "__HIVE_DEFAULT_PARTITION__"


class Lake:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.writing, self.first = spark, root, 0, 1
        self.written: set[str] = set()  # tables of this run; a failed run's folders of the same number are none
        self.hadoop, self.conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def glob(self, pattern: str) -> list[str]:
        path = self.hadoop.Path(f"{self.root}/{pattern}")
        return [s.getPath().toString() for s in path.getFileSystem(self.conf).globStatus(path) or []]

    def current(self) -> dict:
        """The published pointer."""
        path = self.hadoop.Path(f"{self.root}/_current")
        return json.loads(path.getFileSystem(self.conf).open(path).readUTF()) if self.glob("_current") else {"run": 0, "first": 1, "watermark": 0}

    def begin(self, full: bool = False) -> dict:
        """Starts the run after the published one; from now on reads see what it has written."""
        now = self.current()
        self.writing, self.first = now["run"] + 1, now["run"] + 1 if full else now["first"]
        return now

    def publish(self, **values) -> None:
        """Replaces the pointer by one rename."""
        new, pointer, rename = self.hadoop.Path(f"{self.root}/_next"), self.hadoop.Path(f"{self.root}/_current"), getattr(self.hadoop, "Options$Rename")
        out = new.getFileSystem(self.conf).create(new, True)
        out.writeUTF(json.dumps({**values, "run": self.writing, "first": self.first}))
        out.close()
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.hadoop.FileContext.getFileContext(new.toUri(), self.conf).rename(new, pointer, how)

    def write(self, df: DataFrame, layer: str, name: str, by: str | None = None) -> DataFrame:
        """This run's rows of a table, read back; ``by`` names the folders inside the run's (a day's, in tables of ``DAY``)."""
        path, by = f"{self.root}/{layer}/{name}/run={self.writing}", DAY.get(name, by)
        dealt = df.hint("rebalance", by) if by else df  # by folder, so that a task does not open a file in each
        dealt.write.mode("overwrite").partitionBy(*[by] if by else []).parquet(path)
        if by and not self.glob(f"{layer}/{name}/run={self.writing}/*=*"):  # a table without rows still has its columns
            df.limit(0).drop(by).write.parquet(f"{path}/{by}={EMPTY}")
        self.written.add(f"{layer}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def folders(self, layer: str, name: str) -> list[str]:
        """The folders that make up a table as of this run, or as of the published one."""
        now, newest = self.current(), {}
        first, last = (self.first, self.writing - (f"{layer}/{name}" not in self.written)) if self.writing else (now["first"], now["run"])
        for path in self.glob(f"{layer}/{name}/run=*" + "/*=*" * (name in DAY)):
            run, folder = int(re.search(r"/run=(\d+)", path)[1]), path.rsplit("/", 1)[1]
            part = folder if name in DAY or name in LOGS else ""
            if first <= run <= last and run >= newest.get(part, (0, ""))[0]:
                newest[part] = (run, path)
        return [path for _, path in newest.values()]

    def read(self, layer: str, name: str) -> DataFrame | None:
        """The table, or None if no run has written it."""
        if not (paths := self.folders(layer, name)):
            return None
        df = self.spark.read.option("basePath", f"{self.root}/{layer}/{name}").parquet(*paths).drop("run")
        return df.select(*[F.col(c).cast({"event_date": "date", "date_key": "int"}[c]) if c in ("event_date", "date_key") else c for c in df.columns])

    def names(self, layer: str) -> list[str]:
        """The tables of a layer that are there."""
        return [n for n in (p.rsplit("/", 1)[1] for p in self.glob(f"{layer}/*")) if self.folders(layer, n)]
