"""Spark session: settings of spark-submit and the cluster stand; only what the results need is fixed here."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: What every result relies on, whatever the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",  # a busy key's events meet before the shuffle
}
_JVM = "-Duser.timezone=UTC -Duser.language=en -Duser.country=US"


def settings(master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None,
             extra: dict[str, str] | None = None) -> dict[str, str]:
    """The settings a session is built with. Master, memory and partition count are the submitter's: they are set
    only when given (local runs, tests)."""
    conf = dict(REQUIRED)
    if master is not None:
        conf |= {"spark.master": master, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                 "spark.driver.extraJavaOptions": _JVM, "spark.executor.extraJavaOptions": _JVM}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory is not None:
        conf["spark.driver.memory"] = driver_memory
    return conf | (extra or {})


def build_session(master: str | None = None, app_name: str = "tessera", shuffle_partitions: int | None = None,
                  driver_memory: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings(master, shuffle_partitions, driver_memory, extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_utc(spark)


def ensure_utc(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC instants; local calendars are derived explicitly with a named zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``. Only a local session without the setting (one
    machine, as in tests) gets a folder of its own; on a cluster that would be each executor's own disk, so a missing
    setting is an error there."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()
