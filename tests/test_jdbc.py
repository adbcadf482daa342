"""JDBC source (S1, S2) on embedded in-memory Derby: in-process, no server and no port."""

import uuid

from tessera.plans import refresh
from tessera.sources.adapter import BRONZE_COLUMNS
from tessera.sources.events_source import JdbcEventSource, ParquetEventSource
from tessera.sources.lake import Lake
from tests.conftest import SF_SMALL

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _derby_with_events(spark):
    url = f"jdbc:derby:memory:tessera_{uuid.uuid4().hex[:8]};create=true"
    rows = ParquetEventSource(spark, SF_SMALL).frame().select(*BRONZE_COLUMNS)
    rows = rows.toDF(*[c.upper() for c in BRONZE_COLUMNS])  # as an unquoted CREATE TABLE stores them
    rows.write.jdbc(url, "analytics_events", mode="overwrite", properties=DRIVER)
    return url


def test_partitioned_bounded_jdbc_read(spark):
    url = _derby_with_events(spark)
    src = JdbcEventSource(spark, url, properties=DRIVER, num_partitions=4)
    assert src.max_id() == 1000
    part = src.read(200, 700)
    assert part.rdd.getNumPartitions() == 4
    got = sorted(r["id"] for r in part.select("id").collect())
    assert got == list(range(201, 701))
    want = ParquetEventSource(spark, SF_SMALL).read(200, 700).select("id", "event_type", "payload")
    assert part.select("id", "event_type", "payload").exceptAll(want).count() == 0


def test_job_from_jdbc_equals_job_from_parquet(spark, tmp_path):
    url = _derby_with_events(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    ra = refresh.run(spark, JdbcEventSource(spark, url, properties=DRIVER), a, full_refresh=True)
    rb = refresh.run(spark, ParquetEventSource(spark, SF_SMALL), b, full_refresh=True)
    assert ra["status"] == rb["status"] == "success"
    for n in ["fact_session", "fact_move", "agg_daily_activity"]:
        x, y = Lake(spark, a).read("gold", n), Lake(spark, b).read("gold", n)
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_job_from_arguments_reads_a_database(spark, tmp_path):
    url = _derby_with_events(spark)
    argv = ["--jdbc-url", url, "--jdbc-property", f"driver={DRIVER['driver']}", "--partitions", "3", "--lake", str(tmp_path / "lake"), "--full-refresh"]
    assert refresh.main(argv) == 0
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.current()["watermark"] == 1000 and lake.read("gold", "fact_move").count() > 0


def test_id_ranges():
    src = JdbcEventSource(None, "jdbc:x", num_partitions=4)
    assert src.ranges(0, 8) == ["id > 0 AND id <= 2", "id > 2 AND id <= 4", "id > 4 AND id <= 6", "id > 6 AND id <= 8"]
    assert src.ranges(5, 7) == ["id > 5 AND id <= 6", "id > 6 AND id <= 7"] and src.ranges(5, 5) == ["id > 5 AND id <= 5"]
