"""The batch job over the smallest driver table: full refresh, incremental = full, empty source, failed run
then retry, visibility by the pointer, run log."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.plans import quality, refresh
from tessera.plans.runs import RunLog, last_run
from tessera.sources.events_source import ParquetEventSource, insert_only_merge, purge, skip_duplicates
from tessera.sources.lake import Lake
from tests.conftest import SF_SMALL

GOLD = ["fact_session", "fact_move", "fact_puzzle", "agg_daily_activity", "dim_player"]


SILVER = ["moves", "sessions"]


def _snapshot(lake, names=GOLD, silver=()):
    tables = {("gold", n): lake.read("gold", n) for n in names} | {("silver", n): lake.read("silver", n) for n in silver}
    return {k: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) for k, df in tables.items()}


@pytest.fixture(scope="module")
def full_lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake_full"))
    out = refresh.run(spark, ParquetEventSource(spark, SF_SMALL), root, full_refresh=True)
    assert out["status"] == "success", out["error"]
    return root, out


def test_full_refresh_publishes_every_table(spark, full_lake):
    root, out = full_lake
    lake = Lake(spark, root)
    for n in refresh.GOLD_TABLES + refresh.AGGREGATES:
        assert n in lake.names("gold")
        assert lake.read("gold", n).count() == out["counts"][f"gold_{n}"]
    assert out["watermark"] == 1000
    assert {c["name"] for c in out["checks"] if c["severity"] == "error" and not c["passed"]} == set()


def test_incremental_runs_equal_full_refresh(spark, full_lake, tmp_path):
    root_full, _ = full_lake
    root = str(tmp_path / "lake")
    src = ParquetEventSource(spark, SF_SMALL, visible_up_to=600)
    assert refresh.run(spark, src, root)["status"] == "success"
    src.visible_up_to = 950
    assert refresh.run(spark, src, root)["status"] == "success"
    src.visible_up_to = None
    out = refresh.run(spark, src, root)
    assert out["status"] == "success" and out["counts"]["bronze_new_rows"] == 50
    # Only what the new events reach is built anew; the result equals a full rebuild.
    full_counts = full_lake[1]["counts"]
    assert 0 < out["counts"]["silver_changed_moves"] < full_counts["silver_moves"] / 2
    assert out["counts"]["silver_moves"] < full_counts["silver_moves"] and out["counts"]["gold_fact_move"] == out["counts"]["silver_moves"]
    names = refresh.GOLD_TABLES + refresh.AGGREGATES + ["hours"]
    assert _snapshot(Lake(spark, root), names, SILVER) == _snapshot(Lake(spark, root_full), names, SILVER)
    # Q1-Q4 from the new rows alone give the whole-table values of the full refresh.
    # So do the primary-key checks of the socket-keyed facts from the touched sockets' rows.
    event_checks = {quality.UNIQUE_EVENT_ID, quality.REQUIRED_FIELDS, quality.NOT_IN_FUTURE, quality.RECONCILE}
    event_checks |= {f"pk_{n}" for n in refresh.PRIMARY_KEYS}
    pick = lambda cs: sorted((c["name"], c["passed"], c["value"]) for c in cs if c["name"] in event_checks)
    assert len(pick(out["checks"])) == 10 and pick(out["checks"]) == pick(full_lake[1]["checks"])
    runs = RunLog(spark, root)
    assert runs.last_watermark() == 1000
    lr = last_run(runs.table()).first()
    assert lr["status"] == "success" and lr["passed"] >= 1 and lr["total"] >= lr["passed"]


def test_empty_source_keeps_watermark(spark, tmp_path):
    class Empty:
        def max_id(self):
            return 0

        def read(self, a, b):  # pragma: no cover - never called
            raise AssertionError

    root = str(tmp_path / "lake")
    out = refresh.run(spark, Empty(), root)
    assert out["status"] == "success" and out["watermark"] == 0
    assert Lake(spark, root).names("gold") == []


def test_failed_run_changes_nothing_and_retry_recovers(spark, tmp_path):
    root = str(tmp_path / "lake")
    src = ParquetEventSource(spark, SF_SMALL, visible_up_to=500)
    assert refresh.run(spark, src, root)["status"] == "success"
    before = _snapshot(Lake(spark, root))

    class Broken(ParquetEventSource):
        def read(self, after, up_to):
            return super().read(after, up_to).withColumn("occurred_at", F.lit(None).cast("timestamp"))

    bad = Broken(spark, SF_SMALL)
    out = refresh.run(spark, bad, root)
    assert out["status"] == "failed" and "quality checks failed" in out["error"]
    lake = Lake(spark, root)
    assert lake.current()["watermark"] == 500
    assert _snapshot(lake) == before  # readers never see the failed run's files
    retry = refresh.run(spark, ParquetEventSource(spark, SF_SMALL), root)
    assert retry["status"] == "success" and retry["counts"]["bronze_new_rows"] == 500
    statuses = [r["status"] for r in RunLog(spark, root).table().orderBy("seq").collect()]
    assert statuses.count("failed") == 1


def test_pointer_switches_all_tables_of_a_run(spark, scratch):
    def table(day, *ids):
        return spark.createDataFrame([(i, day) for i in ids], "move_id int, date_key int")

    def seen(lake, *names):
        return [sorted(r[0] for r in lake.read("gold", n).collect()) if lake.read("gold", n) else None for n in names]

    lake, reader = Lake(spark, scratch), Lake(spark, scratch)
    lake.begin()
    lake.write(table(20240101, 1, 2).union(table(20240102, 3)), "gold", "fact_move")
    lake.write(spark.range(1).select("id"), "gold", "t")
    lake.write(spark.range(2), "gold", "events")
    assert seen(reader, "fact_move", "t", "events") == [None] * 3 and seen(lake, "fact_move") == [[1, 2, 3]] and reader.names("gold") == []
    lake.publish(watermark=7)
    assert seen(reader, "fact_move", "t", "events") == [[1, 2, 3], [0], [0, 1]] and reader.current()["watermark"] == 7
    for rows in (table(20240101, 9, 10), table(20240102, 4, 5)):  # the first one fails before it is published
        again = Lake(spark, scratch)
        again.begin()
        again.write(rows, "gold", "fact_move")
        again.write(spark.range(5, 6), "gold", "events")
        assert seen(reader, "fact_move") == [[1, 2, 3]]
    again.publish(watermark=8)  # the second day's newest folder, the first day's old one; a log has both runs
    assert seen(reader, "fact_move", "t", "events") == [[1, 2, 4, 5], [0], [0, 1, 5]]
    full = Lake(spark, scratch)
    full.begin(full=True)
    full.write(table(20240103), "gold", "fact_move")
    full.publish(watermark=0)
    assert seen(reader, "fact_move", "t", "events") == [[], None, None] and dict(reader.read("gold", "fact_move").dtypes)["date_key"] == "int"


def test_merge_skip_duplicates_and_purge(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    offered = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "k string, v int")
    assert sorted(insert_only_merge(existing, offered, "k").collect()) == [("c", 3), ("c", 4)]
    assert sorted(skip_duplicates(existing, offered, "k", "v").collect()) == [("c", 3)]
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, s boolean")
    assert sorted(r["id"] for r in purge(df, F.col("s")).collect()) == [2, 3]


def test_run_log_marks_abandoned_runs(spark, tmp_path):
    runs = RunLog(spark, str(tmp_path / "lake"))
    r1 = runs.start(0, False)  # never finished (killed)
    r2 = runs.start(0, False)
    runs.finish(r2, "success", 10, {"x": 1}, [{"name": "a", "passed": True}])
    from tessera.plans.runs import latest_rows

    state = {r["run_id"]: r for r in latest_rows(runs.table()).collect()}
    assert state[r1]["status"] == "failed" and state[r1]["error"] == "abandoned"
    assert state[r2]["status"] == "success" and json.loads(state[r2]["row_counts"]) == {"x": 1}
    assert runs.last_watermark() == 10


def test_incremental_event_checks_equal_whole_table_checks(spark):
    """Collisions the merge would never produce (an inserted id already committed, a repeated new id, a
    new bronze id seen before) are counted as the whole-table checks count them."""
    schema = "event_id string, event_type string, occurred_at timestamp"
    ts = datetime(2026, 9, 10, 18, 0)
    old_bronze = spark.createDataFrame([("a", "x", ts), ("b", "x", ts), ("b", "x", ts)], schema)
    old_silver = spark.createDataFrame([("a", "x", ts), ("b", "x", ts)], schema)
    new_bronze = spark.createDataFrame([("b", "x", ts), ("c", "x", ts), ("c", "x", ts), ("d", None, ts)], schema)
    inserted = spark.createDataFrame([("b", "x", ts), ("c", "x", ts), ("c", "x", ts), ("d", None, ts)], schema)
    now = F.lit("2026-09-11 00:00:00").cast("timestamp")
    whole = quality.event_checks(old_bronze.unionByName(new_bronze), old_silver.unionByName(inserted), now)
    incr = quality.event_checks_incremental(old_bronze, new_bronze, old_silver, inserted, now=now)
    assert sorted(incr.collect()) == sorted(whole.collect())
    assert {r["name"]: r["value"] for r in whole.collect()}[quality.UNIQUE_EVENT_ID] == 2


def test_keys_of_changed_rows_are_checked_like_the_whole_table(spark):
    """Repeated, colliding and null keys among the changed rows count as the whole-table check counts them."""
    rows = [("s1", "a"), ("s2", "b"), ("s3", "b"), ("s3", "c"), ("s4", "c"), ("s4", None)]
    table = spark.createDataFrame(rows, "session_id string, move_id string")
    changed = table.where("session_id in ('s3', 's4')")
    whole = refresh.pk_violations({"fact_move": table}).collect()
    assert refresh.pk_violations({"fact_move": table}, {"fact_move": changed}).collect() == whole
    assert (whole[0]["duplicate_keys"], whole[0]["null_keys"]) == (2, 1)


def test_emptied_source_publishes_empty_tables(spark, tmp_path):
    root = str(tmp_path / "lake")
    src = ParquetEventSource(spark, SF_SMALL, visible_up_to=300)
    assert refresh.run(spark, src, root)["status"] == "success"
    src.visible_up_to = 0
    out = refresh.run(spark, src, root, full_refresh=True)
    assert (out["status"], out["watermark"], out["counts"]["silver_events"]) == ("success", 0, 0), out["error"]
    lake = Lake(spark, root)
    assert [lake.read("gold", n).count() for n in GOLD] == [0] * len(GOLD)
    src.visible_up_to = 200
    again = refresh.run(spark, src, root)
    assert (again["status"], again["watermark"], again["counts"]["silver_events"]) == ("success", 200, 200), again["error"]


def test_unequal_counts_stop_the_run_before_it_is_published(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    assert refresh.run(spark, ParquetEventSource(spark, SF_SMALL, visible_up_to=300), root)["status"] == "success"
    before = Lake(spark, root).current()
    write = Lake.write
    monkeypatch.setattr(Lake, "write", lambda self, df, layer, name, by=None: write(self, df, layer, name, by).limit(3 if name == "fact_move" else 1 << 30))
    out = refresh.run(spark, ParquetEventSource(spark, SF_SMALL), root)
    assert out["status"] == "failed" and "fact_move" in out["error"]
    assert Lake(spark, root).current() == before


def test_late_commits_below_the_watermark(spark, tmp_path):
    class Late(ParquetEventSource):
        hidden = True

        def read(self, after, up_to):
            df = super().read(after, up_to)
            return df.where("id not between 480 and 489") if self.hidden else df

    root, src = str(tmp_path / "lake"), Late(spark, SF_SMALL, visible_up_to=500)
    assert refresh.run(spark, src, root)["counts"]["silver_events"] == 490
    src.hidden, src.visible_up_to = False, 600
    out = refresh.run(spark, src, root, overlap=50)
    assert (out["status"], out["counts"]["bronze_new_rows"], out["counts"]["silver_events"]) == ("success", 110, 600), out["error"]


def test_merge_does_not_shuffle_the_stored_side(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(200_000).selectExpr("cast(id as string) as event_id", "repeat('x', 20) as payload").write.parquet(path)
    fresh = spark.range(199_990, 200_010).selectExpr("cast(id as string) as event_id", "'y' as payload")
    merged = insert_only_merge(spark.read.parquet(path), fresh, "event_id")
    assert sorted(int(r["event_id"]) for r in merged.collect()) == list(range(200_000, 200_010))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    above = plan[: plan.index("FileScan")].splitlines()[-4:]
    assert "payload" not in scan and not any("Exchange hashpartitioning" in line for line in above)


def test_a_first_load_that_skips_rows_is_warned_of():
    from tessera.sources.events_source import skipped_warning

    assert skipped_warning(10, 10, True) is None and skipped_warning(10, 8, False) is None
    assert "2 of 10" in skipped_warning(10, 8, True)


def test_settings_leave_the_cluster_to_the_submitter():
    from tessera.session import settings

    bare = settings()
    assert not {"spark.master", "spark.driver.memory", "spark.sql.shuffle.partitions", "spark.ui.enabled"} & set(bare)
    assert bare["spark.sql.session.timeZone"] == "UTC"
    local = settings("local[2]", 4, "1g", {"spark.x": "y"})
    assert (local["spark.master"], local["spark.sql.shuffle.partitions"], local["spark.driver.memory"], local["spark.x"]) == ("local[2]", "4", "1g", "y")


def test_arguments_choose_the_source(spark):
    from tessera.sources.events_source import JdbcEventSource

    args = refresh.parser().parse_args(["--jdbc-url", "jdbc:x", "--jdbc-property", "driver=a.B", "--jdbc-property", "user=u", "--partitions", "9", "--lake", "/l", "--overlap", "7"])
    src = refresh.source_of(spark, args)
    assert isinstance(src, JdbcEventSource) and (src.url, src.properties, src.num_partitions, args.overlap) == ("jdbc:x", {"driver": "a.B", "user": "u"}, 9, 7)
    assert refresh.source_of(spark, refresh.parser().parse_args(["--sf", SF_SMALL, "--lake", "/l"])).max_id() == 1000
    with pytest.raises(SystemExit):
        refresh.parser().parse_args(["--lake", "/l"])


def test_five_public_tables_make_the_public_datasets_ready(spark, scratch):
    from tessera.plans import serving

    lake = Lake(spark, scratch)
    for n in serving.PUBLIC_TABLES:
        assert not serving.public_ready(lake)
        lake.begin()
        lake.write(spark.range(1).selectExpr("id", "20240101 as date_key"), "gold", n)
        lake.publish()
    assert serving.public_ready(lake) and serving.missing_tables(lake) == ["fact_session", "fact_puzzle"]
    assert serving.missing_tables({"dim_date": 1, "fact_puzzle": 2}) == ["fact_session"]
