"""Benchmark: the whole batch job and the dashboard queries on the driver's event table.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Steps, each timed: a full refresh over 99 % of the log (the rest has "not arrived yet"), an incremental
run that picks up the last 1 %, then the dashboard queries over the published tables. Prints one JSON
line; the headline value is the full refresh in seconds.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))

    from tessera.plans import refresh, serving
    from tessera.session import build_session
    from tessera.sources.events_source import ParquetEventSource
    from tessera.sources.lake import Lake

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, driver_memory="8g")
    scratch = tempfile.mkdtemp(prefix="bench-", dir=os.environ.get("TESSERA_SCRATCH", "/tmp"))
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "checkpoints"))
    lake_root = os.path.join(scratch, "lake")

    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    source = ParquetEventSource(spark, sf_dir, visible_up_to=int(total * 0.99), num_partitions=cpus)
    q: dict[str, float] = {}

    t0 = time.time()
    full = refresh.run(spark, source, lake_root, full_refresh=True)
    q["full_refresh"] = round(time.time() - t0, 2)

    source.visible_up_to = None
    t0 = time.time()
    incr = refresh.run(spark, source, lake_root)
    q["incremental_1pct"] = round(time.time() - t0, 2)

    lake = Lake(spark, lake_root)
    tables = {n: lake.read("gold", n) for n in ["dim_date", "fact_session", "fact_puzzle"]}
    as_of = tables["dim_date"].agg({"date": "max"}).first()[0]
    t0 = time.time()
    p = serving.periods(tables["dim_date"], as_of, 30)
    k = serving.kpis(spark, tables["fact_session"], tables["fact_puzzle"], p, "all")
    k.collect()
    q["dashboard_kpis"] = round(time.time() - t0, 2)
    for name, df in [
        ("dashboard_daily", serving.api_daily(tables["dim_date"], tables["fact_session"], tables["fact_puzzle"], p, "all")),
        ("dashboard_heatmap", serving.api_heatmap(tables["fact_session"], p, "all")),
        ("dashboard_difficulty", serving.api_difficulty(tables["fact_puzzle"], p, "all")),
    ]:
        t0 = time.time()
        df.collect()
        q[name] = round(time.time() - t0, 2)

    ok = full["status"] == "success" and incr["status"] == "success"
    out = {
        "metric": "full_refresh_seconds",
        "value": q["full_refresh"],
        "unit": "sec",
        "queries": q,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "events": total,
        "events_per_sec_full": round(total * 0.99 / q["full_refresh"], 1),
        "status": "ok" if ok else f"failed: {full.get('error') or incr.get('error')}",
        "stage_seconds_full": full["counts"].get("stage_seconds"),
        "stage_seconds_incremental": incr["counts"].get("stage_seconds"),
        "phase_seconds_full": full["counts"].get("phase_seconds"),
        "phase_seconds_incremental": incr["counts"].get("phase_seconds"),
        "changed_moves_incremental": incr["counts"].get("silver_changed_moves"),
        "changed_sessions_incremental": incr["counts"].get("silver_changed_sessions"),
        "changed_days_incremental": incr["counts"].get("changed_days"),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
