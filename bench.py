"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder of Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names in place of the headline list, or "all"
BENCH_DUCKDB   set to 1 to add the seconds DuckDB needs for the same rows
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stopwise.plans.catalog import CATALOG  # noqa: E402
from stopwise.plans.columns import raw_change, raw_plan  # noqa: E402
from stopwise.plans.nested import raw_connections  # noqa: E402
from stopwise.session import build_session  # noqa: E402
from stopwise.sources.tables import Tables  # noqa: E402

HEADLINE = [
    "scan_date_range", "delays", "apply_change", "ml_time_features", "per_station", "per_train_number", "group_uncommon",
    "over_hour", "over_day", "over_week", "over_year", "stats_overview", "per_delay", "station_day", "station_range",
    "obstacle_effect", "corr_matrix", "add_coordinates", "station_lookup_temporal", "connecting_trains", "obstacles_on_path",
    "incremental_refresh", "upsert_update", "dedup_keep_last", "top_k", "connection_score", "ml_frame", "delay_labels", "roc_auc",
    "stop_distances",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(CATALOG) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "0"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the engine before the clock
    tables = Tables(spark, folder)
    start = time.perf_counter()
    # the stop-event table, its copy by date, its refreshed form, the edge table and the raw feeds are stored once, like the nightly
    # refresh does; the value counts it
    for feed in (lambda t: t.stops, lambda t: t.stops_by_date, lambda t: t.delayed, lambda t: t.edge_table, raw_plan, raw_change, raw_connections):
        feed(tables).count()
    prepare = round(time.perf_counter() - start, 3)
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    measured = sum(seconds.values())
    line = {"metric": "headline_total_with_preparation", "value": round(measured + prepare, 3), "unit": "sec", "queries": seconds,
            "sf": float(found.group(1)) if found else None, "queries_sec": round(measured, 3), "prepare_sec": prepare}
    if os.environ.get("BENCH_DUCKDB") == "1":
        line["duckdb"] = duckdb_seconds(folder, names)
    print(json.dumps(line))


def duckdb_seconds(folder: str, names: list[str]) -> dict[str, float]:
    from stopwise.checks import connect

    connection = connect(folder)
    out = {}
    for name in names:
        if CATALOG[name].sql:
            start = time.perf_counter()
            connection.execute(CATALOG[name].sql).fetchall()
            out[name] = round(time.perf_counter() - start, 3)
    return out


if __name__ == "__main__":
    main()
