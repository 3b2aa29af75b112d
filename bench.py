"""Time headline queries and print one JSON line: each query cold (it makes the tables it shares with others) and warm (they are stored)."""

from __future__ import annotations

import json
import os
import time

from harvestlens.catalog import base, load
from harvestlens.session import build_session

HEADLINE = [
    "a01_growing_season", "j01_one_scan_seasons", "j03_q01_merged_yield_weather", "j05_stations_in_counties",
    "a04_monthly_station", "a07_q02_state_features", "a10_q03_extreme_event_counts", "w08_j04_monthly_anomalies",
    "w11_longest_dry_run", "w12_max_five_day_rain", "a08_climatology", "a24_event_value_distribution", "s21_upsert_orders",
    "s25_q18_change_feed", "r01_stream_append", "r08_stream_season", "w01_w02_q04_signal_table", "a46_q07_summary_levels",
    "m17_q17_mann_whitney", "a24_q10_lookup_distribution", "m06_forest_importance_by_crop",
]


def timed(run, spark, sf_dir: str) -> float:
    start = time.time()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = load()
    # a first small query starts the executors and loads the classes
    timed(registered["a48_distinct_stations"].run, spark, sf_dir)
    cold, warm = {}, {}
    for name in HEADLINE:
        base._STORED.clear()
        cold[name] = round(timed(registered[name].run, spark, sf_dir), 3)
        warm[name] = round(timed(registered[name].run, spark, sf_dir), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "cold_total": round(sum(cold.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
