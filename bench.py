"""Time the headline queries: one JSON line with the median of warm runs per query.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the cores, ``BENCH_REPEAT`` the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidewake.plans.queries import QUERIES
from tidewake.session import get_session

HEADLINE = [
    "ingest_routes", "validate_frames", "latest_state", "upsert_state", "append_track", "fleet_kpis",
    "fleet_summary", "speed_histogram", "speed_stats", "nav_distribution", "flow_rose", "maneuvering",
    "nearby", "nearby_many", "conflicts", "conflicts_fleet", "conflicts_geodesic", "data_quality",
    "latency_stats", "retention_report", "track_linestring", "stream_state", "stream_track",
]
ONCE = {"stream_state", "stream_track"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for i in range(1 if name in ONCE else repeat + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).lstrip("sf"),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
