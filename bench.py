"""Seconds per headline query: median of warm runs, one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import time

from wardframe.plans import QUERIES
from wardframe.session import get_session

HEADLINE = (
    "cohort_select", "chart_unit_convert", "vent_state", "prescription_doses", "first_lab",
    "note_biomarkers_flowsheet", "note_medications", "note_nutrition_labs", "notes_fact",
    "hourly_grid", "minmax_scale", "impute_linear", "impute_knn", "masked_metrics", "dilate", "mmd_scalar",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
