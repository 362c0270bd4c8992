"""Headline queries timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from terrarank.plans.catalog import QUERIES
from terrarank.session import local_session

HEADLINES = [
    "place_search", "search_scores", "percentile_bounds", "area_scores", "area_results", "place_index", "place_lookup", "exposure_by_tract", "composed_source",
    "nearest_stations", "point_in_polygon", "event_days_per_cell", "shrunk_medians", "bootstrap_variance", "climate_types", "household_taxes", "incident_reduction",
    "schools_in_district", "wide_table", "replaced_partitions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus), app="bench")
    QUERIES["place_search"].run(spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
