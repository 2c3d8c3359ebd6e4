"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = [
    "j9_event_series_lookup",
    "o3_common_view",
    "j3_doi_match",
    "j4_place_and_date_match",
    "j10_location_enrich",
    "a1_source_counts",
    "a5_non_null_profile",
    "a9_create_lookup",
    "a14_histogram_bins",
    "w1_row_number",
    "w3_coverage_cut",
    "p1_clean_dblp",
    "p2_clean_crossref",
    "p10_clean_tibkat",
    "x3_parse_description",
    "x11_title_annotate",
    "x15_wikicfp_pivot",
    "d1_dedup_by_title",
    "d2_complete_series",
    "m2_evaluate_matches",
    "m4_scores",
    "g2_entity_flatten_agg",
    "g6_closure",
    "u1_upsert",
    "s3_ftx_documents",
    "s14_page_fields",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from eventloom.plans.registry import queries
    from eventloom.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    plans = queries()
    wanted = sys.argv[1:] or HEADLINES
    # start the JVM code paths, the Python workers and the file cache before timing
    plans["a1_source_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    plans["s14_page_fields"](spark, folder).write.format("noop").mode("overwrite").save()
    plans["j9_event_series_lookup"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        began = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
