"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from inkfold.plans import catalog
from inkfold.session import build_session

HEADLINE = [
    "region_confidence_filter", "suppress_duplicates", "assign_balloons", "reading_order_rtl", "balloon_seams", "dedup_lines", "fan_out_answers",
    "context_window", "cast_fold", "glossary_first_wins", "lenient_terms", "ink_runs", "character_size", "otsu_threshold", "dilate_mask", "connected_components",
    "hyphen_wrap", "font_fit_hyphens", "translate_pages", "divide_space", "streamed_cast", "streamed_corrections", "patched_regions", "archive_round_trip", "strict_stories", "remembered_answers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), "16g")
    catalog.QUERIES["region_kind_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the executors
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
