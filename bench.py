"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 3; the median counts) set the run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from marketlens.plans.catalogue import all_queries  # noqa: E402
from marketlens.session import build_session  # noqa: E402

HEADLINE = [
    "s1_table",
    "s4_csv",
    "s9_snapshot",
    "s12_diff_tables",
    "f1_contains",
    "f12_value_counts_text",
    "f19_restaurants_by_category",
    "p2_page_latest",
    "r2_category_summary",
    "r3_priciest",
    "r5_price_by_category",
    "r6_without_products",
    "r8_rating_bands",
    "j1_menu_size",
    "j2_top_item_per_restaurant",
    "j5_category_analysis",
    "j6_price_matrix",
    "j7_missing_descriptions",
    "j9_orphans",
    "t1_numeric_profile",
    "t2_text_profile",
    "t8_dashboard",
    "q2_drop_exact_duplicates",
    "q11_duplicate_names_normalised",
    "q15_quality_report",
    "q16_validate",
    "e7_fill_all",
    "m5_patch",
    "m10_cascade_children",
    "m12_drop_orphans",
    "d5_pending",
    "g11_extract_links",
    "g13_parse_cards",
    "g13_insert_new_restaurants",
    "g14_insert_new_products",
    "g16_assign_ids",
    "g19_stream_ingest",
    "h4_log_stats",
    "h7_retain_log",
    "h8_latency_grades",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every row and column and keeps none.
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once("j5_category_analysis")
    seconds = {name: round(statistics.median(once(name) for _ in range(runs)), 4) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
                "master": f"local[{cpus}]",
                "runs": runs,
                "spark": pyspark.__version__,
            }
        )
    )


main()
