"""Time the headline queries: one warm-up, then the median of three runs into a noop sink."""

from __future__ import annotations

import json
import os
import statistics
import time

from quirekit.plans import load_all
from quirekit.session import build_session

HEADLINE = [
    "flagship_page_qa",
    "str_02_strip_tags",
    "str_04_modern_punctuation",
    "str_11_collapse_image_payloads",
    "str_16_sanitize_plain",
    "str_18_visible_text",
    "str_30_abbreviations",
    "sec_01_redact_secrets",
    "htm_05_dedupe_paragraphs",
    "htm_04_toc_rows",
    "leg_04_heading_levels",
    "cls_07_output_qa",
    "cls_11_model_routing",
    "cls_17_page_structure",
    "agg_02_progress_summary",
    "agg_08_text_layer_audit",
    "joi_01_add_new_paths",
    "joi_08_scope_pages",
    "win_05_text_batches",
    "win_14_queue_ordinal",
    "stm_06_cache_reuse",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "quirekit-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    timings = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 4)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
