"""Headline queries, warm: one run to compile, then the median of three.

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import workload.all  # noqa: F401
from fieldloom.session import build_session
from workload.base import REGISTRY, Inputs

HEADLINE = [
    "flagship_verdict_counts", "x2_invoice_labels", "x10_layered_merge", "v5_field_dispatch", "v4_record_verdict",
    "x5_line_items", "r3_table_markdown", "x27_bank_label_cells", "x29_html_table_classes", "x20_commission_month",
    "x24_content_fallbacks", "x37_agreement_fallbacks", "g8_tax_from_lines", "m_gst_amounts", "g7_page_merge",
    "x34_page_text_combine", "x9_answer_json", "x15_primary_fields", "w1_latest_by_name", "d4_replace_children",
    "j1_nested_children", "r1_markdown_report", "k12_output_names", "g4_extraction_summary", "invoice_records",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "4"))
    spark = build_session(
        "bench", f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            started = time.perf_counter()
            df = REGISTRY[name].run(Inputs(spark, sf_dir))
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        # the first run also compiles and is dropped when there are more
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cores), "shuffle_partitions": int(cores),
    }))


if __name__ == "__main__":
    main()
