"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from marginalia.plans.queries import REGISTRY
from marginalia.session import build_session

HEADLINE = (
    "skip_reason_counts",
    "skip_reason_share_by_file",
    "file_profile",
    "parse_labels",
    "label_counts",
    "training_gate",
    "duplicate_texts",
    "split_assign",
    "chunk_rows",
    "tokenize_truncate",
    "token_label_counts",
    "nb_weights",
    "nb_scores",
    "scored_rows",
    "label_metrics",
    "early_stop_choice",
    "category_summary",
    "combined_output",
    "csv_scan",
    "stream_skip_counts",
    "predicted_categories",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="marginalia-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - start
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries, best of 2 runs each",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
