"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every query is written to the no-op sink, so all columns of all
rows are computed and nothing is collected. One small query warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from boxtrail.plans.catalog import QUERIES

HEADLINE = (
    "entity_rank", "layout_paragraphs", "ground_sentences", "resolve_hops", "assemble_samples", "reconcile_chain",
    "slide_convert", "hash_split", "build_candidates", "distractors_same_deck", "target_json", "lenient_parse",
    "score_predictions", "summary_gated", "evaluate_by_type", "metric_asof", "trim_totals",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("boxtrail-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    names = sys.argv[1:] or HEADLINE
    QUERIES["hop_distribution"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
