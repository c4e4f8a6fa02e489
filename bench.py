"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the number of cores.
The index tables are built first and timed on their own; every query then runs
once to warm up and three times to be timed, into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from workload.queries import QUERIES
from workload.tables import corpus

HEADLINE = [
    "match_and", "tf_rank_topk", "bm25_topk", "bm25_threshold", "bm25_content_field", "bm25_english",
    "df_word_boundary", "vector_topk", "ann_topk", "rrf_topk", "rrf_weight_sweep",
    "match_analysis", "vector_explanation", "term_contributions", "headline", "snippet", "side_by_side", "method_overlap",
    "spam_ratio", "rag_context", "validation_checks", "frontmatter_load", "surrogate_keys", "embed_documents",
]
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    c = corpus(spark, sf_dir)
    build: dict[str, float] = {}
    for name, make in [("documents", c.documents), ("index", c.index), ("content_index", c.content_index),
                       ("english_index", c.english_index), ("cell_index", c.cell_index)]:
        start = time.perf_counter()
        make()
        build[name] = round(time.perf_counter() - start, 3)

    seconds: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in only:
        runs = []
        for _ in range(REPEATS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        cold[name] = round(runs[0], 3)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "first_run": cold, "build": build, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
