"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; arguments choose queries.
Every result is computed in full and sent to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from inkprint.session import local_session

HEADLINE = [
    "feature_table",
    "multilingual_feature_table",
    "avg_pmi",
    "tag_shares",
    "spelling_errors",
    "variability",
    "bigram_bag",
    "top_bigram_counts",
    "document_perplexity",
    "detected_language",
    "markup_to_text",
    "split_over_length",
    "zscores",
    "combined_features",
    "stratified_split",
    "equal_parts",
    "two_class_scores",
    "classification_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the engine
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    spark.stop()
    report = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 2),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
