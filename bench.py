"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
BENCH_PYTHON=1 adds the time of a plain single-process Python loop over ``documents``.
"""

import json
import os
import re
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from maskwright.rules import default_rules  # noqa: E402
from suite.queries import QUERIES  # noqa: E402

HEADLINES = [
    "sanitize_documents", "sanitize_pages", "sanitize_conversations", "sanitize_order_log", "threshold_080",
    "profile_k8s", "custom_rules", "candidates_by_label", "report_by_label", "rollup_source", "report_per_text",
    "audit_log", "policy_per_source", "dictionary_locations", "change_detection", "masked_events",
]


def run(spark, sf_dir, name) -> float:
    start = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def python_loop(spark, sf_dir) -> float:
    """Detection only, one process, every rule over every document."""
    documents = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    compiled = [re.compile(r.pattern) for r in default_rules()]
    start = time.time()
    for text in documents:
        for rx in compiled:
            for _ in rx.finditer(text):
                pass
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, sf_dir, "sanitize_conversations")  # warm up the JVM
    times = {}
    for name in HEADLINES:
        print(name, file=sys.stderr, flush=True)
        times[name] = round(run(spark, sf_dir, name), 3)
        print(times[name], file=sys.stderr, flush=True)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}
    if os.environ.get("BENCH_PYTHON"):
        line["python_loop_documents"] = round(python_loop(spark, sf_dir), 3)
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
