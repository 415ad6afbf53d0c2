"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from logcompact.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "savings_summary", "savings_by_command", "registry_coverage", "run_savings",
    "split_lines", "line_flags", "classify_commands", "loop_guard",
    "match_rule", "apply_rules", "dedup_adjacent", "cap_grep_hits",
    "compact_plain", "test_event_summary", "tap_summary", "junit_summary", "compact",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logcompact-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
    )
    if not builder.getOrCreate().conf.get("spark.checkpoint.dir", None):
        builder.getOrCreate().conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="logcompact-bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()

    seconds: dict[str, float] = {}
    for name in chosen:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    rates = {n: round(events / seconds[n]) for n in ("apply_rules", "compact_plain", "compact") if n in seconds}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "lines_per_second": rates,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
