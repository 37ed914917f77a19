"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tidelog.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "cdc_filtered_state", "cdc_state_pk_change", "ivm_count_sum", "ivm_zero_groups", "ivm_last_value", "image_filter_transitions", "stitch_snapshot_changelog", "copy_progress_by_table",
    "env_default", "env_maxwell", "env_flat", "snapshot_resume_keyset", "snapshot_byte_batches", "gtid_executed", "txn_grouping", "rate_limit_admission", "heartbeat_gaps",
    "math_over_lineitem", "metrics_histogram", "state_join_dimensions", "stream_state_equals_batch", "stream_aggregate_equals_batch",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    # The first query warms the JVM up; it is timed again with the others.
    run(HEADLINE[0])
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 3)
    changes = QUERIES["image_filter_transitions"](spark, SF_DIR)
    total = sum(seconds.values())
    print(json.dumps({"metric": "headline_total", "value": round(total, 3), "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name, "groups": changes.count()}))


if __name__ == "__main__":
    main()
