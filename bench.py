"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query writes all of its rows to the no-op sink.
Derived input tables are staged before the clock starts; ``staging`` is the time that took.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from voxloom import registry
from voxloom.session import configure
from voxloom.sources import derived

HEADLINE = [
    "fuse",
    "vad_filter",
    "overlap_summary",
    "refine_call_center",
    "analyse",
    "transcript_json",
    "idempotent_ingest",
    "fenced_complete_jobs",
    "cascade_delete_deliveries",
    "apply_edits",
    "sweep",
    "delivery_step",
    "host_waves",
    "rate_limit",
    "stage_histogram",
    "rtf_k",
    "operate",
    "snr_db",
    "energy_vad",
    "sliding_energy",
    "linear_resample",
    "gated_transition",
    "labels_to_segments",
    "standardise",
    "cluster_average_linkage",
    "job_states",
]
STAGED = ["words", "segments", "intervals", "recordings", "utterances", "deliveries", "window_embeddings", "window_labels"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    builder = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
    # Small data on one machine: keep small partitions so that all cores have work.
    builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    builder = builder.config("spark.sql.files.openCostInBytes", "65536")
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    begin = time.time()
    for name in STAGED:
        getattr(derived, name)(spark, sf_dir)
    staging = time.time() - begin

    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        begin = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    line = {
        "metric": "total seconds, headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "staging": round(staging, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
