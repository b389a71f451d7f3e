"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from vitalgrid.plans.workload import QUERIES
from vitalgrid.session import build_session

HEADLINE = ["health_rates", "wait_by_query", "wait_rollup_fold", "activity_rollup", "top_queries", "redundant_indexes", "unindexed_fks", "partition_rollup",
            "schema_diff", "previous_snapshot", "same_hour_yesterday", "delta_query_mean", "retention_thin", "scrub_corpus", "suppress_findings",
            "mark_preexisting", "index_reports", "context_findings", "stream_wait_rollup", "fleet_findings"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("vitalgrid-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start-up cost stays out of the first query
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
