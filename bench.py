"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from tallyhaul.queries import QUERIES, TABLES
from tallyhaul.session import build_session

HEADLINE = ("fingerprint_events", "fingerprint_lineitem", "row_diff_orders", "row_diff_chunked_orders", "bag_diff_lineitem", "chunk_diff_orders",
            "column_diff_orders", "verify_orders", "verify_tables", "copy_full_orders", "chunked_copy_lineitem",
            "copy_partition_wise_orders", "csv_roundtrip_documents", "sync_missing_orders", "clustered_lineitem",
            "assign_keys_customer", "fk_orphans_orders", "pk_duplicates_lineitem", "dedupe_lineitem", "profile_tables",
            "profile_columns", "schema_drift", "readiness", "run_summary_events", "join_star_lineitem",
            "stream_copy_events")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("profile_tables")  # JVM and file caches warm, as in a running session
    seconds, rows_per_second = {}, {}
    for name in HEADLINE:
        seconds[name] = round(run(name), 3)
    size = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in TABLES}
    for name in HEADLINE:
        table = name.rpartition("_")[2]
        if table in size:
            rows_per_second[name] = round(size[table] / seconds[name])
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "rows_per_second": rows_per_second, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
