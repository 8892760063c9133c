"""Run logs: an append-only relation of steps, read back for resuming and for summaries."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import side_by_side
from ..sources import storage

LOG_SCHEMA = "run_id string, step_id string, ok boolean, elapsed_s double, row_count bigint, error string, logged_at timestamp"


# What a report tells its reader to do next.
NEXT_ACTIONS = {
    "failed_steps": "Review failed steps in the run log before retrying.",
    "failed_tables": "Inspect verification mismatches before cutover.",
    "open_review": "Resolve outstanding manual-review items.",
    "none": "Migration completed cleanly.",
}


def latest_steps(run_log: DataFrame, order: str = "logged_at") -> DataFrame:
    """The last entry of each step of each run; earlier tries of a step no longer count."""
    return (run_log.groupBy("run_id", "step_id")
            .agg(F.max_by("ok", order).alias("ok"), F.sum("elapsed_s").alias("elapsed_s")))


def pending_steps(steps: DataFrame, run_log: DataFrame, order: str = "logged_at") -> DataFrame:
    """Steps still to run: not logged, or not ok at their last try. A failed step is tried again."""
    done = latest_steps(run_log, order).filter("ok").select("run_id", "step_id")
    return steps.join(done, ["run_id", "step_id"], "left_anti")


def run_steps(spark: SparkSession, run_id: str, steps: dict[str, Callable[[], int]], log_path: str,
              at_once: int = 4) -> DataFrame:
    """Run the steps of ``run_id`` that are not done yet and return the log of all tries.

    A step is a function, such as a table copy, that starts its own Spark jobs
    and returns a row count. Steps start in the order given, so put the largest
    table first. A failed one is logged and stops no other; every step is logged
    as it ends, so a run that is killed starts again where it was.
    """
    if not storage.exists(spark, log_path):
        spark.createDataFrame([], LOG_SCHEMA).write.parquet(log_path)
    wanted = spark.createDataFrame([(run_id, s) for s in steps], "run_id string, step_id string")
    open_steps = {r["step_id"] for r in pending_steps(wanted, spark.read.parquet(log_path)).collect()}
    one_writer = threading.Lock()

    def one(step: str) -> None:
        start, rows, error = time.monotonic(), None, None
        try:
            rows = steps[step]()
        except Exception as e:  # whatever a step meets belongs in the log and must not stop the others
            error = str(e)
        entry = (run_id, step, error is None, time.monotonic() - start, rows, error, datetime.now(timezone.utc))
        with one_writer:  # two appends to one directory at a time would clear each other's temporary files
            spark.createDataFrame([entry], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log_path)

    side_by_side(one, [s for s in steps if s in open_steps], at_once)
    return spark.read.parquet(log_path)


def run_summary(steps: DataFrame, run_log: DataFrame, order: str = "logged_at") -> DataFrame:
    """``(run_id, total_steps, ok_steps, failed_steps, skipped_steps, elapsed_s, success, next_action)`` per run.

    Steps and log entries meet in one aggregate by step, so a run with very many
    steps is spread over tasks by step before it is added up.
    """
    planned = steps.select("run_id", "step_id", F.lit(True).alias("_planned"), F.lit(None).cast("boolean").alias("ok"),
                           F.lit(None).cast(run_log.schema["elapsed_s"].dataType).alias("elapsed_s"),
                           F.lit(None).alias("_at"))
    logged = run_log.select("run_id", "step_id", F.lit(False).alias("_planned"), "ok", "elapsed_s",
                            F.col(order).alias("_at"))
    per_step = (planned.unionByName(logged).groupBy("run_id", "step_id")
                .agg(F.bool_or("_planned").alias("_planned"), F.max_by("ok", "_at").alias("ok"),
                     F.sum("elapsed_s").alias("elapsed_s")))
    sums = per_step.groupBy("run_id").agg(
        F.count_if("_planned").alias("total_steps"), F.count_if("ok").alias("ok_steps"),
        F.count_if(~F.col("ok")).alias("failed_steps"), F.coalesce(F.sum("elapsed_s"), F.lit(0)).alias("elapsed_s"))
    skipped = F.greatest(F.col("total_steps") - F.col("ok_steps") - F.col("failed_steps"), F.lit(0))
    return sums.select("run_id", "total_steps", "ok_steps", "failed_steps", skipped.alias("skipped_steps"), "elapsed_s",
                       (F.col("failed_steps") == 0).alias("success"), next_action(F.col("failed_steps") > 0).alias("next_action"))


def next_action(failed_steps: Column, failed_tables: Column | None = None, open_review: Column | None = None) -> Column:
    """What is left to do, joined by spaces."""
    tests = {"failed_steps": failed_steps, "failed_tables": failed_tables, "open_review": open_review}
    said = F.concat_ws(" ", *[F.when(test, NEXT_ACTIONS[name]) for name, test in tests.items() if test is not None])
    return F.when(said == "", NEXT_ACTIONS["none"]).otherwise(said)


def run_report(summary: DataFrame, verified: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Run summaries with the outcome of their verification and what is left to review by hand.

    ``verified`` is the one row of ``verify_summary``, or has such a row for each ``run_id``; a run without one was
    not verified, and counts as not failed there. ``reviews`` (run_id, open_reviews) may lack runs that have none.
    """
    both = summary.drop("next_action")
    if "run_id" in verified.columns:
        both = both.join(verified.select("run_id", F.col("ok").alias("verified"), "tables_checked",
                                         F.col("failed").alias("failed_tables")), "run_id", "left")
    else:
        both = both.withColumns({
            "verified": verified.select("ok").scalar(),
            "tables_checked": verified.select("tables_checked").scalar(),
            "failed_tables": verified.select("failed").scalar()})
    tests = {"failed_steps": F.col("failed_steps") > 0, "failed_tables": F.coalesce(F.col("failed_tables") != "", F.lit(False))}
    if reviews is not None:
        both = both.join(reviews.select("run_id", "open_reviews"), "run_id", "left").withColumn(
            "open_reviews", F.coalesce("open_reviews", F.lit(0)))
        tests["open_review"] = F.col("open_reviews") > 0
    return both.withColumns({
        "success": F.col("success") & F.coalesce("verified", F.lit(True)),
        "next_action": next_action(**tests)})
