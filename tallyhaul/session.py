"""Session settings the jobs in this package are written for."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import SparkSession

A, B = TypeVar("A"), TypeVar("B")

# Everything here is a plain Spark setting; a cluster may override any of them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot join keys and hot write groups are split by the runtime re-plan
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # one copied partition is replaced, the others stay
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def side_by_side(work: Callable[[A], B], items: Iterable[A], threads: int = 8) -> list[B]:
    """Results in order. Opening a table or building its plan waits on file listings and the analyser;
    over hundreds of tables those waits overlap. No table data passes through here."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(work, items))


def build_session(app_name: str = "tallyhaul", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
