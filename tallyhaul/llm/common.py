"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from ..sources import storage

#: Documents in an Arrow batch: a few MB of usual texts, so that a task's Python stays small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's source, once per application; on a cluster they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="package-"), "tallyhaul_source.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("tallyhaul", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def small_batches(spark: SparkSession) -> None:
    """For operators that run Python: their package goes to the executors, and long texts come in short Arrow
    batches. The setting is read when a plan is made, so it stays set."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lean(spark: SparkSession) -> None:
    """For operators with long rows and many stages, besides ``small_batches``: batches between JVM and Python, and those read from Parquet,
    are short in bytes as well, and a query's shuffle files go when it ends (each stored table is a query of its own)."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def return_memory() -> None:
    """In a worker process, which lives on between tasks: memory that is freed goes back to the system at once."""
    import ctypes

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 19)  # arrays from half a megabyte on are mapped, and unmapped when freed
    except (AttributeError, OSError):  # another C library
        pass


def trim_memory() -> None:
    """In a worker process, after a large step: pages that are free now go back to the system."""
    import ctypes

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def drop(*stored: DataFrame) -> None:
    """Remove tables that ``settle`` stored, when all that was made from them is stored as well."""
    for df in stored:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            storage.remove(df.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of ended queries go when the driver's garbage is collected; ask for that between large steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and the planner then knows the size."""
    return storage.settle(df, label)


def fresh(name: str, taken) -> str:
    """``name``, or a name beside it that no column in ``taken`` has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"{name}_{uuid.uuid4().hex[:8]}"
    return name
