"""Directories on whatever file system the cluster uses (HDFS, object store, local)."""

from __future__ import annotations

import tempfile
import uuid
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise IOError(f"could not rename {old} to {new}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a directory."""
    fs, p = _at(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(p)]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it is written beside its place and renamed. One that is there already is an error."""
    beside = f"{path}.{uuid.uuid4().hex}"
    fs, p = _at(spark, beside)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename(spark, beside, path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file that :func:`write_text` wrote."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(fs.getFileStatus(p).getLen())).decode()
    finally:
        stream.close()


def partition_directory(spark: SparkSession, column: str, value) -> str:
    """The directory name that a partitioned write gives a value."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.getPartitionPathString(column, None if value is None else str(value))


def size_in_bytes(spark: SparkSession, path: str) -> int:
    """Stored size of a table directory, from the file listing and not from a scan."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength()


def files_for(spark: SparkSession, path: str, bytes_per_file: int = 256 << 20, at_least: int = 1) -> int:
    """How many files of about ``bytes_per_file`` a copy of the table at ``path`` should have."""
    return max(at_least, -(-size_in_bytes(spark, path) // bytes_per_file))


def settle(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write a short intermediate result (keys, chunk numbers) to the shared folder and read it back.

    The planner then knows its size: a join with it is a broadcast when that is
    under the session's limit and a shuffle when it is not, and the big side is
    not shuffled before that is known. It also ends the lineage at a stored table.
    """
    spark = df.sparkSession
    path = scratch(spark, label) + "/rows"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swap_in(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished staging directory in the place of ``target``.

    The old directory is kept under another name until the new one is in place
    and is put back if that fails, so a reader never finds half a table.
    """
    if not exists(spark, target):
        rename(spark, staged, target)
        return
    retired = f"{target}__old_{uuid.uuid4().hex}"
    rename(spark, target, retired)
    try:
        rename(spark, staged, target)
    except Exception:
        rename(spark, retired, target)
        raise
    remove(spark, retired)


#: A cluster may mount one file system everywhere; then it may say so, and the folder is not tried out.
LOCAL_IS_SHARED = "spark.tallyhaul.localFolderIsShared"

#: By application and folder: the machines that were found to reach it.
_REACHED: dict[tuple[str, str], set[str]] = {}
_TRYING = Lock()


def _executors(spark: SparkSession) -> list[str]:
    """``host:port`` of the driver and of every executor that is there now."""
    return spark.sparkContext._jsc.sc().getExecutorMemoryStatus().keys().mkString(",").split(",")


def _comes_back(spark: SparkSession, folder: str, tasks: int) -> bool:
    """Whether what ``tasks`` tasks write into the folder, a file each, is all found and read there again."""
    path = f"{folder}/tallyhaul/reach-{uuid.uuid4().hex}"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == tasks
    finally:
        remove(spark, path)


def _require_reach(spark: SparkSession, folder: str) -> None:
    """Raise if a ``file`` folder is not one that all machines share, which its name does not tell.

    Files that a task leaves on its own machine are missing when the driver puts a table in place, without an error. So tasks on all
    executors write there first; free executors get a task each before one gets a second. Machines that come later are asked when they are seen.
    """
    with _TRYING:
        executors = _executors(spark)
        machines = {e.rpartition(":")[0] for e in executors}
        reached = _REACHED.setdefault((spark.sparkContext.applicationId, folder), set())
        if machines <= reached:
            return
        what = (f"{folder} is a local folder that not all executors share; name one that all of them reach in spark.checkpoint.dir, or set "
                f"{LOCAL_IS_SHARED}=true if it is a mount that they share")
        try:
            back = _comes_back(spark, folder, 2 * len(executors))
        except Exception as failed:
            raise ValueError(what) from failed
        if not back:
            raise ValueError(what)
        reached |= machines


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``; on a cluster, a ``file`` folder is tried out."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    if folder and not local and spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
            spark._jsc.hadoopConfiguration()).getScheme() == "file" and spark.conf.get(LOCAL_IS_SHARED, "false") != "true":
        _require_reach(spark, folder.rstrip("/"))
    if folder:
        return folder.rstrip("/")
    if local:
        return tempfile.mkdtemp(prefix="tallyhaul-")
    raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def scratch(spark: SparkSession, label: str) -> str:
    """A new directory in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/tallyhaul/{label}-{uuid.uuid4().hex}"
    fs, p = _at(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path
