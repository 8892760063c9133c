"""On a cluster, a folder with a ``file`` name may be a mount that all machines share; it is tried out and not refused for its name."""

import glob

import pytest

from tallyhaul.operators import copy, integrity
from tallyhaul.sources import storage


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session under the name of a cluster's master; its folder was not tried out yet."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(storage, "_REACHED", {}, raising=False)
    return spark


def tries(spark):
    return glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/tallyhaul/reach-*")


def counted(monkeypatch, found):
    """Calls of the trial, which answers ``found`` or raises it."""
    calls = []

    def trial(spark, folder, tasks):
        calls.append((folder, tasks))
        if isinstance(found, Exception):
            raise found
        return found

    monkeypatch.setattr(storage, "_comes_back", trial)
    return calls


def test_mounted_folder_is_used_on_a_cluster(cluster):
    df = cluster.range(100).selectExpr("id AS k", "id % 7 AS v")
    assert storage.settle(df, "rows").count() == 100
    path = storage.scratch(cluster, "copy") + "/t"
    assert path.startswith(f"{cluster.conf.get('spark.checkpoint.dir')}/tallyhaul/")
    copy.copy_full(df, path, allow_destructive=True)
    assert cluster.read.parquet(path).count() == 100
    assert integrity.fk_orphans(df, cluster.range(50).selectExpr("id AS k"), {"k": "k"}).count() == 50
    assert not tries(cluster)


def test_folder_is_tried_once_and_for_machines_that_come(cluster, monkeypatch):
    calls = counted(monkeypatch, True)
    for _ in range(3):
        storage.shared_folder(cluster)
    assert len(calls) == 1
    monkeypatch.setattr(storage, "_executors", lambda spark: ["a:1", "a:2", "b:1"])
    for _ in range(3):
        storage.shared_folder(cluster)
    assert [tasks for _, tasks in calls[1:]] == [6]


@pytest.mark.parametrize("found", [False, OSError("no such file")])
def test_folder_that_is_not_shared_is_refused(cluster, monkeypatch, found):
    calls = counted(monkeypatch, found)
    for _ in range(2):  # it may be mounted meanwhile
        with pytest.raises(ValueError, match="not all executors share"):
            storage.settle(cluster.range(9), "rows")
    assert len(calls) == 2
    cluster.conf.set(storage.LOCAL_IS_SHARED, "true")
    try:
        assert storage.settle(cluster.range(9), "rows").count() == 9 and len(calls) == 2
    finally:
        cluster.conf.unset(storage.LOCAL_IS_SHARED)


def test_what_does_not_come_back_is_seen(cluster, monkeypatch):
    """A file of a task that is not where the driver looks."""
    read = type(cluster).read.fget

    def lossy(spark):
        for folder in tries(spark):
            for lost in glob.glob(f"{folder}/part-00001*"):
                storage.remove(spark, lost)
        return read(spark)

    monkeypatch.setattr(type(cluster), "read", property(lossy))
    with pytest.raises(ValueError, match="not all executors share"):
        storage.shared_folder(cluster)


def test_no_trial_on_one_machine(spark, monkeypatch):
    calls = counted(monkeypatch, False)
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir") and not calls
