"""A stored tree of fingerprints over key ranges, which is kept between runs.

Leaves are ranges of ``leaf_width`` whole-number keys, and a node stands for ``fanout`` nodes below it; the
uppermost level has ``fanout`` nodes at most. A node's
fingerprint is the sum of its rows' hashes, so it is also the sum over the files that hold them. The tree keeps those sums per file and leaf:
a refresh lists the files and reads only those that are new or were written again. Two trees are compared from above down, and of each level
only the children of nodes that differ are read. Rows are read last, from the files that hold a leaf that differs.

On disk: ``files`` (file, size, time), ``parts`` (leaf sums per file), ``levels`` (nodes, a directory for each level), each in
a directory of its own per refresh; the tree's newest version is the highest-numbered one that is complete.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.canonical import hash_pieces, row_hash, sql_name
from ..sources import storage
from .compare import diff_rows

_SUMS = ("row_count", "s0", "s1", "s2")
_PARTS = "file string, leaf bigint, row_count bigint, s0 bigint, s1 bigint, s2 bigint"
_LEVELS = "level int, node bigint, row_count bigint, s0 bigint, s1 bigint, s2 bigint"
_FILES = "file string, path string, size bigint, written timestamp"
#: Leaves next to each other are read as one range; with more ranges than this the leaf numbers are joined.
MOST_RANGES = 500
NULL_LEAF = -(1 << 62)


@dataclass(frozen=True)
class Tree:
    """A table's tree as it was stored at ``path``. ``scanned`` files were read by the refresh that made it."""

    path: str
    table_path: str
    key: str
    leaf_width: int
    fanout: int
    depth: int
    scanned: int = 0

    def parts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_PARTS).parquet(f"{self.path}/parts")

    def level(self, spark: SparkSession, level: int) -> DataFrame:
        """Nodes of one level; other levels are other directories and are not read."""
        return spark.read.schema(_LEVELS).parquet(f"{self.path}/levels").filter(F.col("level") == level).drop("level")


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions, oldest first."""
    if not storage.exists(spark, path):
        return []
    names = storage.children(spark, path)
    return [f"{path}/{n}" for n in sorted(names) if n.startswith("v") and storage.exists(spark, f"{path}/{n}/tree.json")]


def open_tree(spark: SparkSession, path: str) -> Tree | None:
    """The newest complete version, or None."""
    found = _versions(spark, path)
    return Tree(found[-1], **json.loads(storage.read_text(spark, f"{found[-1]}/tree.json"))) if found else None


def _listed(spark: SparkSession, table_path: str) -> DataFrame:
    """Data files with size and time of writing, listed by Spark; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(table_path)
    return listed.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("written"))


def _rows(spark: SparkSession, table_path: str, paths: Sequence[str]) -> DataFrame:
    """Some files of a table, with all of its columns."""
    return spark.read.schema(spark.read.parquet(table_path).schema).option("basePath", table_path).parquet(*paths)


def _summed(rows: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _leaf(key: str, leaf_width: int) -> Column:
    """NULL keys have a leaf of their own, below all others."""
    name = f"cast({sql_name(key)} AS bigint)"
    return F.expr(f"coalesce(({name} - pmod({name}, {leaf_width}L)) div {leaf_width}L, {NULL_LEAF}L)")


def _above(fanout: int) -> Column:
    return F.expr(f"(node - pmod(node, {fanout}L)) div {fanout}L")


def refresh(spark: SparkSession, table_path: str, path: str, key: str, leaf_width: int = 4096, fanout: int = 16) -> Tree:
    """Bring the tree at ``path`` up to date with the files of a Parquet table and return it.

    Only files that the tree does not know, or knows with another size or time, are scanned. A refresh that fails leaves the version before it
    in place; the version before last is removed."""
    old, files = open_tree(spark, path), storage.settle(_listed(spark, table_path), "merkle_files")
    if fanout < 4:
        raise ValueError("a node stands for four nodes at least")
    if old and (old.key, old.leaf_width, old.fanout) != (key, leaf_width, fanout):
        raise ValueError(f"the tree at {path} has another key, leaf width or fanout")
    stored = spark.read.schema(_FILES).parquet(f"{old.path}/files") if old else spark.createDataFrame([], _FILES)
    same = files.join(stored, ["file", "size", "written"], "left_semi").select("file")
    new = [r.path for r in files.join(same, "file", "left_anti").select("path").collect()]  # as many as will be opened by the scan
    target = f"{path}/v{len(_versions(spark, path)) and int(old.path.rpartition('/v')[2]) + 1:08d}"
    if storage.exists(spark, target):  # a refresh that did not end
        storage.remove(spark, target)
    if old is None or new or files.count() != stored.count():
        parts = None
        if new:
            df = _rows(spark, table_path, new)
            rows = df.select(F.col("_metadata.file_path").alias("file"), _leaf(key, leaf_width).alias("leaf"), row_hash(df).alias("h"))
            pieces = [F.expr(f"{p} AS {c}") for p, c in zip(hash_pieces("h"), _SUMS[1:])]
            parts = _summed(rows.select("file", "leaf", F.lit(1).cast("bigint").alias("row_count"), *pieces), ["file", "leaf"])
        if old:
            kept = old.parts(spark).join(same, "file", "left_semi")
            parts = kept if parts is None else kept.unionByName(parts.select(*kept.columns))
        (parts if parts is not None else spark.createDataFrame([], _PARTS)).write.parquet(f"{target}/parts")
    else:
        return old
    files.write.parquet(f"{target}/files")
    nodes = storage.settle(_summed(spark.read.schema(_PARTS).parquet(f"{target}/parts"), [F.col("leaf").alias("node")]), "merkle_level")
    depth = 0
    nodes.write.parquet(f"{target}/levels/level=0")
    while nodes.count() > fanout:
        depth += 1
        nodes = storage.settle(_summed(nodes, [_above(fanout).alias("node")]), "merkle_level")
        nodes.write.parquet(f"{target}/levels/level={depth}")
    about = {"table_path": table_path, "key": key, "leaf_width": leaf_width, "fanout": fanout, "depth": depth, "scanned": len(new)}
    storage.write_text(spark, f"{target}/tree.json", json.dumps(about))
    for gone in _versions(spark, path)[:-2]:
        storage.remove(spark, gone)
    return open_tree(spark, path)


def differing_leaves(spark: SparkSession, source: Tree, target: Tree) -> DataFrame:
    """``(leaf)``, settled: leaves whose fingerprints differ, found level by level from above."""
    if (source.leaf_width, source.fanout) != (target.leaf_width, target.fanout):
        raise ValueError("the trees have other leaf widths or fanouts")
    differs = " OR ".join(f"NOT s.{c} <=> t.{c}" for c in _SUMS)
    above = None
    for level in range(min(source.depth, target.depth), -1, -1):
        sides = [tree.level(spark, level) for tree in (source, target)]
        if above is not None:
            sides = [s.withColumn("parent", _above(source.fanout)).join(above, "parent", "left_semi") for s in sides]
        s, t = (x.select("node", *_SUMS).alias(a) for x, a in zip(sides, "st"))
        bad = s.join(t, "node", "full").filter(differs).select("node")
        above = storage.settle(bad.withColumnRenamed("node", "parent"), "merkle_differs")
        if above.isEmpty():
            break
    return above.withColumnRenamed("parent", "leaf")


def _rows_of(spark: SparkSession, tree: Tree, leaves: DataFrame, ranges: list | None) -> DataFrame:
    """Rows of the leaves, from the files that hold them."""
    held = tree.parts(spark).join(leaves, "leaf", "left_semi").select("file").distinct()
    paths = [r.path for r in spark.read.schema(_FILES).parquet(f"{tree.path}/files").join(held, "file", "left_semi").select("path").collect()]
    if not paths:
        return spark.read.parquet(tree.table_path).limit(0)
    rows = _rows(spark, tree.table_path, paths)
    if ranges is None:
        columns = rows.columns
        return rows.withColumn("_leaf", _leaf(tree.key, tree.leaf_width)).join(leaves.withColumnRenamed("leaf", "_leaf"), "_leaf", "left_semi").select(*columns)
    name, low = sql_name(tree.key), NULL_LEAF
    tests = [f"{name} IS NULL" if a == low else f"{name} >= {a * tree.leaf_width} AND {name} < {(b + 1) * tree.leaf_width}" for a, b in ranges]
    return rows.filter(" OR ".join(f"({t})" for t in tests))


def _ranges(leaves: DataFrame) -> list[tuple[int, int]] | None:
    """First and last leaf of each stretch of neighbours; None if there are too many for a filter."""
    numbers = [r.leaf for r in leaves.orderBy("leaf").limit(MOST_RANGES * 16 + 1).collect()]
    if len(numbers) > MOST_RANGES * 16:
        return None
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out if len(out) <= MOST_RANGES else None


def merkle_diff(spark: SparkSession, source: Tree, target: Tree, keys: Sequence[str]) -> DataFrame:
    """As :func:`compare.diff_rows` for the two tables, reading branches that differ and rows of leaves that differ. ``keys`` must hold the trees' key,
    for a key's rows have to lie in one leaf."""
    if source.key != target.key or source.key not in keys:
        raise ValueError("the rows of a key have to lie in one leaf: name the trees' key among the keys")
    leaves = differing_leaves(spark, source, target)
    ranges = _ranges(leaves)
    return diff_rows(*[_rows_of(spark, tree, leaves, ranges) for tree in (source, target)], keys)


def new_tree_path(spark: SparkSession, label: str) -> str:
    return f"{storage.scratch(spark, label)}/tree_{uuid.uuid4().hex[:8]}"
