"""Saved aggregates of a join that are kept up to date from changes, deletions included.

Changes are rows with a weight: +1 comes, -1 goes, and an update is one of each. Rows before a change count as +1. A join multiplies weights, so the
change of a join of R and S is dR with S, R with dS and dR with dS, and counts and sums of an aggregate change by weighted sums over that.
Old rows that no change meets are not joined: of the other table only rows with a changed key come in. A view keeps how many
joined rows stand behind each group; a group that loses its last one goes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.canonical import quoted, sql_name
from ..sources import storage

WEIGHT = "_weight"


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Rows with weights. An updated row stands in both: as it was among the deleted, as it is among the inserted."""
    parts = [df.withColumn(WEIGHT, F.lit(w).cast("bigint")) for df, w in ((inserted, 1), (deleted, -1)) if df is not None]
    if not parts:
        raise ValueError("no changes are given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def applied(before: DataFrame, change: DataFrame) -> DataFrame:
    """The table after the change: equal rows as often as their weights add up to. Raises in the scan if a row goes that is not there."""
    names = [sql_name(c) for c in before.columns]
    both = before.withColumn(WEIGHT, F.lit(1).cast("bigint")).unionByName(change)
    net = both.groupBy(*names).agg(F.sum(WEIGHT).alias("n"))
    copies = "if(n < 0, raise_error('a deleted row is not in the table'), if(n = 0, array(), array_repeat(1, cast(n AS int))))"
    return net.filter("n <> 0").select(*names, F.explode(F.expr(copies)).alias("_copy")).drop("_copy")


@dataclass(frozen=True)
class JoinView:
    """Group counts and sums over an inner join, saved in partitions of one grouping column.

    ``on`` maps left to right key columns, ``group`` and ``sums`` are expressions over the joined row by name; sums must be exact (whole
    numbers or decimals), since they are added and taken away again; NULL counts as 0 in them. NULL keys meet nothing."""

    on: dict[str, str]
    group: dict[str, str]
    sums: dict[str, str]
    partition: str
    count: str = "n"

    def _join(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Joined rows with the product of both weights."""
        r = right.withColumnRenamed(WEIGHT, "_other")
        met = left.join(r, F.expr(" AND ".join(f"{sql_name(a)} = {sql_name(b)}" for a, b in self.on.items())))
        return met.withColumn(WEIGHT, F.col(WEIGHT) * F.col("_other")).selectExpr(
            *[f"{e} AS {sql_name(n)}" for n, e in {**self.group, **self.sums}.items()], WEIGHT)

    def _aggregate(self, rows: DataFrame) -> DataFrame:
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        sums = [F.expr(f"sum(coalesce({sql_name(s)}, 0) * {'cast(' + WEIGHT + ' AS decimal(1,0))' if types[s].startswith('decimal') else WEIGHT})").alias(s)
                for s in self.sums]
        return rows.groupBy(*[sql_name(g) for g in self.group]).agg(F.sum(WEIGHT).alias(self.count), *sums)

    def computed(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The view from whole tables, with the types in which it is kept."""
        one = F.lit(1).cast("bigint")
        out = self._aggregate(self._join(left.withColumn(WEIGHT, one), right.withColumn(WEIGHT, one)))
        return self._kept(out)

    def _kept(self, rows: DataFrame) -> DataFrame:
        wide = [F.col(f.name).cast("decimal(38,%d)" % f.dataType.scale).alias(f.name)
                if f.dataType.simpleString().startswith("decimal") and f.name in self.sums else F.col(sql_name(f.name)) for f in rows.schema.fields]
        return rows.select(*wide)

    def save(self, left: DataFrame, right: DataFrame, path: str) -> None:
        self.computed(left, right).write.partitionBy(self.partition).parquet(path)

    def delta(self, left: DataFrame, right: DataFrame, left_change: DataFrame | None, right_change: DataFrame | None) -> DataFrame:
        """Change of each group: dL with R, L with dR, dL with dR. ``left`` and ``right`` are the tables before the change; of them only rows with a key
        that the other side's change holds are joined."""
        one = F.lit(1).cast("bigint")
        parts = []
        if left_change is not None:
            parts.append(self._join(left_change, self._touched(right, self.on.values(), left_change, self.on.keys()).withColumn(WEIGHT, one)))
        if right_change is not None:
            parts.append(self._join(self._touched(left, self.on.keys(), right_change, self.on.values()).withColumn(WEIGHT, one), right_change))
        if left_change is not None and right_change is not None:
            parts.append(self._join(left_change, right_change))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        out = self._kept(self._aggregate(rows))
        moved = " OR ".join([f"{sql_name(self.count)} <> 0", *[f"{sql_name(s)} <> 0" for s in self.sums]])
        return out.filter(moved)

    @staticmethod
    def _touched(df: DataFrame, own: Sequence[str], change: DataFrame, other: Sequence[str]) -> DataFrame:
        """Rows that a change meets. The changed keys are stored first, so their size decides how they are joined."""
        keys = storage.settle(change.select(*[quoted(o).alias(f"_k{i}") for i, o in enumerate(other)]).distinct(), "changed_keys")
        return df.join(keys, F.expr(" AND ".join(f"{sql_name(c)} = _k{i}" for i, c in enumerate(own))), "left_semi")

    def update(self, spark: SparkSession, path: str, left: DataFrame, right: DataFrame, left_change: DataFrame | None = None,
               right_change: DataFrame | None = None) -> list:
        """Merge a change into the saved view and return the partitions that were written, in order; no others are read or written.

        New rows of the partitions are stored first and then take the places of the old ones, partition by partition. A run that ends
        between two of them leaves old and new partitions side by side, each whole; it must not be run again with the same change, unless
        the view is saved anew (:meth:`save`)."""
        delta = storage.settle(self.delta(left, right, left_change, right_change), "view_delta")
        touched = [r[0] for r in delta.select(quoted(self.partition)).distinct().collect()]  # partitions of the view
        if not touched:
            return []
        saved = spark.read.schema(delta.schema).parquet(path)
        kind = delta.schema[self.partition].dataType
        have = storage.settle(spark.createDataFrame([(t,) for t in touched], f"_p {kind.simpleString()}"), "touched", 1)
        old = saved.filter(F.coalesce(quoted(self.partition).isin([t for t in touched if t is not None]), F.lit(None in touched))) \
            if None not in touched else saved.join(have, F.expr(f"{sql_name(self.partition)} <=> _p"), "left_semi")
        names = [sql_name(g) for g in self.group]
        merged = old.unionByName(delta).groupBy(*names).agg(
            F.sum(quoted(self.count)).alias(self.count), *[F.sum(quoted(s)).cast(delta.schema[s].dataType).alias(s) for s in self.sums])
        fresh = storage.settle(merged.filter(f"{sql_name(self.count)} <> 0").select(*delta.columns), f"view_{uuid.uuid4().hex[:6]}")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(path)
        left_over = fresh.select(quoted(self.partition)).distinct()
        for r in have.join(left_over, F.expr(f"_p <=> {sql_name(self.partition)}"), "left_anti").collect():  # all of its groups are gone
            storage.remove(spark, f"{path}/{storage.partition_directory(spark, self.partition, r[0])}")
        return sorted(touched, key=lambda t: (t is not None, t))
