"""Filters and joins in the form the catalog and copy jobs need them; Catalyst picks the join strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.canonical import quoted


def project(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*[quoted(c) for c in columns]) if columns else df.select("*")


def exclude_like(df: DataFrame, column: str, pattern: str, also: Sequence[str] = ()) -> DataFrame:
    """Rows whose value neither matches the pattern nor is one of ``also``; NULL is left out."""
    keep = ~quoted(column).rlike(pattern)
    return df.filter(keep & ~quoted(column).isin(list(also)) if also else keep)


def keep_listed(df: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(wanted, list(on), "left_semi").select(*[quoted(c) for c in df.columns])


def drop_listed(df: DataFrame, unwanted: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(unwanted, list(on), "left_anti").select(*[quoted(c) for c in df.columns])


def with_next(df: DataFrame, group: Sequence[str], position: str, value: str, name: str) -> DataFrame:
    """Self join: each row with ``value`` of the row one position further in its group, else NULL."""
    later = df.select(*[quoted(g) for g in group], (quoted(position) - 1).alias(position), quoted(value).alias(name))
    return df.join(later, [*group, position], "left")


def unnest_with_position(df: DataFrame, keep: Sequence[str], array: str, position: str, value: str) -> DataFrame:
    """One row per element, numbered from 0."""
    return df.select(*[quoted(c) for c in keep], F.posexplode(quoted(array)).alias(position, value))


def distinct_union(parts: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """Distinct values of several columns; each part is made distinct by the same aggregate as the whole."""
    first, *rest = [df.select(quoted(c).alias(name)) for df, c in parts]
    for r in rest:
        first = first.unionAll(r)
    return first.distinct()


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows by column name with a tag telling where each came from."""
    frames: list[DataFrame] = [df.withColumn(tag, F.lit(label)) for label, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


