"""The checks a database makes when it loads rows and files do not: each returns the offenders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.canonical import quoted, sql_name, sql_text, value_text
from ..sources.storage import settle


def check_not_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, null_count)`` for every checked column, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.expr(f"count_if({sql_name(c)} IS NULL) AS n{i}") for i, c in enumerate(columns)])
    lines = ", ".join(f"named_struct('column_name', {sql_text(c)}, 'null_count', n{i})" for i, c in enumerate(columns))
    return counts.selectExpr(f"inline(array({lines}))")


def any_null(columns: Sequence[str]) -> str:
    return "(" + " OR ".join(f"{sql_name(c)} IS NULL" for c in columns) + ")"


def check_pk(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, n)`` for keys that repeat or hold a NULL. Repeats combine before the shuffle."""
    return (df.groupBy(*[sql_name(k) for k in keys]).agg(F.expr("count(*) AS n"))
            .filter(f"n > 1 OR {any_null(keys)}"))


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(columns…, n)`` for repeated values; a row with a NULL never clashes."""
    names = [quoted(c) for c in columns]
    return (df.filter(f"NOT {any_null(columns)}").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def fk_orphan_keys(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``(child columns…, n)`` for foreign keys without a parent. ``columns`` maps child to parent.

    The child is reduced to its distinct keys first, so a key that holds a third
    of the rows is one row per task in the shuffle. The parent is not broadcast
    by hand: the runtime re-plan does that when its measured size allows.
    """
    names = list(columns)
    used = (child.filter(f"NOT {any_null(names)}").groupBy(*[quoted(c) for c in names])
            .agg(F.count(F.lit(1)).alias("n")))
    have = parent.select(*[quoted(p).alias(c) for c, p in columns.items()])
    return used.join(have, names, "left_anti").select(*[quoted(c) for c in names], "n")


def fk_orphans(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The child rows without a parent; the orphan keys are found first, on keys alone."""
    orphans = settle(fk_orphan_keys(child, parent, columns).drop("n"), "orphans")
    return child.join(orphans, list(columns), "left_semi").select(
        *[quoted(c) for c in child.columns])


def fill_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the columns that are missing with their default; a NULL that was sent stays NULL."""
    have = set(df.columns)
    return df.withColumns({c: e for c, e in defaults.items() if c not in have})


def _unordered(kind: T.DataType) -> bool:
    """Maps and variants, also inside arrays and structs, have no order; their exact text has."""
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the least one by ``order`` and then by all other columns (NULL sorts first).
    Maps and variants count by their text.

    Written as an aggregate, not as a window: each task first reduces a hot key
    to its own best row, so no task has to sort a whole group.
    """
    first = list(order or [])
    rest = [c for c in df.columns if c not in set(keys) and c not in set(first)]
    if not first and not rest:
        return df.distinct()
    types = {f.name: f.dataType for f in df.schema.fields}
    row, texts = F.struct(*[quoted(c) for c in first + rest]), [c for c in first + rest if _unordered(types[c])]
    best = (F.min(row) if not texts else F.min_by(row, F.struct(*[
        F.expr(value_text(sql_name(c), types[c])).alias(f"o{i}") if c in texts else quoted(c).alias(f"o{i}")
        for i, c in enumerate(first + rest)]))).alias("_best")
    out = df.groupBy(*[quoted(k) for k in keys]).agg(best)
    return out.select(*[quoted(c) if c in set(keys) else F.col("_best").getField(c).alias(c) for c in df.columns])


def dedupe_few(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """:func:`dedupe` for a table in which few keys repeat, such as rows that were sent again.

    Keys are counted first, which shuffles keys only. Whole rows of the keys
    that do not repeat are passed on where they are: the stored list of repeated
    keys is broadcast if it is short enough, and joined by shuffle if it is not.
    """
    names = [sql_name(k) for k in keys]
    repeated = settle(df.groupBy(*names).agg(F.expr("count(*) AS n")).filter("n > 1").drop("n"), "repeated").alias("r")
    same = F.expr(" AND ".join(f"d.{n} <=> r.{n}" for n in names))
    once, more = [df.alias("d").join(repeated, same, how).select(*[f"d.{sql_name(c)}" for c in df.columns])
                  for how in ("left_anti", "left_semi")]
    return once.unionAll(dedupe(more, keys, order))
