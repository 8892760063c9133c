"""Row-level, bag, chunk and column comparison of two tables.

Every comparison tags both sides with a sign, unions them and aggregates once:
equal content nets to zero. That needs one exchange of short rows, combines
before it shuffles, and keeps a hot or duplicated key at one row per map task,
where a full outer join would move whole rows and multiply duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import hash_pieces, quoted, row_hash, sql_name, sql_text, value_text
from ..sources.storage import settle

_NET = ("_d0", "_d1", "_d2")
NET_AGGREGATES = ("count_if(_side > 0) AS source_rows", "count_if(_side < 0) AS target_rows",
                  *[f"sum({p} * _side) AS {d}" for p, d in zip(hash_pieces("_h"), _NET)])
DIFFERS = "(source_rows <> target_rows OR " + " OR ".join(f"coalesce({d}, 0) <> 0" for d in _NET) + ")"


def same_columns(source: DataFrame, target: DataFrame) -> None:
    """Typed rows are hashed, so names, order and types must agree before values can."""
    s, t = [[(f.name, f.dataType.simpleString()) for f in df.schema.fields] for df in (source, target)]
    if s != t:
        raise ValueError(f"columns differ, conform first: {[x for x in s if x not in t]} / {[x for x in t if x not in s]}"
                         if set(s) != set(t) else f"column order differs, conform first: {s} / {t}")


def both_signed(source: DataFrame, target: DataFrame, keep: Sequence[Column] = (),
                json_columns: Sequence[str] = ()) -> DataFrame:
    """Rows of both sides as ``(keep…, _side, _h)``: side 1 or -1 and row hash."""
    same_columns(source, target)
    hashed = row_hash(source, json_columns=json_columns).alias("_h")
    return source.select(*keep, F.expr("1 AS _side"), hashed).unionAll(
        target.select(*keep, F.expr("-1 AS _side"), hashed))


def compare_by(source: DataFrame, target: DataFrame, by: dict[str, Column],
               json_columns: Sequence[str] = ()) -> DataFrame:
    """``(by…, source_rows, target_rows, differs)`` per group. In ``json_columns`` key order and spacing do not count."""
    names = [sql_name(n) for n in by]
    both = both_signed(source, target, [c.alias(n) for n, c in by.items()], json_columns)
    grouped = both.groupBy(*names).agg(*[F.expr(a) for a in NET_AGGREGATES])
    return grouped.selectExpr(*names, "source_rows", "target_rows", f"{DIFFERS} AS differs")


def chunk_diff(source: DataFrame, target: DataFrame, chunk: Column, name: str = "chunk",
               json_columns: Sequence[str] = ()) -> DataFrame:
    """Chunks whose content differs. Two scans and a shuffle of one row per chunk and task."""
    return compare_by(source, target, {name: chunk}, json_columns).filter("differs").drop("differs")


def diff_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], chunk: Column | None = None,
              json_columns: Sequence[str] = ()) -> DataFrame:
    """``(keys…, status, source_rows, target_rows)`` for every key that is not the same on both sides.

    With ``chunk`` only the chunks with unequal fingerprints are compared row by
    row, which pays off when the two tables are nearly equal.
    """
    same_columns(source, target)
    if chunk is not None:
        bad = settle(chunk_diff(source, target, chunk, "_chunk", json_columns).select("_chunk"), "chunks").alias("b")
        # keys, chunk and hash only; whole rows do not move
        both = both_signed(source, target, [*[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)], chunk.alias("_chunk")],
                           json_columns).alias("t").join(bad, F.expr("t._chunk <=> b._chunk"), "left_semi")
        grouped = both.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]).agg(*[F.expr(a) for a in NET_AGGREGATES])
        found = grouped.selectExpr(*[sql_name(k) for k in keys], "source_rows", "target_rows", f"{DIFFERS} AS differs").filter("differs")
    else:
        found = compare_by(source, target, {k: quoted(k) for k in keys}, json_columns).filter("differs")
    return found.selectExpr(
        *[sql_name(k) for k in keys],
        "CASE WHEN target_rows = 0 THEN 'missing_in_target' WHEN source_rows = 0 THEN 'missing_in_source' "
        "ELSE 'changed' END AS status", "source_rows", "target_rows")


def diff_values(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, column_name, source_value, target_value)`` of the changed values of changed keys.

    Only keys found once per side have one old and one new value to show; keys
    that repeat are reported by :func:`diff_rows` with their counts.
    """
    names = [sql_name(k) for k in keys]
    changed = settle(diff_rows(source, target, keys).filter(
        "status = 'changed' AND source_rows = 1 AND target_rows = 1").select(*names), "changed").alias("c")
    on = F.expr(" AND ".join(f"d.{n} <=> c.{n}" for n in names))
    rest = [f for f in source.schema.fields if f.name not in set(keys)]
    texts = ", ".join(f"{sql_text(f.name)}, {value_text('d.' + sql_name(f.name), f.dataType)}" for f in rest)
    sides = [df.alias("d").join(changed, on, "left_semi").selectExpr(
        *names, f"'{side}' AS _side", f"named_struct({texts}) AS _v") for df, side in ((source, "s"), (target, "t"))]
    pairs = sides[0].unionAll(sides[1]).groupBy(*names).agg(
        F.expr("max(if(_side = 's', _v, NULL)) AS _s"), F.expr("max(if(_side = 't', _v, NULL)) AS _t"))
    cells = ", ".join(f"named_struct('column_name', {sql_text(f.name)}, 'source_value', _s.{sql_name(f.name)}, "
                      f"'target_value', _t.{sql_name(f.name)})" for f in rest)
    return (pairs.selectExpr(*names, f"inline(array({cells}))")
            .filter("NOT source_value <=> target_value"))


def bag_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of a table without a key that occur more often on one side: all columns, side, row_count.

    Grouped by whole values, so it is exact; copies of a row combine before the shuffle.
    """
    same_columns(source, target)
    names = [sql_name(n) for n in source.columns]
    both = source.selectExpr(*names, "1 AS _side").unionAll(target.selectExpr(*names, "-1 AS _side"))
    net = both.groupBy(*names).agg(F.expr("sum(_side) AS _net")).filter("_net <> 0")
    return net.selectExpr(*names, "if(_net > 0, 'source_only', 'target_only') AS side", "abs(_net) AS row_count")


def bag_diff_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(side, row_count)`` of the bag difference, found from row hashes so only they are shuffled."""
    same_columns(source, target)
    sides = [df.select(row_hash(df).alias("_h"), F.expr(f"{sign} AS _side")) for df, sign in ((source, 1), (target, -1))]
    net = sides[0].unionAll(sides[1]).groupBy("_h").agg(F.expr("sum(_side) AS _net")).filter("_net <> 0")
    return (net.selectExpr("if(_net > 0, 'source_only', 'target_only') AS side", "abs(_net) AS n")
            .groupBy("side").agg(F.expr("sum(n) AS row_count")))


def column_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(column_name, source_rows, target_rows, same)``: which columns hold other values, in one pass per side."""
    same_columns(source, target)
    count = range(len(source.columns))

    def side(df: DataFrame, sign: int) -> DataFrame:
        hashed = df.select(*[row_hash(df, [n]).alias(f"_h{i}") for i, n in enumerate(df.columns)])
        return hashed.selectExpr(f"{sign} AS _side", *[
            f"{p} * {sign} AS _c{i}_{j}" for i in count for j, p in enumerate(hash_pieces(f"_h{i}"))])

    totals = side(source, 1).unionAll(side(target, -1)).agg(
        *[F.expr(a) for a in NET_AGGREGATES[:2]],
        *[F.expr(f"coalesce(sum(_c{i}_{j}), 0) AS _c{i}_{j}") for i in count for j in range(len(_NET))])
    lines = ", ".join(
        f"named_struct('column_name', {sql_text(n)}, 'source_rows', source_rows, 'target_rows', target_rows, 'same', "
        "source_rows = target_rows AND " + " AND ".join(f"_c{i}_{j} = 0" for j in range(len(_NET))) + ")"
        for i, n in enumerate(source.columns))
    return totals.selectExpr(f"inline(array({lines}))")
