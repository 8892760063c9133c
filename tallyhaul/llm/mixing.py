"""Mixing sources to target weights along a curriculum that changes with time.

Each source's weight is a schedule over training time 0..1 (straight lines
between knots). Its integral, scaled to the source's target, is the words the
mix has asked of the source up to a time. A source's documents stand in a fixed
pseudo-random order, pass after pass; the words before the middle of a copy are
the demand at which it is due, and the inverse of the integral turns that into
its position. Copies up to the target are taken; sorting by position gives the
training order.

Running sums over a source of any size come in two steps (sums of buckets,
then sums inside a bucket). Buckets are cut by hash, about the square root of
the row count in number, so no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import partitions, settle

Knots = Sequence[tuple[float, float]]
#: Sources in turn start strong, stay even, and come late.
SCHEDULES: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of characters that are not white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with rank and target.

    Sources by code point, null last, have the weights in turn and share all
    words by weight. A target stops at ``most`` times its source's size; what is over is
    shared by the others, by weight, until no target is above. In order of size to weight
    the first sources stop, up to the first whose bound is above what the words left give it; that
    one's level holds from there on, so one ordered pass over sources finds it. Without words all targets are 0.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn(
        "weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bound = F.lit(float(most)) * F.col("source_size")
    level = ranked.withColumn("bound", bound).withColumn(
        "level", (F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    first = F.min(F.when(F.col("bound") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(every)
    return level.withColumn("place", F.row_number().over(order)).withColumn("first", first).select(
        "source", "source_size", "rank", F.when(F.col("place") >= F.col("first.place"), F.col("first.level") * F.col("weight"))
        .otherwise(F.col("bound")).alias("target"))


def due_time(share: Column, rank: Column, schedules: Sequence[Knots] = SCHEDULES) -> Column:
    """Time at which the integral of the rank's schedule reaches ``share`` of its whole."""
    out = F.lit(None).cast("double")
    for k, knots in reversed(list(enumerate(schedules))):
        pieces = [(t0, w0, t1 - t0, w1 - w0, (t1 - t0) * (w0 + w1) / 2)
                  for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:])]
        whole = sum(p[-1] for p in pieces)
        expr, done = F.lit(float(knots[-1][0])), whole
        for t0, w0, dt, dw, area in reversed(pieces):
            done -= area
            y = F.greatest(share * whole - done, F.lit(0.0))
            # w0 * x + dw / (2 dt) * x * x = y, in the form without cancellation
            x = 2 * y / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * (dw / dt) * y, F.lit(0.0))))
            expr = F.when(share * whole <= done + area, t0 + F.when(y > 0, x).otherwise(0.0)).otherwise(expr)
        out = F.when(rank % len(schedules) == k, expr).otherwise(out)
    return out


def plan(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken, rank, before.

    ``copies`` whole copies are taken, ``taken`` = copies x size words. A copy is taken if
    its middle lies before the target, so a source misses its target by half a document at most.
    Documents without words get no copy. The order in a source is md5 of the id, then the id,
    then the size; rows that repeat id, source and size are alike, and get the same copies as if in turn.
    Null sources are one source. Other columns are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    base = settle(base.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))), "mix_sizes")
    rows = base.count()
    buckets = 1 << max(6, (max(rows, 1).bit_length() + 1) // 2)
    width = 16 ** 6 // buckets if buckets < 16 ** 6 else 1
    base = base.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("long") / width))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = settle(sums, "mix_buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    starts = sums.select("source", "bucket", (F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col(
        "words")).alias("bucket_start"))
    starts = settle(starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select(
        "s.*", "source_size", "rank", "target"), "mix_starts")
    inside = W.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = base.withColumn("upto", F.sum("size").over(inside))
    found = placed.alias("p").join(starts.alias("s"), F.expr("p.bucket = s.bucket AND p.source <=> s.source")).select(
        "id", "p.source", "size", "source_size", "target", "rank", (F.col("bucket_start") + F.col("upto") - F.col("size")).alias("before"))
    middle = F.col("before") + F.col("size") / 2
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.greatest(
        F.ceil((F.col("target") - middle) / F.col("source_size")), F.lit(0)), F.ceil(F.lit(float(most))))).cast("int")
    return found.withColumn("copies", copies).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), "rank", "before")


def _position(copy: Column, schedules: Sequence[Knots]) -> Column:
    due = copy * F.col("source_size") + F.col("before") + F.col("size") / 2
    return due_time(F.least(due / F.col("target"), F.lit(1.0)), F.col("rank"), schedules)


def positions(planned: DataFrame, schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """One row per copy of ``plan`` with ``copy`` (0, 1, ..) and ``position``, its training time in 0..1."""
    copies = planned.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copies.withColumn("position", _position(F.col("copy"), schedules))


def scheduled(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0, schedules: Sequence[Knots] = SCHEDULES,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``plan`` in training order, with ``positions``: those of all their copies, in turn.

    ``copies`` and ``taken`` are counted over positions. Rows without a copy come last, their positions null. Sorted over
    ranges of the first position, so part files follow each other in training order; id, source and words before settle ties.
    """
    planned = plan(docs, weights, most, id_col, text_col, source_col)
    due = planned.withColumn("positions", F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1), lambda copy: _position(copy, schedules))))
    due = due.withColumn("copies", F.when(F.col("positions").isNull(), 0).otherwise(F.size("positions")))
    due = due.withColumn("taken", F.col("size") * F.col("copies"))
    keys = [F.element_at("positions", 1).asc_nulls_last(), id_col, source_col, "before"]
    return due.repartitionByRange(max(partitions(docs.sparkSession), 1), *keys).sortWithinPartitions(*keys)


def mixed(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0,
          schedules: Sequence[Knots] = SCHEDULES, id_col: str = "doc_id") -> DataFrame:
    """The documents of the mix in training order: the columns of ``docs``, a row per copy.

    Sorted over ranges of position, so part files follow each other in training order;
    ids and copy numbers settle ties. Where several rows have one id, each is taken as often as the most taken of them.
    """
    due = positions(plan(docs, weights, most, id_col), schedules).select(
        F.col(id_col).alias("__id"), F.col("copy").alias("__copy"), F.col("position").alias("__position"))
    due = settle(due.groupBy("__id", "__copy").agg(F.min("__position").alias("__position")), "mix_positions")
    n = max(partitions(docs.sparkSession), 1)
    out = docs.join(due, F.col(id_col).eqNullSafe(F.col("__id")))
    keys = ["__position", "__id", "__copy"]
    return out.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*[docs[c] for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0 AS weight FROM d GROUP BY source),
b AS (SELECT *, source_size / weight AS ratio, sum(source_size) OVER () AS every FROM s),
l AS (SELECT *, (every - 3.0 * coalesce(sum(source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM b),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, source) AS place FROM l),
f AS (SELECT *, min(CASE WHEN 3.0 * source_size > level * weight THEN place END) OVER () AS first FROM o),
t AS (SELECT source, source_size, CASE WHEN place >= first THEN weight * max(CASE WHEN place = first THEN level END) OVER ()
             ELSE 3.0 * source_size END AS target FROM f),
p AS (SELECT doc_id, size, source_size, target::DOUBLE AS target,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) - size / 2.0 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (CASE WHEN size = 0 THEN 0 ELSE size * least(greatest(ceil((target - middle) / source_size), 0), 3) END)::BIGINT AS taken
FROM p
"""
