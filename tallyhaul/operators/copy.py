"""Copy operators: full, append, chunked, by partition, insert-if-absent."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.canonical import fingerprint, hash_pieces, join_pieces, quoted, row_hash, sql_name, sql_text
from ..sources import storage
from ..sources.storage import settle
from ..sources.csvfiles import csv_bytes
from .compare import chunk_diff
from .integrity import any_null, dedupe


class CopyMismatch(RuntimeError):
    """What was written is not what was read; the target was left as it was."""


def _cast(field: T.StructField, have: T.DataType, allow_loss: bool) -> str:
    name, want = sql_name(field.name), field.dataType.simpleString()
    test = None if allow_loss or have == field.dataType else _lossless(name, have, field.dataType)
    if test is None:
        return f"cast({name} AS {want}) AS {name}"
    message = sql_text(f"column {field.name}: a value does not fit {want} without loss")
    return f"if({test}, cast({name} AS {want}), cast(raise_error({message}) AS {want})) AS {name}"


def _lossless(name: str, have: T.DataType, want: T.DataType) -> str | None:
    """SQL test that a cast keeps the value; None where it always does."""
    there = f"cast({name} AS {want.simpleString()})"
    numbers = isinstance(have, T.NumericType) and isinstance(want, T.NumericType)
    times = isinstance(have, (T.TimestampType, T.TimestampNTZType)) and isinstance(want, T.DateType)
    if numbers or times:
        return f"cast({there} AS {have.simpleString()}) <=> {name}"
    if isinstance(have, T.StringType) and isinstance(want, (T.DecimalType, T.IntegralType)):
        # the text as a number of the widest kind with as many digits after the point as fit
        wide = f"cast({name} AS decimal(38,{want.scale + 10 if isinstance(want, T.DecimalType) and want.scale <= 18 else 10}))"
        return f"{name} IS NULL OR {wide} = {there}"
    if isinstance(have, T.StringType) and isinstance(want, T.DateType):
        return f"{name} IS NULL OR cast({name} AS timestamp_ntz) = cast({there} AS timestamp_ntz)"
    return None


def conform(df: DataFrame, schema: T.StructType, allow_drop: bool = False, allow_loss: bool = False) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing nullable ones become NULL.

    Columns the target does not have are refused unless ``allow_drop``. Casts are
    checked row by row: text that does not parse, numbers or numeric text that would lose
    digits, and timestamps that would lose their time fail the job.
    """
    extra = [c for c in df.columns if c not in set(schema.names)]
    if extra and not allow_drop:
        raise ValueError(f"target has no column for {extra}")
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have and not f.nullable]
    if missing:
        raise ValueError(f"no value for required columns {missing}")
    cast = df.selectExpr(*[_cast(f, have[f.name], allow_loss) for f in schema.fields if f.name in have])
    return cast.to(T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields]))


def ensure_target(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Create an empty table of this schema unless one is there; says whether it was created."""
    if storage.exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql("CREATE SCHEMA IF NOT EXISTS `" + name.replace("`", "``") + "`")


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Count and fingerprint taken in the copy pass itself, so a changing source cannot slip between.

    The observation sits right below the write, in its result stage: a retried
    task there is counted once.
    """
    seen = Observation(f"copy_{uuid.uuid4().hex}")
    # one struct per piece would hash the row three times; the observed rows carry the hash along instead
    hashed = df.withColumn("_h", row_hash(df))
    sums = [F.expr(f"coalesce(sum({p}), 0) AS p{i}") for i, p in enumerate(hash_pieces("_h"))]
    return hashed.observe(seen, F.expr("count(*) AS row_count"), *sums).drop("_h"), seen


def _check(landed: DataFrame, name: str, seen: Observation) -> int:
    want = seen.get
    total = F.expr(join_pieces([f"{want[f'p{i}']}L" for i in range(3)]))
    got = fingerprint(landed).select("row_count", (F.col("fingerprint") == total).alias("same")).first()
    if got["row_count"] != want["row_count"] or not got["same"]:
        raise CopyMismatch(f"{name}: wrote {want['row_count']} rows, read back {got['row_count']}, "
                           f"same content: {got['same']}")
    return want["row_count"]


def copy_full(source: DataFrame, path: str, allow_destructive: bool = False) -> int:
    """Replace the table at ``path``: write beside it, verify, swap. Returns the row count.

    A table with rows in it is only replaced when ``allow_destructive`` is set;
    the guard comes before any write. No shuffle: every task writes what it read.
    """
    spark = source.sparkSession
    if storage.exists(spark, path) and not allow_destructive:
        raise PermissionError(f"{path} exists; pass allow_destructive=True to replace it")
    staged = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    try:
        out, seen = _observed(source)
        out.write.parquet(staged)
        rows = _check(spark.read.schema(source.schema).parquet(staged), path, seen)
        storage.swap_in(spark, staged, path.rstrip("/"))
    finally:
        if storage.exists(spark, staged):
            storage.remove(spark, staged)
    return rows


def copy_full_table(source: DataFrame, name: str, allow_destructive: bool = False) -> int:
    """:func:`copy_full` for a table of the session's catalog, swapped in by renames."""
    spark = source.sparkSession
    there = spark.catalog.tableExists(name)
    if there and not allow_destructive:
        raise PermissionError(f"{name} exists; pass allow_destructive=True to replace it")
    tag = uuid.uuid4().hex
    staged, retired = f"{name}__staging_{tag}", f"{name}__old_{tag}"
    try:
        out, seen = _observed(source)
        out.write.format("parquet").saveAsTable(staged)
        rows = _check(spark.table(staged), name, seen)
        if there:
            spark.sql(f"ALTER TABLE {name} RENAME TO {retired}")
        try:
            spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        except Exception:
            if there:
                spark.sql(f"ALTER TABLE {retired} RENAME TO {name}")
            raise
        spark.sql(f"DROP TABLE IF EXISTS {retired}")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
    return rows


def copy_append(source: DataFrame, path: str) -> None:
    """Add the rows; rows already there stay, so sending rows twice doubles them."""
    spark = source.sparkSession
    if storage.exists(spark, path):
        source = conform(source, spark.read.parquet(path).schema)
    source.write.mode("append").parquet(path)


def chunk_of(col: Column, low: int, high: int, chunks: int) -> Column:
    """Number of the equal-width range of ``[low, high]`` that holds ``col``. Keys outside go to the
    first or last range and NULL goes to the first, so no row is without a range."""
    kind = "bigint" if (high - low + 1) * chunks < 2**63 else "decimal(20,0)"

    def whole(n: int) -> Column:
        return F.expr(f"cast('{n}' AS {kind})")

    inside = F.greatest(F.least(col.cast(kind), whole(high)), whole(low))  # NULL becomes low
    part = F.call_function("div", (inside - whole(low)) * F.lit(chunks), whole(high - low + 1))
    return F.when(col.isNull(), 0).otherwise(part).cast("int")


def key_span(df: DataFrame, column: str) -> tuple[int, int]:
    row = df.agg(F.min(quoted(column)).alias("lo"), F.max(quoted(column)).alias("hi")).first()
    return (0, 0) if row["lo"] is None else (row["lo"], row["hi"])


def chunk_ranges(df: DataFrame, column: str, chunks: int) -> DataFrame:
    """``(chunk, row_count, min_key, max_key)`` of the planned ranges."""
    low, high = key_span(df, column)
    key = quoted(column)
    return (df.select(chunk_of(key, low, high, chunks).alias("chunk"), key.alias("_k")).groupBy("chunk")
            .agg(F.count(F.lit(1)).alias("row_count"), F.min("_k").alias("min_key"), F.max("_k").alias("max_key")))


def _write_parts(df: DataFrame, path: str, part: str, mode: str = "errorifexists") -> None:
    """Rows of a part go together, but a part holding much of the table is split over many
    tasks by the runtime re-plan, and small parts share one."""
    (df.hint("rebalance", quoted(part)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy(part).parquet(path))


def _among(part: str, values: Sequence) -> Column:
    """Rows of these parts; None is the part of NULL values."""
    test = F.coalesce(quoted(part).isin([v for v in values if v is not None]), F.lit(False))
    return test | quoted(part).isNull() if None in values else test


def _folder(spark: SparkSession, part: str, value) -> str:
    """Name of a part's directory, as Spark writes it."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return escape(part, text)


def _replace_parts(tagged: DataFrame, path: str, part: str, values: Sequence) -> None:
    """Make the given parts of the table at ``path`` equal to the source's, also those now empty.

    They are written and checked beside the table; only then each part takes the place of its old one."""
    spark, path = tagged.sparkSession, path.rstrip("/")
    chosen = tagged.filter(_among(part, values))
    staged = f"{path}__staging_{uuid.uuid4().hex}"
    try:
        _write_parts(chosen, staged, part)
        left = _open_parts(chosen, staged, part)
        if left:
            raise CopyMismatch(f"{staged}: parts {left} are not equal to the source after the copy")
        for value in values:
            name = _folder(spark, part, value)
            if storage.exists(spark, f"{staged}/{name}"):
                storage.swap_in(spark, f"{staged}/{name}", f"{path}/{name}")
            elif storage.exists(spark, f"{path}/{name}"):
                storage.remove(spark, f"{path}/{name}")
    finally:
        if storage.exists(spark, staged):
            storage.remove(spark, staged)


def _open_parts(tagged: DataFrame, path: str, part: str) -> list:
    """Parts whose content at ``path`` is not the source's: one short row per part that differs, NULL first."""
    landed = tagged.sparkSession.read.schema(tagged.schema).parquet(path).select(*tagged.columns)
    found = [r[0] for r in chunk_diff(tagged, landed, quoted(part), "_part").select("_part").collect()]
    return sorted(found, key=lambda v: (v is not None, v if v is not None else 0))


def _tag(source: DataFrame, name: str, expression: Column) -> DataFrame:
    """The source with its layout column, which must not take the place of one that it has."""
    if name.lower() in {c.lower() for c in source.columns}:
        raise ValueError(f"the source has a column {name!r}; give the layout column another name")
    return source.withColumn(name, expression)


def read_copied(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A chunked or partitioned copy as the table that was copied, without the layout column."""
    return spark.read.parquet(path).select(*[quoted(n) for n in schema.names]).to(schema)


def copy_chunked(source: DataFrame, path: str, column: str, chunks: int,
                 span: tuple[int, int] | None = None, name: str = "chunk") -> int:
    """Copy by key ranges under ``chunk=N`` directories (or another ``name``); returns how many ranges had to be copied.

    Run again after a failure or a change, it compares range fingerprints and
    copies only the ranges that are not equal yet. What a run writes is compared with
    the source again. Read the copy with :func:`read_copied`. Give the same ``span`` each time if the key range grows.
    """
    spark = source.sparkSession
    low, high = span or key_span(source, column)
    tagged = _tag(source, name, chunk_of(quoted(column), low, high, chunks))
    if storage.exists(spark, path):
        todo = _open_parts(tagged, path, name)
        if not todo:
            return 0
        _replace_parts(tagged, path, name, todo)
        return len(todo)  # checked before they took their places
    _write_parts(tagged, path, name)
    left = _open_parts(tagged, path, name)
    if left:
        raise CopyMismatch(f"{path}: ranges {left} are not equal to the source after the copy")
    return chunks


def copy_partition_wise(source: DataFrame, path: str, part: str, expression: Column,
                        only: Sequence | None = None, allow_destructive: bool = False) -> None:
    """Copy the children of a partitioned table into ``part=value`` directories.

    With ``only``, just those children are replaced (None is the child of NULL values); without it, the whole table
    is. Both are staged, checked and swapped in. Replacing anything needs ``allow_destructive``.
    Read the copy with :func:`read_copied`.
    """
    spark = source.sparkSession
    if storage.exists(spark, path) and not allow_destructive:
        raise PermissionError(f"{path} exists; pass allow_destructive=True to replace its partitions")
    tagged = _tag(source, part, expression)
    if only is not None:
        _replace_parts(tagged, path, part, list(only))
        return
    staged = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    try:
        _write_parts(tagged, staged, part)
        left = _open_parts(tagged, staged, part)
        if left:
            raise CopyMismatch(f"{staged}: partitions {left} are not equal to the source after the copy")
        storage.swap_in(spark, staged, path.rstrip("/"))
    finally:
        if storage.exists(spark, staged):
            storage.remove(spark, staged)


def missing_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``source`` that ``target`` lacks: only keys are shuffled, and repeats combine first."""
    names = [quoted(k) for k in keys]
    both = source.select(*names, F.lit(1).alias("_s"), F.lit(0).alias("_t")).unionAll(
        target.select(*names, F.lit(0).alias("_s"), F.lit(1).alias("_t")))
    return both.groupBy(*names).agg(F.max("_s").alias("_s"), F.max("_t").alias("_t")).filter(
        "_s = 1 AND _t = 0").select(*names)


def rows_to_insert(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One source row for every key the target lacks. A NULL in a key fails, as a primary key does."""
    needed = settle(missing_keys(source, target, keys), "missing")
    found = source.join(needed, list(keys), "left_semi").select(*[quoted(c) for c in source.columns])
    no_null = [F.when(quoted(k).isNull(), F.raise_error(F.lit(f"key column {k} is NULL"))).otherwise(quoted(k))
               .alias(k) if k in set(keys) else quoted(k) for k in source.columns]
    # the check must see the rows the join would leave out
    return dedupe(found, keys).unionAll(source.filter(any_null(keys)).select(*no_null))


def sync_missing(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after inserting what it lacks; rows it has are left as they are."""
    return target.unionByName(conform(rows_to_insert(source, target, keys), target.schema))


def insert_missing(source: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append to the table at ``path`` what it lacks; run again, it adds nothing."""
    target = source.sparkSession.read.parquet(path)
    copy_append(rows_to_insert(source, target, keys), path)


def copy_with_stats(source: DataFrame, path: str) -> DataFrame:
    """Copy and report ``(row_count, csv_bytes)``, both measured while the rows pass by."""
    seen = Observation(f"stats_{uuid.uuid4().hex}")
    source.observe(seen, F.count(F.lit(1)).alias("row_count"),
                   F.coalesce(F.sum(csv_bytes(source)), F.lit(0)).alias("csv_bytes")).write.parquet(path)
    got = seen.get
    return source.sparkSession.createDataFrame([(got["row_count"], got["csv_bytes"])],
                                               "row_count bigint, csv_bytes bigint")
