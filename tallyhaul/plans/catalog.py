"""Catalogs as DataFrames: one row per table with its columns, keys, partitions and measured rows.

A catalog has the columns

    table_name string, row_count bigint, byte_count bigint, has_geometry boolean,
    partition_key string, children array<string>, primary_key array<string>,
    columns array<struct<name, type, not_null, identity, default_value>>,
    indexes array<string>, foreign_keys array<string>

and comes either from tables that Spark measures (:func:`measured_catalog`), or
from flat catalog relations read over JDBC or files (:func:`from_relations`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import PySparkException

from ..functions.canonical import sql_name, sql_text
from ..operators.integrity import check_pk
from ..session import side_by_side
from ..sources.storage import settle
from ..sources.tables import JdbcTable, read_table


@dataclass(frozen=True)
class TableSpec:
    """A table and what is declared about it; files carry none of this themselves."""

    name: str
    df: DataFrame
    primary_key: tuple[str, ...] = ()
    partition_key: str | None = None
    children: tuple[str, ...] = ()
    foreign_keys: tuple[str, ...] = ()
    indexes: tuple[str, ...] = ()
    identity: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    geometry: bool = False
    byte_count: int | None = None
    measured: bool = True  # else declarations alone count and no row is read
    not_null: tuple[str, ...] = ()

    def but(self, **changes) -> "TableSpec":
        return replace(self, **changes)


def _texts(values: Sequence[str]) -> str:
    return f"cast(array({', '.join(sql_text(v) for v in values)}) AS array<string>)"


def _or_null(value: str | None) -> str:
    return "cast(NULL AS string)" if value is None else sql_text(value)


def measured_table(spec: TableSpec, check_keys: bool = True) -> DataFrame:
    """One catalog row. Of a table that is not ``measured`` the declared columns, NOT NULLs and keys count, and
    its row count is unknown; that reads no row. Of others a column counts as NOT NULL when it holds none, and a declared primary key
    counts only if the rows bear it out; that shuffles the keys, so ``check_keys`` can leave it out."""
    fields = spec.df.schema.fields
    if spec.measured:
        measured = spec.df.agg(F.expr("count(*) AS row_count"),
                               *[F.expr(f"count({sql_name(f.name)}) AS v{i}") for i, f in enumerate(fields)])
    else:
        measured = spec.df.sparkSession.range(1).selectExpr("cast(NULL AS bigint) AS row_count")

    def filled(i: int, f) -> str:
        return f"v{i} = row_count" if spec.measured else str(f.name in spec.not_null or not f.nullable).lower()

    columns = ", ".join(
        f"named_struct('name', {sql_text(f.name)}, 'type', {sql_text(f.dataType.simpleString())}, "
        f"'not_null', {filled(i, f)}, 'identity', {sql_text(spec.identity.get(f.name, ''))}, "
        f"'default_value', {_or_null(spec.defaults.get(f.name))})" for i, f in enumerate(fields))
    broken = F.lit(0)
    if spec.primary_key and check_keys and spec.measured:
        broken = check_pk(spec.df, spec.primary_key).agg(F.expr("count(*) AS n")).scalar()
    geometry = spec.geometry or any(f.metadata.get("geometry") for f in fields)
    size = "NULL" if spec.byte_count is None else str(spec.byte_count)
    return measured.withColumn("broken", broken).selectExpr(
        f"{sql_text(spec.name)} AS table_name", "row_count", f"cast({size} AS bigint) AS byte_count",
        f"{str(bool(geometry)).lower()} AS has_geometry", f"{_or_null(spec.partition_key)} AS partition_key",
        f"{_texts(spec.children)} AS children",
        f"if(broken = 0, {_texts(spec.primary_key)}, {_texts(())}) AS primary_key", f"array({columns}) AS columns",
        f"{_texts(sorted(spec.indexes))} AS indexes", f"{_texts(sorted(spec.foreign_keys))} AS foreign_keys")


def measured_catalog(specs: Sequence[TableSpec], check_keys: bool = True) -> DataFrame:
    return reduce(DataFrame.unionAll, side_by_side(lambda s: measured_table(s, check_keys), specs))


def catalog_snapshot(specs: Sequence[TableSpec], check_keys: bool = True) -> DataFrame:
    """The measured catalog, kept as a table: one row per source table, each table scanned once.

    Reports join and filter a catalog several times over. On a stored one that
    costs nothing, while the optimizer would push such joins into every table's
    branch and repeat the scans below them.
    """
    return settle(measured_catalog(specs, check_keys), "catalog", files=1)


def open_tables(spark: SparkSession, refs: dict[str, str | JdbcTable]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables that can be read, and the errors of those that cannot; one bad table stops no report."""
    def open_one(ref: str | JdbcTable) -> DataFrame | str:
        try:
            df = read_table(spark, ref)
            df.schema  # asked for now, so that a table that cannot be read says so here
            return df
        except PySparkException as e:
            return str(e).splitlines()[0]

    found = dict(zip(refs, side_by_side(open_one, refs.values())))
    return ({n: f for n, f in found.items() if not isinstance(f, str)},
            {n: f for n, f in found.items() if isinstance(f, str)})


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """``(table_name, position, column_name, type, not_null, row_count)``."""
    exploded = catalog.select("table_name", "row_count", F.posexplode("columns").alias("p", "c"))
    return exploded.select("table_name", (F.col("p") + 1).alias("position"), F.col("c.name").alias("column_name"),
                           F.col("c.type").alias("type"), F.col("c.not_null").alias("not_null"), "row_count")


def root_tables(catalog: DataFrame) -> DataFrame:
    """Without the tables that are another table's partitions."""
    children = catalog.select(F.explode("children").alias("table_name"))
    return catalog.join(children, "table_name", "left_anti")


# Helper tables of a spatial extension that are never copied.
SYSTEM_TABLES = ("spatial_ref_sys", "geometry_columns", "geography_columns", "raster_columns", "raster_overviews")


def user_schema(schema: Column) -> Column:
    return ~schema.rlike("^pg_") & (schema != "information_schema")


def scope_tables(tables: DataFrame, include_schemas: Sequence[str] = (), exclude_schemas: Sequence[str] = (),
                 exclude_tables: Sequence[str] = (), exclude_suffixes: Sequence[str] = (),
                 include_tables: Sequence[str] = (), system_tables: Sequence[str] = SYSTEM_TABLES) -> DataFrame:
    """Rows of ``(schema, table, …)`` in scope. No include list means every user schema; exclusion wins."""
    schema, table = F.col("schema"), F.col("table")
    keep = schema.isin(list(include_schemas)) if include_schemas else user_schema(schema)
    if exclude_schemas:
        keep = keep & ~schema.isin(list(exclude_schemas))
    if include_tables:  # plain names, or with their schema
        keep = keep & (table.isin(list(include_tables)) | table_key(schema, table).isin(list(include_tables)))
    if exclude_tables or system_tables:
        keep = keep & ~table.isin([*exclude_tables, *system_tables])
    for suffix in exclude_suffixes:
        keep = keep & ~table.endswith(suffix)
    return tables.filter(keep)


def table_key(schema: Column, table: Column) -> Column:
    return F.concat_ws(".", schema, table)


def from_relations(tables: DataFrame, columns: DataFrame, keys: DataFrame | None = None,
                   parts: DataFrame | None = None, indexes: DataFrame | None = None,
                   foreign_keys: DataFrame | None = None) -> DataFrame:
    """A catalog from flat relations:

    tables (schema, table, estimated_rows, estimated_bytes, has_geometry, partition_key),
    columns (schema, table, pos, name, type_sql, not_null, attidentity, default_sql),
    keys (schema, table, pos, column), parts (schema, table, child_schema, child_table),
    indexes (schema, table, index_definition), foreign_keys (schema, table, definition).
    """
    key = table_key(F.col("schema"), F.col("table")).alias("table_name")
    out = tables.select(key, F.col("estimated_rows").cast("bigint").alias("row_count"),
                        F.col("estimated_bytes").cast("bigint").alias("byte_count"),
                        F.coalesce("has_geometry", F.lit(False)).alias("has_geometry"), "partition_key")

    def gather(df: DataFrame | None, item: Column, name: str, kind: str, by_position: bool) -> DataFrame:
        if df is None:
            return out.withColumn(name, F.array().cast(kind))
        value = F.struct(F.col("pos"), item.alias("v")) if by_position else item
        lists = F.array_sort(F.collect_list(value))
        if by_position:
            lists = F.transform(lists, lambda s: s.getField("v"))
        grouped = df.groupBy(key).agg(lists.alias(name))
        return out.join(grouped, "table_name", "left").withColumn(
            name, F.coalesce(F.col(name), F.array().cast(kind)))

    column = F.struct(F.col("name"), F.col("type_sql").alias("type"), F.col("not_null"),
                      F.coalesce("attidentity", F.lit("")).alias("identity"),
                      F.trim(F.col("default_sql")).alias("default_value"))
    shape = "array<struct<name:string,type:string,not_null:boolean,identity:string,default_value:string>>"
    child = table_key(F.col("child_schema"), F.col("child_table"))
    out = gather(parts, child, "children", "array<string>", False)
    out = gather(keys, F.col("column"), "primary_key", "array<string>", True)
    out = gather(columns, column, "columns", shape, True)
    out = gather(indexes, F.trim(F.col("index_definition")), "indexes", "array<string>", False)
    return gather(foreign_keys, F.trim(F.col("definition")), "foreign_keys", "array<string>", False)


# Catalog relations of a PostgreSQL database, each read as one JDBC subquery. The
# functions in them (format_type, pg_get_…) exist only there.
_NAMED = "FROM pg_class t JOIN pg_namespace s ON s.oid = t.relnamespace"
_USER = "s.nspname !~ '^pg_' AND s.nspname <> 'information_schema'"
CATALOG_SUBQUERIES = {
    "tables": f"""SELECT s.nspname AS "schema", t.relname AS "table", t.reltuples::bigint AS estimated_rows,
        pg_total_relation_size(t.oid) AS estimated_bytes, pg_get_partkeydef(t.oid) AS partition_key,
        EXISTS (SELECT 1 FROM pg_attribute a JOIN pg_type y ON y.oid = a.atttypid
                WHERE a.attrelid = t.oid AND y.typname IN ('geometry', 'geography')) AS has_geometry
        {_NAMED} WHERE t.relkind IN ('r', 'p') AND {_USER}""",
    "columns": f"""SELECT s.nspname AS "schema", t.relname AS "table", a.attnum::int AS pos, a.attname AS name,
        format_type(a.atttypid, a.atttypmod) AS type_sql, a.attnotnull AS not_null,
        a.attidentity::text AS attidentity, pg_get_expr(d.adbin, d.adrelid) AS default_sql
        {_NAMED} JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum > 0 AND NOT a.attisdropped
        LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum
        WHERE t.relkind IN ('r', 'p') AND {_USER}""",
    "keys": f"""SELECT s.nspname AS "schema", t.relname AS "table", k.pos::int AS pos, a.attname AS "column"
        {_NAMED} JOIN pg_constraint c ON c.conrelid = t.oid AND c.contype = 'p'
        CROSS JOIN LATERAL unnest(c.conkey) WITH ORDINALITY AS k(attnum, pos)
        JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.attnum WHERE {_USER}""",
    "parts": f"""SELECT s.nspname AS "schema", t.relname AS "table", cs.nspname AS child_schema,
        ct.relname AS child_table, pg_get_expr(ct.relpartbound, ct.oid) AS bound
        {_NAMED} JOIN pg_inherits i ON i.inhparent = t.oid JOIN pg_class ct ON ct.oid = i.inhrelid
        JOIN pg_namespace cs ON cs.oid = ct.relnamespace WHERE t.relkind = 'p' AND {_USER}""",
    "indexes": f"""SELECT s.nspname AS "schema", t.relname AS "table", pg_get_indexdef(x.indexrelid) AS index_definition
        {_NAMED} JOIN pg_index x ON x.indrelid = t.oid
        WHERE t.relkind IN ('r', 'p') AND {_USER}
          AND NOT EXISTS (SELECT 1 FROM pg_constraint c WHERE c.conindid = x.indexrelid)""",
    "foreign_keys": f"""SELECT s.nspname AS "schema", t.relname AS "table", c.conname AS name,
        pg_get_constraintdef(c.oid) AS definition
        {_NAMED} JOIN pg_constraint c ON c.conrelid = t.oid AND c.contype = 'f' WHERE {_USER}""",
    "views": f"""SELECT s.nspname AS "schema", t.relname AS name, pg_get_viewdef(t.oid) AS definition
        {_NAMED} WHERE t.relkind = 'm' AND {_USER}""",
    "functions": f"""SELECT s.nspname AS "schema", p.proname AS name, pg_get_functiondef(p.oid) AS definition
        FROM pg_proc p JOIN pg_namespace s ON s.oid = p.pronamespace
        LEFT JOIN pg_depend d ON d.classid = 'pg_proc'::regclass AND d.objid = p.oid AND d.deptype = 'e'
        WHERE p.prokind = 'f' AND d.objid IS NULL AND {_USER}""",
}


def catalog_relations(spark: SparkSession, url: str, properties: dict[str, str]) -> dict[str, DataFrame]:
    """The flat relations of a live database, one small JDBC read each, lazily."""
    return {name: read_table(spark, JdbcTable(url, f"({sql}) {name}", properties))
            for name, sql in CATALOG_SUBQUERIES.items()}
