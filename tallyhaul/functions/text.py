"""Names and small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quote_identifier(name: Column) -> Column:
    """SQL-standard quoting: ``a"b`` becomes ``"a""b"``."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def qualified_name(schema: Column, table: Column) -> Column:
    return F.concat(quote_identifier(schema), F.lit("."), quote_identifier(table))


def split_name(name: Column, default_schema: str = "public") -> tuple[Column, Column]:
    """Schema and table of ``schema.table``, cut at the first dot, quotes removed."""
    bare = F.replace(name, F.lit('"'), F.lit(""))
    parts = F.split(bare, r"\.", 2)
    dotted = F.size(parts) == 2
    return (F.when(dotted, F.element_at(parts, 1)).otherwise(F.lit(default_schema)),
            F.when(dotted, F.try_element_at(parts, F.lit(2))).otherwise(bare))


# Fixed value: how a column default names the sequence it draws from.
NEXTVAL_PATTERN = r"(?i)nextval\('([^']+)'\s*(?:::regclass)?\)"


def sequence_names(default_sql: Column) -> Column:
    """All sequences a default expression draws from."""
    return F.regexp_extract_all(default_sql, F.lit(NEXTVAL_PATTERN), F.lit(1))


def draws_from_sequence(default_sql: Column, identity: Column) -> Column:
    return default_sql.like("nextval(%") | (identity == "YES")
