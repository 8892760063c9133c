"""Row text, row hashes and order-free fingerprints.

Two kinds of row hash serve two needs:

* ``row_hash`` is ``xxhash64`` over the typed columns. It builds text for maps, variants and structs only, so
  it is the one used wherever Spark reads both sides.
* ``portable_hash`` is md5 over a canonical text of the row, so a fingerprint can be compared with one taken by
  another engine that has md5. Engines print doubles each in their own way (1.0E7, 1e+07): ``"md5"`` takes
  Spark's text of a double, ``"md5_portable"`` takes ``portable_double``, which every engine can write.

A fingerprint is the *sum* of the row hashes, so it needs no order and one small
aggregate, and equal rows add up instead of cancelling (as they would in xor).

Expressions over all columns of a table are written as SQL text: a wide table
then costs the driver one parsed expression and not hundreds of Column objects.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

_COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
# 64 hash bits are summed as 22 + 21 + 21 bits in three bigints: plain additions
# that stay clear of overflow up to 2^41 rows per group.
_PIECES = ((22, 0), (21, 22), (21, 43))


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    """Column by its exact name, also when it holds dots or spaces."""
    return F.col(sql_name(name))


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _nested_text(col: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.VariantType):
        return f"to_json({col})"
    if isinstance(dtype, T.MapType):
        col = f"array_sort(map_entries({col}))"
    return f"if({col} IS NULL, NULL, to_json(named_struct('v', {col}), map('ignoreNullFields', 'false')))"


def json_text(col: str) -> str:
    """JSON text with sorted keys and no spaces; text that is not JSON stays as it is."""
    return f"coalesce(to_json(try_parse_json({col})), {col})"


def value_text(col: str, dtype: T.DataType) -> str:
    """SQL for the exact text of one value; NULL stays NULL. Doubles keep every digit needed to read them back."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BinaryType):
        return f"hex({col})"
    if isinstance(dtype, T.TimestampType):
        # an instant, so the text must not depend on the session time zone
        return f"cast(unix_micros({col}) AS string)"
    if isinstance(dtype, _COMPLEX):
        return _nested_text(col, dtype)
    return f"cast({col} AS string)"


#: Doubles below this size that are whole in the fourth decimal are exact in 15 digits, and print as decimals.
FIXED_BELOW = 100_000_000_000


def portable_double(col: str) -> str:
    """SQL for a text of a float or double that does not depend on the engine's printing.

    With four decimals (``12.5000``) where that reads back as the same number, else exact in hex as C's ``%a`` without
    the plus sign (``0x1.8p40``). Both zeros are ``0.0000``; then there are ``NaN``, ``Infinity`` and ``-Infinity``.
    """
    x = f"cast({col} AS double)"
    fixed = f"cast(if(abs({x}) < {FIXED_BELOW}D, {x}, NULL) AS decimal(18,4))"
    exact = f"replace(format_string('%a', {x}), '.0p', 'p')"
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN isnan({x}) THEN 'NaN' "
            f"WHEN abs({x}) = double('Infinity') THEN if({x} > 0D, 'Infinity', '-Infinity') "
            f"WHEN cast({fixed} AS double) = {x} THEN cast({fixed} AS string) ELSE {exact} END")


def row_text_sql(df: DataFrame, columns: Sequence[str] | None = None, json_columns: Iterable[str] = (),
                 portable: bool = False) -> str:
    """Columns joined by ``|``; NULL is ``\\N``; ``\\`` and ``|`` inside text are escaped.

    ``json_columns`` are JSON text whose key order and spacing must not count. With ``portable``, top-level floats and
    doubles are written as ``portable_double`` does.
    """
    types, json_columns, parts = _types(df), set(json_columns), []
    for name in columns or df.columns:
        col = sql_name(name)
        if name in json_columns:
            text = json_text(col)
        elif portable and isinstance(types[name], (T.FloatType, T.DoubleType)):
            text = portable_double(col)
        else:
            text = value_text(col, types[name])
        if isinstance(types[name], (T.StringType, *_COMPLEX)):
            text = rf"replace(replace({text}, r'\', r'\\'), '|', r'\|')"
        parts.append(rf"coalesce({text}, r'\N')")
    return f"concat_ws('|', {', '.join(parts)})"


def row_text(df: DataFrame, columns: Sequence[str] | None = None, json_columns: Iterable[str] = (),
             portable: bool = False) -> Column:
    return F.expr(row_text_sql(df, columns, json_columns, portable))


def _flat_array(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, _COMPLEX)


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, json_columns: Iterable[str] = ()) -> Column:
    """64-bit hash of the typed row. NULL positions are hashed too, as ``xxhash64`` alone skips NULLs."""
    types, json_columns, values, nulls = _types(df), set(json_columns), [], []
    for name in columns or df.columns:
        col = sql_name(name)
        if name in json_columns:
            values.append(json_text(col))
        elif _flat_array(types[name]):
            # the hash skips NULL elements, so their places are hashed as well
            values += [col, f"size({col})", f"transform({col}, x -> x IS NULL)"]
        elif isinstance(types[name], _COMPLEX):
            values.append(_nested_text(col, types[name]))
        else:
            values.append(col)
        nulls.append(f"{col} IS NULL")
    return F.expr(f"xxhash64({', '.join(values + nulls)})")


def portable_hash(text: Column) -> Column:
    """First 60 bits of md5 as a whole number that other engines can compute as well."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_pieces(h: str) -> list[str]:
    return [f"(shiftrightunsigned({h}, {shift}) & {(1 << bits) - 1}L)" for bits, shift in _PIECES]


def join_pieces(pieces: Sequence[str]) -> str:
    """The summed pieces as one whole number, as text; no rows give 0."""
    terms = [f"cast({p} AS decimal(20,0)) * cast({1 << shift} AS decimal(14,0))"
             for p, (_, shift) in zip(pieces, _PIECES)]
    return f"cast(cast(coalesce({' + '.join(terms)}, 0) AS decimal(38,0)) AS string)"


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, algorithm: str = "xxhash64",
                by: Sequence[str] = (), json_columns: Iterable[str] = ()) -> DataFrame:
    """``(by…, row_count, fingerprint)``: one map-side aggregate, no sort, whatever the row order."""
    columns = list(columns or df.columns)
    if algorithm in ("md5", "md5_portable"):
        text = row_text(df, columns, json_columns, portable=algorithm == "md5_portable")
        hashed = df.select(*by, portable_hash(text).alias("_h"))
    elif algorithm == "xxhash64":
        hashed = df.select(*by, row_hash(df, columns, json_columns).alias("_h"))
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    value = join_pieces([f"sum({p})" for p in hash_pieces("_h")])
    return hashed.groupBy(*by).agg(F.expr("count(*) AS row_count"), F.expr(f"{value} AS fingerprint"))
