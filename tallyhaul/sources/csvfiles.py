"""CSV in the dialect of SQL bulk load: NULL is an empty field, the empty text is ``""``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.canonical import quoted

# Fixed values of the dialect. NUL cannot occur in SQL text, so it can stand for
# NULL while reading without taking any real value.
NUL = "\x00"
ONE_COLUMN_NULL = "\\N"  # an empty line is no row to a CSV reader, so one lone column marks NULL
_COMMON = {
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "dateFormat": "yyyy-MM-dd",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "positiveInf": "Infinity",
    "negativeInf": "-Infinity",
}
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)


def write_options(columns: int) -> dict[str, str]:
    null = ONE_COLUMN_NULL if columns == 1 else ""
    return {**_COMMON, "nullValue": null, "emptyValue": '""'}


def read_options(columns: int) -> dict[str, str]:
    null = ONE_COLUMN_NULL if columns == 1 else NUL
    return {**_COMMON, "nullValue": null, "emptyValue": "", "multiLine": "true", "mode": "FAILFAST"}


def _refuse(col: Column, name: str, marker: str) -> Column:
    """The value, or an error in the same pass when it equals the text that stands for NULL."""
    message = F.lit(f"column {name}: a value equals the text that marks NULL in CSV")
    return F.when(col == F.lit(marker), F.raise_error(message).cast("string")).otherwise(col)


def write_csv(df: DataFrame, path: str, header: bool = False, rows_per_file: int | None = None,
              nested_as_json: bool = False, mode: str = "errorifexists", file_bytes: int = 128 << 20) -> None:
    """Text with line breaks makes a file one unit of work for the reader, so files are bounded: to ``rows_per_file``,
    or else to the rows of mean length that fill ``file_bytes``, which takes one more pass over the rows."""
    marker = ONE_COLUMN_NULL if len(df.columns) == 1 else NUL
    out = []
    for f in df.schema.fields:
        col = quoted(f.name)
        if isinstance(f.dataType, _NESTED):
            if not nested_as_json or isinstance(f.dataType, T.BinaryType):
                raise ValueError(f"column {f.name}: {f.dataType.simpleString()} has no CSV form")
            col = F.to_json(col)
        elif isinstance(f.dataType, T.StringType):
            col = _refuse(col, f.name, marker)
        out.append(col.alias(f.name))
    text = df.select(*out)
    if rows_per_file is None:
        mean = text.agg(F.avg(csv_bytes(text)).alias("m")).first()["m"] or 1.0
        rows_per_file = max(1, int(file_bytes / mean))
    (text.write.mode(mode).options(**write_options(len(out))).option("header", header)
       .option("maxRecordsPerFile", rows_per_file).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = False) -> DataFrame:
    """Typed by the target's schema; a field that does not fit its type fails the read."""
    return (spark.read.schema(schema).options(**read_options(len(schema.fields)))
            .option("header", header).csv(path))


def csv_bytes(df: DataFrame) -> Column:
    """UTF-8 bytes of the row's CSV line, line end included."""
    line = F.to_csv(F.struct(*[quoted(c) for c in df.columns]), write_options(len(df.columns)))
    return F.octet_length(line) + F.lit(1)
