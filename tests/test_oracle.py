"""Every registered query against its SQL on the same files, row by row and type by type."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tallyhaul.oracle import ORACLE_SQL as ORACLE
from tallyhaul.queries import QUERIES, TABLES


def norm(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, decimal.Decimal)):
        return str(decimal.Decimal(value).normalize())
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


SQL_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def sql_type(spark_type):
    return SQL_TYPE.get(spark_type, spark_type.upper())


@pytest.fixture(scope="module")
def duck(sf_dir_module):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir_module}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf_dir_module():
    import os

    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, sf_dir_module, name):
    df = entry.queries()[name](spark, sf_dir_module)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    want = table(columns, result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for g, w in zip(got[1], want[1]):
        assert g == w
    for field in df.schema.fields:
        if not field.dataType.simpleString().startswith("array"):
            assert types[field.name] == sql_type(field.dataType.simpleString()).replace(" ", ""), field.name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
