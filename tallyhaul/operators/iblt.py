"""Differences between two tables from sketches of fixed size (invertible Bloom lookup tables).

Each row goes into three cells of a table of sums: how many rows, the sums of its key and of its row hash, and the sum of a check over
both. Each side is summed by itself, so the sides may live in different clusters, and only cells are exchanged: as many as the
expected differences need, whatever the size of the tables. Where the sketches are subtracted, equal rows cancel. A cell
that then holds one row (or copies of one) shows its key and hash, which its check confirms; taking that row out of its other
cells frees more of them, until all are empty. A table of cells that is too small is found out by cells that stay; it is then doubled.

64-bit numbers are summed as two halves of 32 bits, which stay clear of overflow up to 2**31 rows per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.canonical import row_hash, sql_name
from ..sources.storage import settle
from .compare import same_columns

HASHES = 3
_PIECE = 7  # bytes of a text key in one bigint


class UndecodedError(RuntimeError):
    """More differences than the table of cells can tell apart."""


class _Keys:
    """Key columns as bigints and back. Whole numbers, dates and timestamps take one; text takes one per seven bytes and one for its length."""

    def __init__(self, schema: T.StructType, keys: Sequence[str], text_bytes: int):
        self.fields = [schema[k] for k in keys]
        self.pieces = -(-text_bytes // _PIECE)
        self.sql = ["+".join(f"if({sql_name(f.name)} IS NULL, {1 << i}L, 0L)" for i, f in enumerate(self.fields))]
        self.back, at = [], 1
        for i, f in enumerate(self.fields):
            name, kind = sql_name(f.name), f.dataType.simpleString()
            if isinstance(f.dataType, T.StringType):
                raw = f"encode({name}, 'UTF-8')"
                own = [f"if(octet_length({name}) > {text_bytes}, raise_error('a text key is longer than text_bytes'), octet_length({name}))"]
                own += [f"cast(conv(hex(substring({raw}, {1 + _PIECE * j}, {_PIECE})), 16, 10) AS bigint)" for j in range(self.pieces)]
                hexed = ", ".join(f"lpad(hex(e{at + 1 + j}), 2 * greatest(0, least({_PIECE}, e{at} - {_PIECE * j})), '0')" for j in range(self.pieces))
                value = f"decode(unhex(concat({hexed})), 'UTF-8')"
            elif isinstance(f.dataType, T.DateType):
                own, value = [f"unix_date({name})"], f"date_from_unix_date(cast(e{at} AS int))"
            elif isinstance(f.dataType, T.TimestampType):
                own, value = [f"unix_micros({name})"], f"timestamp_micros(e{at})"
            elif isinstance(f.dataType, T.IntegralType):
                own, value = [name], f"cast(e{at} AS {kind})"
            else:
                raise ValueError(f"a key of type {kind} cannot be summed")
            self.sql += own
            self.back.append(f"if((e0 & {1 << i}) <> 0, NULL, {value}) AS {name}")
            at += len(own)
        self.n = at

    @property
    def numbers(self) -> list[str]:
        """Names of the numbers of an element: its key, then its row hash."""
        return [f"e{i}" for i in range(self.n + 1)]


def _halves(name: str) -> list[tuple[str, str]]:
    return [(f"{name}h", f"shiftright({name}, 32)"), (f"{name}l", f"({name} & 4294967295L)")]


def _columns(keys: _Keys) -> list[str]:
    return ["n", *[half for e in [*keys.numbers, "c"] for half, _ in _halves(e)]]


def _spread(elements: DataFrame, keys: _Keys, cells: int, times: str) -> DataFrame:
    """``times`` copies of elements, summed into their cells."""
    part, all_ = cells // HASHES, ", ".join(keys.numbers)
    where = ", ".join(f"pmod(xxhash64({all_}, {i}), {part}) + {i * part}" for i in range(HASHES))
    placed = elements.selectExpr(f"explode(array({where})) AS cell", f"{times} AS n", *keys.numbers, f"xxhash64({all_}, 'check') AS c")
    sums = [F.expr(f"sum({half} * n) AS {name}") for e in [*keys.numbers, "c"] for name, half in _halves(e)]
    return placed.groupBy("cell").agg(F.expr("sum(n) AS n"), *sums)


def _added(tables: DataFrame, keys: _Keys) -> DataFrame:
    summed = tables.groupBy("cell").agg(*[F.expr(f"sum({c}) AS {c}") for c in _columns(keys)])
    return summed.filter(" OR ".join(f"{c} <> 0" for c in _columns(keys)))


def sketch(df: DataFrame, keys: Sequence[str], cells: int, text_bytes: int = 64, json_columns: Sequence[str] = ()) -> DataFrame:
    """``(cell, sums…)``: ``cells`` rows at most. One scan; a task passes on as many rows as there are cells.

    Sketches can be compared where columns, keys and all arguments are the same."""
    coded = _Keys(df.schema, keys, text_bytes)
    elements = df.select(*[F.expr(e).cast("bigint").alias(f"e{i}") for i, e in enumerate(coded.sql)], row_hash(df, json_columns=json_columns).alias(f"e{coded.n}"))
    elements = elements.selectExpr(*[f"coalesce({e}, 0L) AS {e}" for e in coded.numbers])
    return _spread(elements, coded, _rounded(cells), "1L")


def _rounded(cells: int) -> int:
    return -(-max(cells, HASHES) // HASHES) * HASHES


def _shown(cells: DataFrame, keys: _Keys) -> DataFrame:
    """Elements of cells that hold one element only, with their copies; negative ones are the target's."""
    names = [*keys.numbers, "c"]
    whole = " AND ".join(f"{h} % n = 0" for e in names for h, _ in _halves(e))
    ones = cells.filter("n <> 0").filter(whole).selectExpr("n", *[f"shiftleft({e}h div n, 32) + {e}l div n AS {e}" for e in names],
                                                           *[f"{e}l div n AS {e}l" for e in names])
    fits = " AND ".join(f"{e}l BETWEEN 0 AND 4294967295" for e in names)
    return ones.filter(f"{fits} AND c = xxhash64({', '.join(keys.numbers)}, 'check')").select("n", *keys.numbers).distinct()


def _peeled(cells: DataFrame, keys: _Keys, n_cells: int) -> tuple[DataFrame | None, bool]:
    """(elements with their signed copies, whether all cells came out empty). Each round works on what the cells still hold."""
    found = None
    cells = settle(cells, "iblt_cells", 1)
    while not cells.isEmpty():
        new = settle(_shown(cells, keys), "iblt_shown", 1)
        if new.isEmpty():
            return found, False
        cells = settle(_added(cells.unionByName(_spread(new, keys, n_cells, "-n").select(*cells.columns)), keys), "iblt_cells", 1)
        found = new if found is None else found.unionAll(new)
    return found, True


def decode(source: DataFrame, target: DataFrame, schema: T.StructType, keys: Sequence[str], cells: int, text_bytes: int = 64) -> DataFrame:
    """``(keys…, status, source_rows, target_rows)`` from two sketches of ``cells`` cells: keys whose rows differ, with the rows that only one side has.

    A key with rows on both sides is changed. Raises :class:`UndecodedError` if the sketches hold more differences than they can tell apart."""
    coded = _Keys(schema, keys, text_bytes)
    flipped = target.selectExpr("cell", *[f"-{c} AS {c}" for c in _columns(coded)])
    found, complete = _peeled(_added(source.select("cell", *_columns(coded)).unionAll(flipped), coded), coded, _rounded(cells))
    if not complete:
        raise UndecodedError(f"{cells} cells do not hold all differences")
    names = [sql_name(k) for k in keys]
    if found is None:
        empty = T.StructType([schema[k] for k in keys]).add("status", "string", False).add("source_rows", "long").add("target_rows", "long")
        return source.sparkSession.createDataFrame([], empty)
    rows = found.selectExpr(*coded.back, "n").groupBy(*names).agg(
        F.expr("coalesce(sum(n) FILTER (WHERE n > 0), 0) AS source_rows"), F.expr("coalesce(-sum(n) FILTER (WHERE n < 0), 0) AS target_rows"))
    return rows.selectExpr(*names, "CASE WHEN target_rows = 0 THEN 'missing_in_target' WHEN source_rows = 0 THEN 'missing_in_source' "
                           "ELSE 'changed' END AS status", "source_rows", "target_rows")


def sketch_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], cells: int = 4096, most_cells: int = 1 << 24, text_bytes: int = 64,
                json_columns: Sequence[str] = ()) -> DataFrame:
    """Differences of two tables by key, with an exchange that grows with the differences and not with the tables.

    ``source_rows`` and ``target_rows`` count the rows that one side has and the other has not; for keys that are unique on each side the
    status is that of :func:`compare.diff_rows`. Starts with ``cells`` cells and doubles them until all differences come out;
    beyond ``most_cells`` :class:`UndecodedError` is raised, and a row diff is the better tool. Text keys have ``text_bytes`` bytes at most, else the
    scan fails. A difference goes unseen only if 64-bit hashes collide."""
    same_columns(source, target)
    while True:
        sides = [sketch(df, keys, cells, text_bytes, json_columns) for df in (source, target)]
        try:
            return decode(*sides, source.schema, keys, cells, text_bytes)
        except UndecodedError:
            if 2 * cells > most_cells:
                raise
            cells *= 2
