"""Tables of SQLite files: a Python data source that reads ranges of row numbers, read only, with filters pushed to the files.

``spark.read.format("sqlite_rows").option("table", ...).load(file or folder)``. All files below a folder that end in ``.db``,
``.sqlite`` or ``.sqlite3`` hold parts of one table, of the columns of the first. A task opens its file itself, so files must be on a file system that every executor mounts.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from lectern.sources import places

ENDINGS = ("db", "sqlite", "sqlite3")
#: Rows of a partition.
ROWS = 250_000
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    """Opens a file that is there, and never writes to it."""
    return sqlite3.connect(f"file:{quote(places.place(path)[1])}?mode=ro", uri=True, timeout=30)


def column_type(declared: str) -> str:
    """Spark's type of a declared one, by SQLite's rules of affinity in their order; without a declaration, text."""
    declared = declared.upper()
    rules = (("bigint", ("INT",)), ("string", ("CHAR", "CLOB", "TEXT")), ("binary", ("BLOB",)), ("double", ("REAL", "FLOA", "DOUB", "NUM", "DEC")))
    return next((to for to, parts in rules if any(p in declared for p in parts)), "string")


@dataclass
class Rows(InputPartition):
    path: str
    first: int | None
    last: int | None


class SqliteReader(DataSourceReader):
    """Comparisons with literals, IN and IS NULL are evaluated in the file; text is compared by its bytes, as Spark does. Other filters stay with Spark."""

    def __init__(self, path: str, table: str, columns: list[tuple[str, str]], rows: int):
        self.path, self.table, self.columns, self.rows = path, table, columns, rows
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = dict(self.columns)
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = list(f.value) if isinstance(f, In) else [f.value] if type(f) in COMPARED else []
            wanted = {"bigint": int, "double": float, "string": str}.get(kinds.get(column))
            if column not in kinds or any(type(v) is not wanted for v in values) or not isinstance(f, (In, IsNull, IsNotNull, *COMPARED)):
                yield f
                continue
            # a value of another type than its column's is null to Spark, so that only those of the type may fit
            typed = f"typeof({_name(column)}) IN ({TYPED[kinds[column]]})"
            if isinstance(f, IsNull):
                self.where.append(f"NOT {typed}")
            elif isinstance(f, IsNotNull):
                self.where.append(typed)
            else:
                text = " COLLATE BINARY" if wanted is str else ""
                test = f"IN ({', '.join('?' * len(values))})" if isinstance(f, In) else f"{COMPARED[type(f)]} ?"
                self.where.append(f"({typed} AND {_name(column)}{text} {test})" if values else "0")
                self.values += values

    def partitions(self) -> list[Rows]:
        out, spans = [], []
        for path, _ in places.listed(self.path, ENDINGS):
            with connect(path) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(Rows(path, None, None))  # a table without row numbers
                    continue
            if low is not None:
                spans.append((path, low, high))
        # row numbers may have gaps, so that a range holds that many rows at most
        rows = max(self.rows, -(-sum(high - low + 1 for _, low, high in spans) // places.MOST_PARTS))
        out += [Rows(path, a, min(a + rows - 1, high)) for path, low, high in spans for a in range(low, high + 1, rows)]
        return out or [Rows("", None, None)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if not partition.path:
            return
        where, values = list(self.where), list(self.values)
        if partition.first is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.first, partition.last]
        chosen = ", ".join(_name(c) for c, _ in self.columns)
        made = [MADE[kind] for _, kind in self.columns]
        with connect(partition.path) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            for row in db.execute(f"SELECT {chosen} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values):
                yield tuple(make(v) for make, v in zip(made, row, strict=True))


#: SQLite's types of values that count for a column of a type; and what a value becomes, null if it is of another.
TYPED = {"bigint": "'integer'", "double": "'real', 'integer'", "string": "'text', 'integer', 'real'", "binary": "'blob'"}
MADE = {
    "bigint": lambda v: v if isinstance(v, int) else None, "double": lambda v: float(v) if isinstance(v, (int, float)) else None,
    "string": lambda v: v if isinstance(v, str) else None if v is None or isinstance(v, bytes) else str(v), "binary": lambda v: v if isinstance(v, bytes) else None,
}


class SqliteRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def _columns(self) -> list[tuple[str, str]]:
        files = places.listed(self.options["path"], ENDINGS)
        if not files:
            raise FileNotFoundError(f"no SQLite file below {self.options['path']}")
        with connect(files[0][0]) as db:
            told = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not told:
            raise ValueError(f"there is no table {self.options['table']!r}")
        return [(name, column_type(declared)) for _, name, declared, *_ in told]

    def schema(self) -> str:
        return ", ".join(f"`{c.replace('`', '``')}` {kind}" for c, kind in self._columns())

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], self._columns(), int(self.options.get("rowspertask", ROWS)))


def table(spark: SparkSession, path: str, name: str, rows: int = ROWS) -> DataFrame:
    """A table of one file, or of all files below a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteRows)
    return spark.read.format("sqlite_rows").option("table", name).option("rowsPerTask", rows).load(path)
