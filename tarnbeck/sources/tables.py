"""Data sources for SQLite files and spreadsheets, with the standard library and Arrow.

Without a table named, both give one row per table row as (table, row, values map<string,string>); the option `tables`, a JSON
list, says which are read. With the option `table`, SQLite gives that table's own columns, integers, reals or text by their
declared kind (a value of another kind is null, and so are blobs); a schema with fewer columns reads only those, and the option
`where`, a JSON list of [column, sign, value], goes into the query (readers.read_sqlite sets it). Tables are cut into ranges of
rowids, which are read side by side and come as Arrow batches. Local files are opened read-only; a file in another store is
read into memory by each task.

Filters come as options since those that Spark 4.1 hands to pushFilters() stay with the source: a second query on the same
DataFrame would be filtered by the first one's.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import local_path, opened, read_bytes

SCHEMA = "table string, row long, values map<string,string>"
#: Rows of a batch, and rowids of a range unless the option `rows` says otherwise.
BATCH, RANGE = 5000, 200_000
#: Signs of `where`, and the most values of an `in`.
SIGNS, MOST_VALUES = ("=", ">", ">=", "<", "<=", "in", "is not null"), 500


def register(spark: SparkSession) -> None:
    """Makes the sources known."""
    for source in (SqliteSource, XlsxSource):
        spark.dataSource.register(source)


class _Named(InputPartition):
    def __init__(self, name: str, low: int | None = None, high: int | None = None):
        self.name, self.low, self.high = name, low, high


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> T.DataType:
    """Type of a column by SQLite's rules of affinity."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.StringType()


def _asked(options) -> frozenset[str] | None:
    return frozenset(json.loads(options["tables"])) if "tables" in options else None


class _Sqlite(DataSourceReader):
    def __init__(self, options, schema: T.StructType | None = None):
        self.path, self.table, self.fields = options["path"], options.get("table"), schema
        self.rows, self.wanted = int(options.get("rows", RANGE)), _asked(options)
        self.where = self._tests(json.loads(options.get("where", "[]")))

    def connect(self):
        import sqlite3

        local = local_path(self.path)
        if local is not None:
            return contextlib.closing(sqlite3.connect(f"file:{local}?mode=ro", uri=True))
        con = sqlite3.connect(":memory:")
        con.deserialize(read_bytes(self.path))
        return contextlib.closing(con)

    def columns(self) -> list[tuple[str, str]]:
        """(name, declared kind) of the table's columns."""
        with self.connect() as con:
            return [(r[1], r[2] or "") for r in con.execute(f"pragma table_info({_quoted(self.table)})")]

    def _tests(self, asked: list[list]) -> list[tuple[str, list]]:
        """(SQL, values) of the tests that SQLite decides as Spark does or more widely; who asked tests again."""
        out = []
        declared = {n: k.upper() for n, k in self.columns()} if asked else {}
        for name, sign, value in asked:
            # text is compared with text only where the column turns all that is stored into text
            kind = declared.get(name)
            if kind is None or sign not in SIGNS or isinstance(_kind(kind), T.StringType) and not any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
                continue
            values = value if sign == "in" else [] if sign == "is not null" else [value]
            if len(values) <= MOST_VALUES and all(isinstance(v, (int, float, str)) for v in values):
                marks = f" ({', '.join('?' * len(values))})" if sign == "in" else " ?" * len(values)
                out.append((f"{_quoted(name)} {sign}{marks}", values))
        return out

    def partitions(self) -> list[InputPartition]:
        out = []
        with self.connect() as con:
            names = [n for (n,) in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
            for name in names:
                if name != (self.table or name) or self.wanted is not None and name not in self.wanted:
                    continue
                low, high = self._ends(con, name)
                if low is None:
                    out.append(_Named(name))
                else:
                    out += [_Named(name, lo, min(lo + self.rows - 1, high)) for lo in range(low, high + 1, self.rows)]
        return out or [_Named("")]

    @staticmethod
    def _ends(con, name: str) -> tuple[int | None, int | None]:
        """The first and last rowid; None for a table without rowids or rows."""
        import sqlite3

        try:
            return con.execute(f"select min(rowid), max(rowid) from {_quoted(name)}").fetchone()
        except sqlite3.OperationalError:
            return None, None

    def read(self, partition: _Named) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        table, span, at = _quoted(partition.name), "", []
        if partition.low is not None:
            span, at = "rowid between ? and ?", [partition.low, partition.high]
        with self.connect() as con:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            if self.table is None:
                yield from self._maps(con, table, span, at, partition)
            else:
                yield from self._typed(con, table, span, at)

    def _maps(self, con, table: str, span: str, at: list, partition: _Named) -> Iterator[pa.RecordBatch]:
        n = con.execute(f"select count(*) from {table} where rowid < ?", at[:1]).fetchone()[0] if span else 0
        cur = con.execute(f"select * from {table}" + (f" where {span} order by rowid" if span else ""), at)
        names = [d[0] for d in cur.description]
        kinds = pa.schema([("table", pa.string()), ("row", pa.int64()), ("values", pa.map_(pa.string(), pa.string()))])
        while rows := cur.fetchmany(BATCH):
            cells = [[(c, None if v is None else str(v)) for c, v in zip(names, r, strict=True)] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(rows)), pa.array(range(n, n + len(rows)), pa.int64()), pa.array(cells, kinds.field("values").type)], schema=kinds)
            n += len(rows)

    def _typed(self, con, table: str, span: str, at: list) -> Iterator[pa.RecordBatch]:
        tests = [*([span] if span else []), *(w for w, _ in self.where)]
        names = ", ".join(_quoted(f.name) for f in self.fields) or "1"
        cur = con.execute(f"select {names} from {table}" + (f" where {' and '.join(tests)}" if tests else ""), [*at, *(v for _, vs in self.where for v in vs)])
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.fields)
        fit = {T.LongType: lambda v: v if isinstance(v, int) else None, T.DoubleType: lambda v: float(v) if isinstance(v, (int, float)) else None}
        text = lambda v: v if isinstance(v, str) else str(v) if isinstance(v, (int, float)) else None
        while rows := cur.fetchmany(BATCH):
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([fit.get(type(f.dataType), text)(v) for v in c], k.type) for f, k, c in zip(self.fields, schema, columns, strict=False)], schema=schema)


class SqliteSource(DataSource):
    """Options: path, tables or table, where, rows (of rowids in a range)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_tables"

    def schema(self) -> str | T.StructType:
        if "table" not in self.options:
            return SCHEMA
        return T.StructType([T.StructField(n, _kind(k)) for n, k in _Sqlite(self.options).columns()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Sqlite(self.options, schema)


class _Xlsx(DataSourceReader):
    """Cell values as text, from the sheets' XML; the first row names the columns."""

    NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def __init__(self, options):
        self.path, self.wanted = options["path"], _asked(options)

    def partitions(self) -> list[InputPartition]:
        import xml.etree.ElementTree as E
        import zipfile

        with zipfile.ZipFile(opened(self.path)) as z:
            targets = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            sheets = E.fromstring(z.read("xl/workbook.xml")).iter(f"{self.NS}sheet")
            kept = [s for s in sheets if self.wanted is None or s.get("name") in self.wanted]
            return [_Named(f"{s.get('name')}\n{targets[s.get(self.REL)].lstrip('/').removeprefix('xl/')}") for s in kept] or [_Named("")]

    def read(self, partition: _Named) -> Iterator[tuple]:
        import xml.etree.ElementTree as E
        import zipfile

        if not partition.name:
            return
        title, target = partition.name.split("\n")
        with zipfile.ZipFile(opened(self.path)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in s.iter(f"{self.NS}t")) for s in E.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{self.NS}si")]
            header, n = None, 0
            with z.open(f"xl/{target}") as f:
                for _, row in E.iterparse(f):
                    if row.tag != f"{self.NS}row":
                        continue
                    cells = {}
                    for c in row.iter(f"{self.NS}c"):
                        v, inline = c.find(f"{self.NS}v"), c.find(f"{self.NS}is")
                        text = "".join(t.text or "" for t in inline.iter(f"{self.NS}t")) if inline is not None else v.text if v is not None else None
                        if text is not None and c.get("t") == "s":
                            text = shared[int(text)]
                        cells["".join(x for x in c.get("r") if x.isalpha())] = text
                    row.clear()
                    if header is None:
                        header = {k: v or k for k, v in cells.items()}
                    else:
                        yield title, n, {header.get(k, k): v for k, v in cells.items()}
                        n += 1


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Xlsx(self.options)
