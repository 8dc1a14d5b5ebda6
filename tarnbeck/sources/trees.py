"""A folder of delimited files of mixed encodings and separators as one table.

Each file's head decides its encoding (a byte order mark, else the first of `encodings` that decodes it), its separator (that of
its suffix, else the first other one that splits the first line outside quotes) and its columns (the first line that is not
empty; empty names are numbered, repeated ones too). Files are cut into byte ranges; a range holds the lines that begin in it.

Rows are (path, at, values, error): at is the byte at which the line begins, values maps columns to fields. A line with
more or fewer fields than columns keeps those it has and says so in error; so does a line that its file's encoding does not
decode, which is read as latin-1, and a quote that is not closed. A file that cannot be read, or is larger than max_bytes, is
one row with its error alone. Empty files have no rows.

Options: path; suffixes (.csv,.tsv,.tab,.txt); max_bytes (none), a stated filter; split_bytes (64 MB); encodings (utf-8,latin-1);
multiline (false): with true, quoted fields may hold line ends, and a file is one range.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import files_below, opened

SEPARATORS = (",", ";", "\t", "|")
HEAD, BATCH = 1 << 16, 2000
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_SCHEMA = pa.schema([("path", pa.string()), ("at", pa.int64()), ("values", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int, size: int):
        self.path, self.low, self.high, self.size = path, low, high, size


class Shape:
    """What a file's head says about it."""

    def __init__(self, path: str, head: bytes, encodings: list[str]):
        mark = next((m for m in _MARKS if head.startswith(m[0])), None)
        self.start = len(mark[0]) if mark else 0
        self.encoding = mark[1] if mark else next((e for e in encodings if _decodes(head, e)), "latin-1")
        text = head[self.start :].decode(self.encoding, "replace")
        line = next((x for x in text.splitlines() if x.strip()), "")
        own = "\t" if path.lower().endswith((".tsv", ".tab")) else ","
        split = lambda s: next(csv.reader([line], delimiter=s), [])
        self.separator = next((s for s in dict.fromkeys((own, *SEPARATORS)) if len(split(s)) > 1), own)
        self.columns: list[str] = []
        for i, name in enumerate(split(self.separator)):
            name = name.strip() or f"_{i}"
            n = sum(c == name or c.startswith(f"{name}.") for c in self.columns)
            self.columns.append(f"{name}.{n}" if n else name)


def _decodes(head: bytes, encoding: str) -> bool:
    try:
        head.decode(encoding)
    except UnicodeDecodeError as e:
        # the head may end within a sign
        return len(head) == HEAD and e.start > len(head) - 4
    return True


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", ".csv,.tsv,.tab,.txt").split(","))
        self.most = int(options["max_bytes"]) if "max_bytes" in options else None
        self.split = int(options.get("split_bytes", 64 << 20))
        self.encodings = [e.strip() for e in options.get("encodings", "utf-8,latin-1").split(",")]
        self.multiline = options.get("multiline", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in files_below(self.root, self.suffixes):
            whole = self.multiline or size <= self.split or self.most is not None and size > self.most
            step = max(1, size) if whole else self.split
            out += [_Range(path, lo, min(lo + step, size), size) for lo in range(0, max(1, size), step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self._rows(partition):
            held.append(row)
            if len(held) == BATCH:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _rows(self, p: _Range) -> Iterator[tuple]:
        if not p.size:
            return
        if self.most is not None and p.size > self.most:
            yield p.path, None, None, f"left out: {p.size} bytes, {self.most} at most"
            return
        try:
            with opened(p.path) as f:
                shape = Shape(p.path, f.read(HEAD), self.encodings)
                if self.multiline or shape.encoding.startswith("utf-16"):
                    if p.low == 0:
                        f.seek(shape.start)
                        yield from self._stream(p.path, f, shape)
                else:
                    yield from self._lines(p, f, shape)
        except (OSError, csv.Error, UnicodeError) as e:
            yield p.path, None, None, f"{type(e).__name__}: {e}"

    def _lines(self, p: _Range, f: io.BufferedIOBase, shape: Shape) -> Iterator[tuple]:
        """Rows of the lines that begin within the range."""
        f.seek(max(p.low - 1, shape.start) if p.low else shape.start)
        if p.low > shape.start:
            f.readline()  # up to the end of a line that began before
        at, header = f.tell(), p.low == 0
        if not header:
            # the header may be longer than a range
            header = at <= self._header_at(f, shape, at)
        while at < p.high and (line := f.readline()):
            here, at = at, at + len(line)
            if not line.strip():
                continue
            if header:
                header = False
                continue
            error = None
            try:
                text = line.decode(shape.encoding)
            except UnicodeDecodeError:
                text, error = line.decode("latin-1"), f"not {shape.encoding}"
            yield self._row(p.path, here, text.rstrip("\r\n"), shape, error)

    def _header_at(self, f: io.BufferedIOBase, shape: Shape, back: int) -> int:
        """Where the header line begins; the file is left at `back`."""
        f.seek(shape.start)
        at = f.tell()
        while (line := f.readline()) and not line.strip():
            at += len(line)
        f.seek(back)
        return at

    def _row(self, path: str, at: int, text: str, shape: Shape, error: str | None) -> tuple:
        try:
            fields = next(csv.reader([text], delimiter=shape.separator, strict=True), [])
        except csv.Error as e:
            return path, at, [], f"{e}" if error is None else f"{error}; {e}"
        return self._fitted(path, at, fields, shape, error)

    def _fitted(self, path: str, at: int | None, fields: list[str], shape: Shape, error: str | None) -> tuple:
        if len(fields) != len(shape.columns):
            said = f"{len(fields)} fields for {len(shape.columns)} columns"
            error = said if error is None else f"{error}; {said}"
        return path, at, list(zip(shape.columns, fields, strict=False)), error

    def _stream(self, path: str, f: io.BufferedIOBase, shape: Shape) -> Iterator[tuple]:
        """Rows of a whole file, whose fields may hold line ends; at is the number of the row's last line."""
        text = io.TextIOWrapper(f, encoding=shape.encoding, newline="", errors="strict")
        rows = csv.reader(text, delimiter=shape.separator, strict=True)
        header = True
        for fields in rows:
            if not fields or fields == [""]:
                continue
            if header:
                header = False
                continue
            yield self._fitted(path, rows.line_num, fields, shape, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _SCHEMA.field(i).type) for i in range(4)], schema=_SCHEMA)


class TextTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_tables"

    def schema(self) -> str:
        return "path string, at long, values map<string,string>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
