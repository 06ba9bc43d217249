"""A data source for knot tables in files: text columns, rows dealt by byte ranges, name filters pushed into the scan.

A table is a folder of line files: a header of column names, then rows, separated by `|`, as the published tables are in
text; the row that describes the columns ("Name") is not one of the knots. Files are read by Hadoop's or pyarrow's file
systems, so that a cluster's shared folder will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StringType, StructField, StructType

NAME, SEPARATOR = "name", "|"
#: Bytes of a partition, and of a read.
RANGE, STEP = 4 << 20, 1 << 20


@dataclass
class Span(InputPartition):
    """Lines that begin in a byte range of a file."""

    path: str
    first: int
    stop: int


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[pafs.FileInfo]:
    fs, at = _fs(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [info]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no knot table at {path}")
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def _header(path: str) -> list[str]:
    fs, _ = _fs(path)
    for f in _files(path):
        if f.size:
            with fs.open_input_file(f.path) as file:
                raw = b""
                while b"\n" not in raw:
                    more = file.read(STEP)
                    if not more:
                        break
                    raw += more
            names = raw.split(b"\n", 1)[0].decode().rstrip("\r").split(SEPARATOR)
            if NAME not in names or len(set(names)) != len(names):
                raise ValueError(f"{f.path}: a header of different names is needed, `{NAME}` among them")
            return names
    raise ValueError(f"{path}: no file has a header")


class KnotTableReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.range = options["path"], int(options.get("range", RANGE))
        self.columns = [f.name for f in schema.fields]
        self.names: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Equality and membership of the name are decided in the scan; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (NAME,):
                self._only([f.value])
            elif isinstance(f, In) and f.attribute == (NAME,):
                self._only(list(f.value))
            elif not (isinstance(f, IsNotNull) and f.attribute == (NAME,)):
                yield f

    def _only(self, names: list[str]) -> None:
        self.names = [n for n in names if n is not None and (self.names is None or n in self.names)]

    def partitions(self) -> list[Span]:
        if self.names == []:
            return [Span("", 0, 0)]
        spans = [Span(f.path, a, min(f.size, a + self.range)) for f in _files(self.path) for a in range(0, f.size, self.range)]
        return spans or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the span; one that begins before it is the last span's."""
        if not partition.path:
            return
        fs, _ = _fs(self.path)
        header = _header(self.path)
        at = [header.index(c) if c in header else None for c in self.columns]
        name, wanted = header.index(NAME), None if self.names is None else set(self.names)
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        rows: list[list[str | None]] = []
        for line in self._lines(fs, partition):
            cells = line.split(SEPARATOR)
            if len(cells) != len(header):
                raise ValueError(f"{partition.path}: a row has {len(cells)} cells for {len(header)} columns: {line[:80]!r}")
            if cells[name] in (NAME, "Name") or not cells[name].strip() or wanted is not None and cells[name] not in wanted:
                continue
            rows.append([cells[i] or None if i is not None else None for i in at])
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    @staticmethod
    def _lines(fs: pafs.FileSystem, span: Span) -> Iterator[str]:
        with fs.open_input_file(span.path) as file:
            # From a byte before, so that a line that begins right at the span's start is seen to begin there.
            at = max(0, span.first - 1)
            file.seek(at)
            left, skip = b"", span.first > 0
            while True:
                raw = file.read(STEP)
                left += raw
                lines = left.split(b"\n")
                left = lines.pop() if raw else b""
                for line in lines:
                    if not skip and at >= span.stop:
                        return
                    if not skip and line.strip():
                        yield line.decode().rstrip("\r")
                    skip, at = False, at + len(line) + 1
                if not raw:
                    return


class KnotTable(DataSource):
    """spark.read.format("knot_table").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "knot_table"

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in _header(self.options["path"])])

    def reader(self, schema: StructType) -> KnotTableReader:
        return KnotTableReader(schema, self.options)


def knot_table(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The table at path. Blank is null; names look-ups (=, in) are decided in the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KnotTable)
    return spark.read.format(KnotTable.name()).option("range", range_bytes).load(path)


def written(rows: DataFrame, path: str) -> str:
    """Write a table of text columns for knot_table(): each file has the header. A cell that holds the separator or a line's end raises."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bad = F.exists(F.array(*map(cell, rows.columns)), lambda x: x.rlike("[|\r\n]"))
    line = F.when(bad, F.raise_error(F.lit("a cell holds the separator or a line's end")).cast("string")).otherwise(F.concat_ws(SEPARATOR, *map(cell, rows.columns)))
    rows.select(line.alias(SEPARATOR.join(rows.columns))).write.option("header", True).option("quote", "").option("escape", "").option("sep", "\x01").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path
