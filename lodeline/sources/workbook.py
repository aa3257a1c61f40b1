"""Excel workbooks as a data source of Spark.

``spark.read.format("workbook").option("path", ...)`` gives the first sheet, or
the one that the option ``sheet`` names, with the columns of its header. With
``sheet`` = ``*`` it gives all sheets: (sheet, row, cells). Each sheet is read
in parts of ``rows`` rows; a part unpacks the sheet from its beginning, as the
format asks, and parses its own rows only. No process holds a whole workbook:
files are opened where they are, and only the parts asked for are read.

Paths are those of stores that pyarrow opens (local and shared folders, HDFS,
object stores); ``tabular.read_workbook`` reads others through Spark.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeline.functions.columns import ORDER
from lodeline.functions.shipping import ship
from lodeline.sources import xlsx

ROWS = 100_000
ALL = "*"
CELLS = T.StructType([T.StructField("sheet", T.StringType()), T.StructField("row", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def open_book(path: str) -> pa.NativeFile:
    store, inside = store_of(path)
    return store.open_input_file(inside)


@dataclass
class Part(InputPartition):
    sheet: str
    part: str
    first: int
    most: int | None


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: T.StructType, rows: int):
        self.path, self.sheet, self.names, self.rows = path, sheet, schema.names, rows

    def partitions(self) -> list[Part]:
        out = []
        with open_book(self.path) as file, xlsx.opened(file) as book:
            for name, part in xlsx.sheets(book):
                if self.sheet == ALL or name == self.sheet or (self.sheet is None and not out):
                    n = xlsx.size_of(book, part)
                    firsts = range(0, max(n or 1, 1), self.rows)
                    # A sheet may have more rows than it says: the last part has no end.
                    out += [Part(name, part, k, self.rows if k + self.rows < firsts.stop else None) for k in firsts]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with open_book(self.path) as file:
            if self.sheet == ALL:
                with xlsx.opened(file) as book:
                    held: list[tuple[str, int, list]] = []
                    for k, row in enumerate(xlsx.sheet_rows(book, partition.part, partition.first, partition.most), partition.first):
                        held.append((partition.sheet, k, row))
                        if len(held) == 5_000:
                            yield self.batch(held, [pa.string(), pa.int64(), pa.list_(pa.string())])
                            held = []
                    if held:
                        yield self.batch(held, [pa.string(), pa.int64(), pa.list_(pa.string())])
            else:
                for block in xlsx.blocks(file, partition.part, len(self.names) - 1, partition.first, partition.most):
                    yield self.batch(block, [pa.int64()] + [pa.string()] * (len(self.names) - 1))

    def batch(self, rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], self.names)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        sheet = self.options.get("sheet")
        if sheet == ALL:
            return CELLS
        with open_book(self.options["path"]) as file:
            _, names = xlsx.layout(file, sheet)
        return T.StructType([T.StructField(ORDER, T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), schema, int(self.options.get("rows", ROWS)))


def register(spark: SparkSession) -> SparkSession:
    """Make the format ``workbook`` known to a session and its executors."""
    ship(spark).dataSource.register(Workbook)
    return spark
