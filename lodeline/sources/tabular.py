"""Files to raw tables: CSV with sniffed dialect, workbooks, parquet; sinks."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions.columns import ORDER, col, q, spark_names, unique_names, user_columns, with_order
from lodeline.functions.shipping import ship
from lodeline.sources import workbook
from lodeline.sources.csv_shape import shape_of
from lodeline.sources.xlsx import blocks, layout, sheet_names, write_sheet

TABLE_SUFFIXES = (".csv", ".xlsx", ".xlsm")
WORKBOOKS = (".xlsx", ".xlsm")
# Cells that mean missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SAMPLE = 4096
SHEET_ROWS = 1 << 20  # the format's bound
BOM = b"\xef\xbb\xbf"


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def content(spark: SparkSession, path: str) -> bytes:
    """A workbook's bytes (one file, whose format bounds it)."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def validate(spark: SparkSession, path: str) -> str:
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in TABLE_SUFFIXES:
        raise ValueError("This reader supports CSV, XLSX and XLSM files.")
    if not head(spark, path, 1):
        raise ValueError("The file is empty.")
    return suffix


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 where every line is valid in it, else Latin-1."""
    # Line ends are single bytes in both, so lines can be tested apart.
    return "ISO-8859-1" if spark.read.text(path).agg(F.count_if(~F.is_valid_utf8("value")).alias("n")).first()["n"] else "UTF-8"


def header_of(sample: bytes, encoding: str, delimiter: str) -> list[str]:
    text = sample.removeprefix(BOM).decode(encoding, "replace")
    return next((row for row in csv.reader(text.splitlines(), delimiter=delimiter) if row), [])


def delimiter_of(text: str) -> str:
    """A comma, unless the header has none and a semicolon or tab separates."""
    first = text.splitlines()[0] if text else ""
    if len(next(csv.reader([first]), [])) > 1 or not (";" in text or "\t" in text):
        return ","
    try:
        return csv.Sniffer().sniff(text, ";\t|").delimiter
    except csv.Error:
        return ";" if ";" in text else "\t"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; typing belongs to cleaning. One scan for the encoding
    and the shape, one for the rows, which only cells with line ends keep in one
    task for each file.

    A record of more cells than the header and a quote that is never closed are
    errors that name the line; also where the first record has one cell too many,
    which other readers take for a row label. Missing cells at the end of a
    record are NULL.
    """
    sample = head(spark, path, 1 << 20)
    # Delimiters and quotes are the same bytes in both encodings.
    delimiter = delimiter_of(sample.decode("latin-1").removeprefix(BOM.decode("latin-1"))[:SAMPLE])
    width = len(header_of(sample, "latin-1", delimiter))
    shape = shape_of(spark, path, delimiter, width)
    names = spark_names(unique_names(h or f"Unnamed: {k}" for k, h in enumerate(header_of(sample, shape.encoding, delimiter))))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).options(header=True, sep=delimiter, encoding=shape.encoding, multiLine=shape.multiline, escape='"', enforceSchema=True, mode="PERMISSIVE").csv(path)
    return with_order(raw.select(*(F.when(~F.coalesce(col(n), F.lit("")).isin(*MISSING), col(n)).alias(n) for n in names)))


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    if validate(spark, path) not in WORKBOOKS:
        return []
    if opens(path):
        with workbook.open_book(path) as file:
            return sheet_names(file)
    return sheet_names(content(spark, path))


def opens(path: str) -> bool:
    """Whether Python can open the file where it is, without Spark."""
    try:
        with workbook.open_book(path):
            return True
    except (OSError, ValueError, pa.ArrowException):
        return False


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook; ``sheet`` = ``*`` gives all as (sheet, row, cells).
    In stores that only Spark reads, one executor gets the file's bytes, and the
    driver looks at the header."""
    if opens(path):
        reader = workbook.register(spark).read.format("workbook").option("path", path)
        return (reader.option("sheet", sheet) if sheet is not None else reader).load()
    if sheet == workbook.ALL:
        raise ValueError("All sheets at once need a store that Python opens; read them one by one.")
    part, names = layout(content(spark, path), sheet)
    schema = T.StructType([T.StructField(ORDER, T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in batch.column(0):
                for rows in blocks(whole.as_py(), part, len(names)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(zip(*rows))], schema.names)

    return ship(spark).read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A CSV file or a sheet of a workbook (the first by default)."""
    return read_workbook(spark, path, sheet) if validate(spark, path) in WORKBOOKS else read_csv(spark, path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_order(spark.read.parquet(path))


def preview(df: DataFrame, rows: int = 1000) -> DataFrame:
    ordered = with_order(df)
    return ordered.orderBy(ORDER).limit(rows).drop(ORDER)


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> None:
    """The table as CSV with a header; ``single`` makes one file of small tables."""
    out = df.select(*(col(c).alias(c) for c in user_columns(df)))
    (out.coalesce(1) if single else out).write.mode("overwrite").options(header=True, encoding="UTF-8", escape='"').csv(path)


def write_workbook(df: DataFrame, path: str, sheet: str = "Data") -> None:
    """A table as a workbook, if it has no more rows than a sheet can have; the
    driver holds a part of them at a time."""
    names = user_columns(df)
    n = df.limit(SHEET_ROWS).count()
    if n == SHEET_ROWS:
        raise ValueError(f"A sheet has no room for {SHEET_ROWS:,} rows and a header.")
    store, inside = workbook.store_of(path)
    with store.open_output_stream(inside) as out:
        write_sheet(out, sheet, chain([tuple(names)], map(tuple, df.select(*map(col, names)).toLocalIterator())), (n + 1, len(names)))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report to any store that Spark writes."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


__all__ = ["list_sheets", "preview", "q", "read_csv", "read_parquet", "read_table", "read_workbook", "write_csv", "write_text", "write_workbook"]
