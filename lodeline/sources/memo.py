"""Parsed tables by what their files hold.

A file is known by its content, not by its path or time: a scan of its lines
sums their hashes with their places, so a second read of equal content costs
that scan (or the hash of a workbook's bytes) and no parsing. Tables are written
once to the shared folder and counted: every read takes a reference, every
release gives one back, and the last one deletes the table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.shipping import shared_dir
from lodeline.sources import tabular

VERSION = 1  # of the readers: what they give for a file


def content_key(spark: SparkSession, path: str, sheet: str | None = None) -> str:
    """The name of a file's content and, for workbooks, of the sheet.

    Lines are hashed with their numbers, which follow the splits of the file, so
    another split size gives another name for the same content, never one name
    for two contents (but for a collision of two 64-bit sums).
    """
    if tabular.validate(spark, path) in tabular.WORKBOOKS:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]
    else:
        sheet = None
        line = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
        h = lambda seed: F.xxhash64("value", F.col("at") + seed)
        found = line.agg(F.count("*").alias("n"), F.sum(h(0).cast("decimal(20,0)")).cast("string").alias("a"), F.bit_xor(h(1 << 40)).alias("b")).first()
    return hashlib.sha256(repr((VERSION, sheet, str(found))).encode()).hexdigest()


class ScanMemo:
    """Tables of a session by content. ``release`` what ``read`` has given."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, tuple[DataFrame, int]] = {}

    def path(self, key: str) -> str:
        return f"{shared_dir(self.spark)}/scans/{key}"

    def read(self, path: str, sheet: str | None = None) -> tuple[str, DataFrame]:
        """(key, table) of a file: parsed once, then read from the shared folder.
        A failed parse leaves nothing behind that a later read could take."""
        key = content_key(self.spark, path, sheet)
        if key in self.tables:
            table, n = self.tables[key]
        else:
            raw, n = tabular.read_table(self.spark, path, sheet), 0
            raw.write.mode("overwrite").parquet(self.path(key))
            table = self.spark.read.schema(raw.schema).parquet(self.path(key))
        self.tables[key] = table, n + 1
        return key, table

    def references(self, key: str) -> int:
        return self.tables[key][1] if key in self.tables else 0

    def release(self, key: str) -> None:
        """Give a reference back; the last one deletes the table."""
        table, n = self.tables[key]
        if n > 1:
            self.tables[key] = table, n - 1
            return
        del self.tables[key]
        table.unpersist()
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(key))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
