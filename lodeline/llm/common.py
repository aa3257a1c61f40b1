"""Helpers that the corpus operators share: the shared folder, written
intermediate tables and vectorised word splitting."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.shipping import scratch, ship

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4 << 20


#: Bytes of a batch that Spark hands to a worker, a little less than a slice, and
#: Spark's own bound. The same bytes are held by both for each task.
BATCH_BYTES, DEFAULT_BATCH = 15 << 18, 64 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """``spark``, with the package on its executors and batches of bounded size,
    unless the session has a bound of its own."""
    if re.sub(r"\D", "", spark.conf.get(BATCH_KEY)) == str(DEFAULT_BATCH):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """``df``, whose session is ready to work on it."""
    ready(df.sparkSession)
    return df


def trimmed() -> None:
    """Give memory that a worker no longer uses back: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: the
    lineage ends there and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodeline_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in frames:
        remove(df.sparkSession, df._lodeline_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is none of ``ids`` (one column). Rows
    without an id stay, and stay out of the exchange, where they would all meet."""
    name = free_name(docs, "lost_id")
    named = docs.where("doc_id IS NOT NULL").join(ids.toDF(name), F.col("doc_id") == F.col(name), "left_anti")
    return docs.where("doc_id IS NULL").unionAll(named)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return pa.array([], pa.large_string())
    # A copy whose offsets begin at 0: kernels damage texts of a slice that was cast as it is.
    column = column.take(pa.array(np.arange(len(column)))).cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``most`` bytes of text at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end
    trimmed()


def hash_words(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of a dictionary."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(dictionary))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z in lower case.

    Returns (row of each word, distinct words, index of each word in them).
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    found = flat.dictionary_encode()
    words, ids = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(words), 0)
    if pc.any(empty).as_py():  # white space at an end of a text
        keep = ~empty.to_numpy(zero_copy_only=False)[ids]
        rows, ids = rows[keep], ids[keep]
    return rows, words, ids
