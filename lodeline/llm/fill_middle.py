"""Fill-in-the-middle transformation over a run-length encoding of classes.

Units are code points, and the class of one is its length in UTF-8. A text is
stored as its maximal runs of one class, each with the units and bytes before
it. A cut after so many units is found by binary search of the run that holds
it; within a run all units are equally long, so the byte offset is arithmetic.
Text in one script with ASCII signs has few runs, and no code point is visited
by Python: runs come from one comparison of neighbours, for a whole slice of
documents at a time, and all cuts of a slice from one vectorised search.

A document is left plain, or becomes prefix, suffix, middle (psm), or suffix,
prefix, middle (spm), each part behind its mark. Which one and where the cuts
are goes by a hash of the seed and the id, so repeated runs and equal rows agree.
The marks cannot occur in the parts, so ``restored`` gives the text back.

Defined results: null and empty texts are plain with n = 0. Texts that contain
a mark are plain. A row without an id is hashed with an empty id. Cuts may
fall together or at an end; the part between is then empty. Repeated rows each
give a row; an empty table gives an empty result. Extra columns, whatever
their names, are neither read nor returned. A text is handled whole; a task
holds about four times the bytes of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import shipped, slices, texts_of

# Marks, and the shares of documents (in 100) that are cut and that begin with the suffix.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"
CUT, SUFFIX_FIRST = 90, 20

#: Class of a byte that begins a code point: bytes of the code point; 0 for the bytes that continue one.
CLASSES = np.repeat(np.array([1, 0, 2, 3, 4], np.uint8), [0x80, 0x40, 0x20, 0x10, 0x10])

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Runs:
    """Maximal runs of one class; ``units`` and ``bytes`` are the counts before each run."""

    units: np.ndarray
    bytes: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Runs:
        """Runs of UTF-8 bytes."""
        classes = CLASSES[data]
        classes = classes[classes > 0]
        if not len(classes):
            none = np.zeros(0, np.int64)
            return cls(none, none, none)
        units = np.concatenate([[0], np.flatnonzero(classes[1:] != classes[:-1]) + 1])
        width = classes[units].astype(np.int64)
        size = np.diff(units, append=len(classes)) * width
        return cls(units, np.cumsum(size) - size, width)

    def bytes_before(self, units: np.ndarray) -> np.ndarray:
        """Bytes of the first so many units."""
        run = np.searchsorted(self.units, units, "right") - 1
        return self.bytes[run] + (units - self.units[run]) * self.width[run]

    def units_before(self, offset: np.ndarray) -> np.ndarray:
        """Units of the first so many bytes."""
        run = np.searchsorted(self.bytes, offset, "right") - 1
        return self.units[run] + (offset - self.bytes[run]) // self.width[run]


def draws(key: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers for a document."""
    x = sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return int(x[:8], 16), int(x[8:16], 16), int(x[16:24], 16), int(x[24:32], 16)


def rearranged(keys: pa.Array, texts: pa.Array, seed: int, cut: int, suffix_first: int) -> pa.RecordBatch:
    """The rows of OUT for a slice of documents."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    runs = Runs.of(data)
    first = runs.units_before(ends) if len(runs.units) else np.zeros(len(ends), np.int64)
    n = np.diff(first)
    h = np.array([draws(k, seed) for k in keys.to_pylist()], np.int64).reshape(-1, 4)
    plain = (n == 0) | pc.match_substring_regex(texts, MARKS).to_numpy(zero_copy_only=False) | (h[:, 2] % 100 >= cut)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)
    if len(runs.units):
        low, high = runs.bytes_before(first[:-1] + a), runs.bytes_before(first[:-1] + b)
    else:
        low = high = ends[:-1]
    spm = ~plain & (h[:, 3] % 100 < suffix_first)
    out = []
    for k in range(len(texts)):
        start, end = ends[k], ends[k + 1]
        if plain[k]:
            out.append(data[start:end].tobytes())
            continue
        prefix, middle, suffix = data[start : low[k]].tobytes(), data[low[k] : high[k]].tobytes(), data[high[k] : end].tobytes()
        head = (SUFFIX, suffix, PREFIX, prefix) if spm[k] else (PREFIX, prefix, SUFFIX, suffix)
        out.append(b"".join(x if isinstance(x, bytes) else x.encode() for x in (*head, MIDDLE, middle)))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    columns = [keys.cast(pa.int64()), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(a, mask=plain), pa.array(b - a, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.record_batch(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """A row for each document: its units, form, cuts and the rearranged text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield rearranged(batch.column(0), texts_of(batch.column(1)), seed, cut, suffix_first)

    return shipped(docs).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, OUT)


def restored(form: Column, output: Column) -> Column:
    """The text from its form and rearranged text."""
    parts = F.split(output, MARKS)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fingerprints(made: DataFrame) -> DataFrame:
    """``made`` with fingerprints of the rearranged and the restored text in place of the text."""
    back = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))
