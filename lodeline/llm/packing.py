"""Best-fit decreasing packing of token pieces into fixed-size sequences.

Best-fit decreasing takes pieces by falling length and puts each into the open
sequence with the least room that still holds it. Pieces of one length are
interchangeable, so the run over all pieces is a function of the histogram of
lengths alone, which has at most ``capacity`` entries whatever the input. The
planner keeps open sequences by their remaining room: a segment tree over the
rooms 0..capacity finds the tightest room that fits in logarithmic time, and
each step moves a whole run of equal sequences. The outcome equals the step by
step run. The plan says, for the k-th piece of each length, its sequence and
offset; pieces get their k in parallel, by salted ranks, and look it up.

A document is its token ids followed by the end id. Only a document longer
than the capacity is cut: into full pieces, after a first piece that takes what
is left over.

Defined results: a null text counts as empty and packs its end id alone.
Repeated rows are documents of their own. An empty table gives an empty
result. Null ids pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.common import shipped, slices, written

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
#: Pieces that one salt of a length has at most, about.
SALT_ROWS = 2_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _ranked(path: str, pattern: str):
    """The same vocabulary in the form of ranks, which encodes faster."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Token ids of texts as little-endian 32-bit integers.

    Texts of the Basic Latin to IPA blocks go through the ranked form, whose
    ids are the same (tested for each of their characters); where Unicode tables
    of the two libraries may differ (other scripts, separators U+001C-1F and
    U+0085) and where the special token is spelt out, the tokenizer itself encodes.
    """

    def __init__(self, vocabulary: str):
        import re

        import public_tokenizers

        self.path = public_tokenizers.path(vocabulary)
        self.ranked = None
        if vocabulary == VOCABULARY:
            self.ranked = _ranked(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        self.foreign = re.compile("[^\x00-\x1b\x20-\x84\x86-\u02af]")

    def odd(self, text: str) -> bool:
        return SPECIAL in text or self.foreign.search(text) is not None

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is not None and not self.odd(text):
            return np.asarray(self.ranked.encode_to_numpy(text, disallowed_special=()), "<u4")
        return np.asarray(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = total - (total - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of each document, with the checksum of its ids and a
    number of its own (``row``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, end, row = Ids(vocabulary), np.array([end_id], "<u4"), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "t"):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.concatenate([ids.encode(text or ""), end])
                for k, (start, length) in enumerate(cut(len(own), capacity)):
                    out.append((doc, k, start, length, zlib.crc32(own[start : start + length].tobytes())))
            columns = list(zip(*out))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(np.arange(row, row + len(out)))], [*NAMES, "row"])
            row += len(out)

    return shipped(docs).selectExpr("cast(doc_id as long) i", "cast(text as string) t").mapInArrow(run, PIECES + ", row long")


class Rooms:
    """How many open sequences have each remaining room: a segment tree whose
    nodes hold whether any room below them is in use."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.size)

    def set(self, room: int, used: bool) -> None:
        at = self.size + room
        self.used[at] = int(used)
        while at := at // 2:
            self.used[at] = self.used[2 * at] | self.used[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room in use that is at least ``least``."""
        at = self.size + least
        if self.used[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.used[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best-fit decreasing over a histogram of lengths.

    Returns, for each length, runs (first rank, first sequence, offset, pieces
    in each sequence), and the number of sequences. Piece k of a run lies in
    sequence first + k // each, at offset + k % each * length.
    """
    rooms = Rooms(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    made = 0

    def put(room: int, first: int, count: int) -> None:
        if room:
            own = open_.setdefault(room, [])
            if not own:
                rooms.set(room, True)
            own.append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank, out = histogram[length], 0, runs.setdefault(length, [])
        while left:
            room = rooms.tightest(length)
            if room is None:
                each = capacity // length
                first, count = made, -(-left // each)
                made += count
                room = capacity
            else:
                first, count = open_[room].pop()
                if not open_[room]:
                    rooms.set(room, False)
                each = room // length
            full = min(count, left // each)
            if full:
                out.append((rank, first, capacity - room, each))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:  # the last one takes fewer
                out.append((rank, first + full, capacity - room, left))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            if full < count:
                put(room, first + full, count - full)
    return runs, made


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table that is read more than once) with sequence_id and offset."""
    total = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in total}
    runs, _ = plan(histogram, capacity)
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}

    # Rank of each piece within its length: rank within (length, salt) plus the
    # pieces of smaller salts. Salts go by row number, as rows may be equal.
    salts = pieces.sparkSession.createDataFrame([(k, -(-n // SALT_ROWS)) for k, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), "salts"))
    by_salt = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(by_salt), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")
    ranked = salted.withColumn("k", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("k", F.col("k") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, k = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for length in np.unique(lengths):
                rank, first, at, each = table[int(length)]
                here = lengths == length
                run = np.searchsorted(rank, k[here], "right") - 1
                within = k[here] - rank[run]
                sequence[here] = first[run] + within // each[run]
                offset[here] = at[run] + within % each[run] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*NAMES, "sequence_id", "offset"])

    return ranked.select(*NAMES, "k").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Tokenise all documents and pack their pieces."""
    return pack(written(tokenize(docs, capacity, vocabulary, end_id), "pieces"), capacity)
