"""The prefix trie of conversations, as a Patricia tree over sorted sequences.

A turn becomes a digest of role and text and a count of words, a conversation
the sequence of its turns' digests. Equal sequences become one row. Sequences
are sorted over all tasks; in a part of the sorted rows, a node of the trie is
a run of neighbours, and what neighbours share tells where paths branch. So one
walk with a stack of open points builds the compressed tree of a part: only
ends, leaves and branches are points, and an edge stands for all turns between
two of them. Aggregates are summed on these points. Nodes inside an edge have
the same members as the point below, so they come from it, with the sums of
words from the edge's end.

Paths that leave a part (those shared with the last sequence of the part before
or the first of the part after) are summed node by node over the parts, and the
sums go back to the parts, which name the parents of their own nodes. A first
turn that a third of all conversations share is one row for each part.

A node's tokens saved, (conversations - 1) x words over its subtree, is
additive over sequences: the words of all copies less those that a sequence
doesn't share with the one sorted before it.

Defined results: rows without a conv_id belong to no conversation and are left
out. Turns go by number, nulls first; equal numbers by the digest of role and
text; repeated rows are turns of their own. Null roles and texts are empty. An
empty table has no nodes, not even a root. Extra columns, whatever their names,
are not read. A conversation is held as 24 bytes for each turn, never with its
texts; the ids that end at a node are hashed in ascending order as a stream of
pieces, which the fingerprint asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.common import dropped, shipped, written

DIGEST = 16  # bytes of a turn in a sequence
PART = 50_000  # turns of sequences in a part
PIECE = 64 << 10  # bytes of ids that are hashed at a time
WORD = r"[^\x20\x09-\x0D]+"
COHORT, SHARED = 20, 4  # conversations that take the first turns of one, and bound of how many
NO_ENDS = sha256(b"").hexdigest()

SPINE = "part int, place long, depth long, node binary, above long, n long, conv_id long, leaves long, pairs long, is_end boolean, ends string, words long, own long"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def digest_of(role: Column, text: Column) -> Column:
    """Hex digest of a turn; the role's length keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words) of each conversation: its first h turns come from
    the first conversation of its cohort, h by a hash of its id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest_of(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("turn"))
    own = written(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")), "turns")
    first = F.col("conv_id") - F.col("conv_id") % COHORT
    heads = own.where(F.col("conv_id") % COHORT == 0).select(F.col("conv_id").alias("cohort"), F.slice("turns", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    both = own.withColumn("cohort", first).join(heads, "cohort", "left").withColumn("h", h)
    start = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    found = both.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    return found.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.words").alias("words"))


# --- copies of a sequence ---------------------------------------------------


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema)


PIECES = pa.schema([("copy", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("copy", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of rows (copy, conv_id) in order, joined by commas up to PIECE bytes."""

    def made():
        held, size, at = [], 0, None
        for copy, conv in rows_of(batches):
            if held and (copy != at or size >= PIECE):
                yield at, held[0], len(held), ",".join(map(str, held))
                held, size = [], 0
            at = copy
            held.append(conv)
            size += len(str(conv)) + 1
        if held:
            yield at, held[0], len(held), ",".join(map(str, held))

    yield from batched(made(), PIECES, 64)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint, least id and number of ids of each sequence from its pieces in order."""

    def made():
        for copy, own in groupby(rows_of(batches), key=lambda r: r[0]):
            of, first, n = sha256(), None, 0
            for _, begins, k, ids in own:
                of.update((ids if first is None else "," + ids).encode())
                first, n = begins if first is None else first, n + k
            yield copy, first, n, of.hexdigest()

    yield from batched(made(), ENDS)


def sequences(convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence: key, words, conv_id (the least), n, ends."""
    named = written(convs.withColumn("copy", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * DIGEST))), "rebuilt")
    ids = named.select("copy", "conv_id").repartitionByRange("copy", "conv_id").sortWithinPartitions("copy", "conv_id")
    ids = ids.mapInArrow(pieces, "copy binary, first long, n long, ids string")
    ends = ids.repartition("copy").sortWithinPartitions("copy", "first").mapInArrow(joined, "copy binary, conv_id long, n long, ends string")
    return named.groupBy("copy").agg(F.first("key").alias("key"), F.first("words").alias("words")).join(ends, "copy").drop("copy")


# --- the compressed tree of a part ------------------------------------------


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from the first on."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Point:
    """An end, leaf or branch; ``first`` is the place of its first sequence."""

    __slots__ = ("depth", "first", "above", "n", "conv", "leaves", "pairs", "ends", "words", "own", "open")

    def __init__(self, depth: int, first: int):
        self.depth, self.first, self.above, self.open = depth, first, None, False
        self.n, self.conv, self.leaves, self.pairs, self.ends, self.words, self.own = 0, None, 0, 0, None, 0, 0

    def take(self, below: Point) -> None:
        below.above = self
        self.n, self.leaves, self.words, self.own = self.n + below.n, self.leaves + below.leaves, self.words + below.words, self.own + below.own
        self.conv = below.conv if self.conv is None else min(self.conv, below.conv)


class Part:
    """The Patricia tree of sorted sequences (key, words, conv_id, n, ends)
    between the last one before and the first one after."""

    def __init__(self, rows: list[tuple], before: bytes | None, after: bytes | None):
        self.keys = [r[0] for r in rows]
        self.sums = [np.concatenate([[0], np.cumsum(np.array(r[1], np.int64))]) for r in rows]
        edges = [before, *self.keys, after]
        #: Turns shared with the sequence before; at the end, of the last one with the one after.
        self.common = [-1 if a is None or b is None else shared(a, b) for a, b in zip(edges, edges[1:])]
        self.points: list[Point] = []
        self.stack = [Point(-1, 0)]
        for k, (key, _, conv, n, ends) in enumerate(rows):
            if k:
                self.close(self.common[k])
            p = Point(len(key) // DIGEST, k)
            total = int(self.sums[k][-1])
            p.n, p.conv, p.ends, p.words = n, conv, ends, n * total
            p.own = total - int(self.sums[k][max(self.common[k], 0)])
            p.leaves = int(self.common[k + 1] < p.depth)
            self.stack.append(p)
        self.close(self.common[-1])
        for below, p in zip(self.stack[:0:-1], self.stack[-2::-1]):
            below.open = True
            p.take(below)
            self.points.append(below)

    def close(self, depth: int) -> None:
        """Close all points deeper than ``depth``, which becomes a point."""
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth, p.first))
            self.stack[-1].take(p)
            self.points.append(p)
        self.stack[-1].pairs += 1

    def before(self, k: int, depth: int) -> int:
        """Words of sequence ``k`` above a node of ``depth``."""
        return int(self.sums[k][max(depth - 1, 0)])

    def own(self, p: Point, depth: int) -> int:
        """Words of distinct nodes from ``depth`` on, where the node begins in this part."""
        return p.own - (self.before(p.first, depth) - int(self.sums[p.first][max(self.common[p.first], 0)]))

    def spine(self) -> Iterator[tuple[int, Point, bool]]:
        """(depth, point on or below it, whether it begins in this part) of the nodes that other parts have too."""
        left, right = self.common[0], self.common[-1]
        for p in self.points:
            if p.first == 0:
                for depth in range(p.above.depth + 1, min(p.depth, left) + 1):
                    yield depth, p, False
            if p.open:
                for depth in range(max(p.above.depth, left if p.first == 0 else -1) + 1, min(p.depth, right) + 1):
                    yield depth, p, True

    def partial(self) -> Iterator[tuple]:
        """Sums of the spine's nodes over this part: rows of SPINE without the part; place is that of a sequence that holds the node."""
        digests: dict[int, list[bytes]] = {}
        for depth, p, begins in self.spine():
            names = digests.get(p.first)
            if names is None or len(names) <= depth:
                deepest, of, names = self.common[0] if not begins else self.common[-1], sha256(), []
                key = self.keys[p.first]
                for d in range(min(max(deepest, self.common[0] if p.first == 0 else -1), len(key) // DIGEST) + 1):
                    of.update(key[(d - 1) * DIGEST : d * DIGEST] if d else b"")
                    names.append(of.copy().digest()[:DIGEST])
                digests[p.first] = names
            at = depth == p.depth
            own = self.own(p, depth) if begins else p.own
            yield p.first, depth, names[depth], self.before(p.first, depth), p.n, p.conv, p.leaves, p.pairs if at else 0, at and p.ends is not None, p.ends if at else None, p.words, own

    def nodes(self, whole: dict[tuple[int, int], tuple]) -> Iterator[tuple]:
        """Rows of NODES that begin in this part. ``whole`` has the sums over
        all parts of the spine's nodes, by the place of the sequence and depth."""
        names = {}
        for depth, p, begins in self.spine():
            names[id(p), depth] = begins
        left = self.common[0]

        def conv_at(p: Point, depth: int) -> int:
            """Least member of the node at ``depth`` on the path to ``p``, at or above its edge's top."""
            if depth == p.above.depth:
                p = p.above
            return whole[p.first, depth][1] if (id(p), depth) in names else p.conv

        for p in self.points:
            cuts, low = self.sums[p.first], p.above.depth + 1
            at_end = self.before(p.first, p.depth)
            mine = p.words - p.n * at_end - self.own(p, p.depth) if not p.open and not (p.first == 0 and p.depth <= left) else 0
            for depth in range(low, p.depth + 1):
                begins = names.get((id(p), depth))
                if begins is False:
                    continue
                parent = conv_at(p, depth - 1) if depth else None
                if begins:
                    n, conv, leaves, pairs, is_end, ends, words, own, above = whole[p.first, depth]
                    yield conv, depth, parent, n, pairs + (not is_end), leaves, words - n * above - own, ends or NO_ENDS
                else:
                    at = depth == p.depth
                    saved = mine + (p.n - 1) * (at_end - int(cuts[max(depth - 1, 0)]))
                    yield p.conv, depth, parent, p.n, p.pairs + (p.ends is None) if at else 1, p.leaves, saved, p.ends if at and p.ends else NO_ENDS


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part, dict]]:
    """Each part of rows in order of part, kind (0 the neighbours, 1 sums of the spine, 2 sequences) and key, and its sums."""
    for part, own in groupby(rows_of(batches), key=lambda r: r[0]):
        own = list(own)
        _, _, before, after, *_ = own[0]
        sums = {r[9:11]: r[11:] for r in own if r[1] == 1}
        yield part, Part([r[4:9] for r in own if r[1] == 2], before, after), sums


# --- all parts --------------------------------------------------------------

_SPINE = pa.schema([(n, pa.int32() if n == "part" else {"binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}.get(t, pa.int64())) for n, t in (c.split() for c in SPINE.split(", "))])
_NODES = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in NODES.split(", "))])
WHOLE = ["n", "least", "leaves", "pairs", "is_end", "all_ends", "all_words", "own", "above"]


def spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batched(((part, *row) for part, tree, _ in parts_of(batches) for row in tree.partial()), _SPINE)


def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batched((row for _, tree, sums in parts_of(batches) for row in tree.nodes(sums)), _NODES)


def trie(convs: DataFrame, part: int = PART) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, key, words): rows of NODES.
    ``part`` is the number of turns, about, that a task walks over at once."""
    found = written(sequences(convs), "sequences")
    turns = found.agg(F.sum(F.size("words") + 1)).first()[0]
    if not turns:
        return found.sparkSession.createDataFrame([], NODES)
    placed = found.repartitionByRange(-(-turns // part), "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    placed = written(placed.withColumnRenamed("n", "copies"), "sorted")
    dropped(found)
    bounds = placed.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("part")  # a row for each part
    bounds = written(bounds.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after")), "bounds")

    types = {"before": "binary", "after": "binary", "key": "binary", "words": "array<long>", "conv_id": "long", "copies": "long", "ends": "string", "place": "long", "depth": "long", **dict.fromkeys(WHOLE, "long"), "is_end": "boolean", "all_ends": "string"}

    def kind(df: DataFrame, k: int) -> DataFrame:
        return df.select("part", F.lit(k).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()))

    def by_part(*frames: DataFrame) -> DataFrame:
        every = frames[0]
        for more in frames[1:]:
            every = every.unionAll(more)
        return every.repartition("part").sortWithinPartitions("part", "kind", "key")

    own = written(by_part(kind(bounds, 0), kind(placed, 2)).mapInArrow(spines, SPINE), "spines")
    whole = own.groupBy("depth", "node").agg(F.sum("n").alias("n"), F.min("conv_id").alias("least"), F.sum("leaves").alias("leaves"), F.sum("pairs").alias("pairs"), F.max("is_end").alias("is_end"), F.max("ends").alias("all_ends"), F.sum("words").alias("all_words"), F.sum("own").alias("own"), F.max("above").alias("above"))
    back = own.select("part", "place", "depth", "node").join(whole, ["depth", "node"])
    return by_part(kind(bounds, 0), kind(back, 1), kind(placed, 2)).mapInArrow(emitted, NODES)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(shipped(conversations)))
