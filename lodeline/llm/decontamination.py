"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping windows of words. Their TF-IDF rows over the
benchmark's terms (other words count in the norm) form a matrix A whose leading
right singular vectors a randomised, distributed decomposition computes: one
pass sums Y = A'(A G) for an orthonormal random G, and the Nystroem
approximation Y (G'Y)^-1 Y' of A'A has its factors without another pass. Tables
that partitions send are of a fixed size and are summed in a tree of fixed fan-in.

Windows and pieces of benchmark items meet in the latent space; a window whose
cosine with a piece reaches the threshold is a candidate. Candidates are
verified on the words around the window: the longest common subsequence with
the item must cover a share of the item, and one with its answer (the last
sentence, or the last quarter of a one-sentence item) a share of that. Where an
item's sentences are in another order, the subsequences with its sentences are
summed, but no more than the words that item and surroundings share, each as
often as both have it. So edited copies and copies with reordered sentences
count, and texts that only share common words don't.

Items shorter than a window are hardly seen in its cosine, so they are searched
exactly as well. A document is cut into overlapping stretches of about twice
the item's words; a copy of up to one and a half times the item's length lies
whole in one of them. Where a share of an item's n words occurs in order, at
most (1 - share) n of them are missing, so of the (1 - share) n + t rarest ones
at least t occur: every stretch with t of these is verified.

Counts, factors and search cover all windows of all documents, but for windows
that can't matter: a copy of an item of n words (32 at most count) that is at
most half as long again and has the share of 0.6 has 0.4 n of its words in some
window. The benchmark is the stated query set; it is taken in blocks of about
``BLOCK_WORDS`` words, which bound the terms and thereby every table.

Words are runs of letters, digits and non-ASCII characters in lower case.

Defined results: null or empty texts and items have no words and match nothing.
Items of fewer than ``LEAST_WORDS`` words match where all their words follow one
another, as edits of so few words are in clean texts too. Repeated rows give equal matches once per (doc_id, item_id).
A null doc_id or item_id has no name to report and is left out of the matches.
Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import dropped, shipped, slices, without_ids, written

WINDOW, STRIDE, PIECE_STEP = 32, 16, 4
RANK, EXTRA = 208, 16
#: Words of a block; so many bytes count as a word at least. An item is whole in one block.
BLOCK_WORDS, WORD_BYTES = 1 << 17, 8
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables that one task of the summing tree adds.
FAN_IN = 4
LEAST_WORDS = 8
#: Short items that the exact search takes at a time.
SHORT_ITEMS = 512
#: Bytes of term numbers that a worker takes at a time.
IDS_BYTES = 1 << 20
LATENT_COSINE = 0.52
ITEM_SHARE, ANSWER_SHARE = 0.6, 0.5

MATCHES = "doc_id long, item_id long, cosine double, item_share double, answer_share double, first_word long"

_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TO_WORDS).split()


@dataclass
class Item:
    item_id: int
    ids: np.ndarray
    answer: int  # position of the answer's first word
    sentences: tuple[int, ...] = ()  # words of each sentence


@dataclass
class Queries:
    """A block of the benchmark: items, the vocabulary, and pieces of items."""

    items: list[Item]
    terms: dict[bytes, int]
    #: Items of fewer than LEAST_WORDS words.
    tiny: list[Item] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Queries:
        items, terms, tiny = [], {}, []
        for item_id, text in rows:
            words = word_list(text)
            if len(words) < LEAST_WORDS:
                if words:
                    tiny.append(Item(item_id, np.array([terms.setdefault(w, len(terms)) for w in words], np.int32), 0))
                continue
            sentences = [n for s in re.split(r"(?<=[.!?])\s+", text) if (n := len(word_list(s)))]
            last = sentences[-1] if len(sentences) > 1 and sentences[-1] >= 3 else max(3, len(words) // 4)
            items.append(Item(item_id, np.array([terms.setdefault(w, len(terms)) for w in words], np.int32), len(words) - last, tuple(sentences)))
        return cls(items, terms, tiny)

    @property
    def width(self) -> int:
        """Columns of the matrix."""
        return max(1, len(self.terms))

    @property
    def least_known(self) -> int:
        """In-vocabulary words that a window over a leak has at least."""
        shortest = min((len(i.ids) for i in self.items), default=LEAST_WORDS)
        return max(4, int(0.4 * min(shortest, WINDOW)))

    def pieces(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(item of each piece, its term ids)."""
        of, out = [], []
        for k, item in enumerate(self.items):
            n = len(item.ids)
            for start in range(0, max(1, n - WINDOW + PIECE_STEP), PIECE_STEP):
                start = max(0, min(start, n - WINDOW))
                of.append(k)
                out.append(item.ids[start : start + WINDOW])
        return np.array(of, np.int64), out


def encode(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, ids): each document's words as term numbers, -1 for others."""
    terms = docs.sparkSession.sparkContext.broadcast(queries.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.value.get
        for batch in slices(batches, "t"):
            ids = [np.fromiter((get(w, -1) for w in word_list(t)), np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return shipped(docs).selectExpr("cast(doc_id as long) i", "cast(text as string) t").where("i IS NOT NULL").mapInArrow(run, "doc_id long, ids binary")


class Windows:
    """The windows of a batch of documents, as halves of STRIDE words.

    Window w of a document has the halves w and w + 1; a document of one half
    has one window.
    """

    def __init__(self, blobs: list[bytes], width: int):
        ids = [np.frombuffer(b, np.int32) for b in blobs]
        lengths = np.array([len(x) for x in ids], np.int64)
        self.flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.first_word = np.concatenate([[0], np.cumsum(lengths)])
        halves = -(-lengths // STRIDE)
        counts = np.where(halves > 0, np.maximum(halves - 1, 1), 0)
        first_half = np.concatenate([[0], np.cumsum(halves)])
        doc_of_word = np.repeat(np.arange(len(ids)), lengths)
        half_of_word = first_half[doc_of_word] + (np.arange(len(self.flat)) - self.first_word[doc_of_word]) // STRIDE
        self.doc = np.repeat(np.arange(len(ids)), counts)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.half = first_half[self.doc] + self.place
        self.second = np.where(halves[self.doc] > 1, self.half + 1, -1)
        self.n_halves = int(first_half[-1])
        known, self.width = self.flat >= 0, width
        self.term = self.flat[known]
        self.term_half = half_of_word[known]
        self.unknown = np.bincount(half_of_word[~known], minlength=self.n_halves)
        self.known = np.bincount(self.term_half, minlength=self.n_halves)
        # A row of known terms for each half, those with most terms first; ``width`` fills up.
        self.order = np.argsort(-self.known, kind="stable")
        place = np.empty(self.n_halves, np.int64)
        place[self.order] = np.arange(self.n_halves)
        self.terms = np.full((self.n_halves, STRIDE), width, np.int32)
        self.terms[place[self.term_half], np.arange(len(self.term)) - np.repeat(np.cumsum(self.known) - self.known, self.known)] = self.term

    def __len__(self) -> int:
        return len(self.doc)

    def paired(self, per_half: np.ndarray) -> np.ndarray:
        """Sums over the two halves of each window."""
        padded = np.concatenate([per_half, np.zeros((1, *per_half.shape[1:]), per_half.dtype)])
        return padded[self.half] + padded[self.second]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, term, count) of the matrix."""
        window_of_half = np.full(self.n_halves + 1, -1)
        window_of_half[self.half] = np.arange(len(self))
        before = np.full(self.n_halves + 1, -1)
        before[self.second] = np.arange(len(self))
        before[-1] = -1
        a, b = window_of_half[self.term_half], before[self.term_half]
        window = np.concatenate([a[a >= 0], b[b >= 0]])
        term = np.concatenate([self.term[a >= 0], self.term[b >= 0]])
        keys, counts = np.unique(window * self.width + term, return_counts=True)
        return keys // self.width, keys % self.width, counts

    def norms(self, idf: np.ndarray, idf_unknown: float) -> np.ndarray:
        window, term, count = self.entries()
        square = np.bincount(window, (count * idf[term]) ** 2, len(self)) + self.paired(self.unknown) * idf_unknown**2
        return np.sqrt(np.maximum(square, 1e-12)).astype(np.float32)

    def projected(self, table: np.ndarray) -> np.ndarray:
        """Rows times ``table`` (terms by columns, idf included), not normalised."""
        padded = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)])
        out = np.empty((self.n_halves + 1, table.shape[1]), np.float32)
        out[-1] = 0
        for at in range(0, self.n_halves, 512):  # whole rows at a time, in blocks that stay in the cache
            rows = self.order[at : at + 512]
            total = np.zeros((len(rows), table.shape[1]), np.float32)
            for k in range(self.known[rows[0]]):
                total += padded[self.terms[at : at + 512, k]]
            out[rows] = total
        both = out[self.half]
        for at in range(0, len(both), 512):
            both[at : at + 512] += out[self.second[at : at + 512]]
        return both

    def back(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Transposed rows times ``rows`` (windows by columns), without idf."""
        out = np.zeros((width, rows.shape[1]))
        halves = np.zeros((self.n_halves + 1, rows.shape[1]), np.float32)
        halves[self.half] = rows
        for at in range(0, len(rows), 512):  # windows without a second half meet in the last row
            halves[self.second[at : at + 512]] += rows[at : at + 512]
        order = np.argsort(self.term, kind="stable")
        term, half = self.term[order], self.term_half[order]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        for t, start, end in zip(term[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)]):
            out[t] = halves[half[start:end]].sum(0)
        return out


def summed(encoded: DataFrame, width: int, shape: tuple[int, ...], part: Callable[[Windows], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over the windows of all documents: each partition
    sends one table of a fixed size, and tables are summed in a tree."""

    def table(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["table"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in slices(batches, "ids", IDS_BYTES):
            total += part(Windows(batch.column(1).to_pylist(), width))
        yield table(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.float32).reshape(shape)
        yield table(total)

    tables, n = encoded.mapInArrow(first, "table binary"), encoded.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        tables = tables.repartition(n).mapInArrow(add, "table binary")
    total = np.zeros(shape)
    for row in tables.toLocalIterator():  # at most FAN_IN tables, one at a time
        total += np.frombuffer(row["table"], np.float32).reshape(shape)
    return total


@dataclass
class Space:
    """Inverse frequencies and the latent space of one block of queries."""

    idf: np.ndarray
    idf_unknown: float
    vectors: np.ndarray  # terms by rank, idf included


def latent_space(encoded: DataFrame, width: int, rank: int = RANK, seed: int = 7) -> Space:
    """TF-IDF statistics and a randomised SVD over all windows."""

    def frequencies(w: Windows) -> np.ndarray:
        _, term, _ = w.entries()
        return np.concatenate([np.bincount(term, minlength=width), [len(w)]]).astype(float)

    counts = summed(encoded, width, (width + 1,), frequencies)
    n = counts[-1]
    idf = np.log((n + 1) / (counts[:-1] + 1)) + 0.01
    idf_unknown = float(np.log(n + 1)) + 0.01
    columns = min(rank + EXTRA, width)
    start, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, columns)))
    spread = (start * idf[:, None]).astype(np.float32)

    def outer(w: Windows) -> np.ndarray:
        rows = w.projected(spread) / (w.norms(idf, idf_unknown) ** 2)[:, None]
        return w.back(rows, width) * idf[:, None]

    vectors, values = nystroem(summed(encoded, width, (width, columns), outer), start)
    vectors, values = vectors[:, :rank], values[:rank]
    # Coordinates of unit variance: else the few strongest topics decide every cosine.
    scale = np.sqrt(np.maximum(values, max(1e-6 * values.max(), 1e-12)) / max(n, 1))
    return Space(idf, idf_unknown, (vectors / scale * idf[:, None]).astype(np.float32))


def nystroem(image: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and falling eigenvalues of the positive semidefinite M with
    ``image`` = M ``start``, from these two alone. A small shift keeps the
    Cholesky factor defined; it grows where rounding asks for more."""
    shift = max(np.sqrt(len(image)) * np.finfo(np.float32).eps * float(np.linalg.norm(image)), 1e-30)
    while True:
        moved = image + shift * start
        core = start.T @ moved
        try:
            factor = np.linalg.cholesky((core + core.T) / 2)
            break
        except np.linalg.LinAlgError:
            shift *= 10
    vectors, roots, _ = np.linalg.svd(np.linalg.solve(factor, moved.T).T, full_matrices=False)
    return vectors, np.maximum(roots**2 - shift, 0)


def common_length(positions: dict[int, int], region: np.ndarray, size: int) -> int:
    """Longest common subsequence with an item, bit-parallel: ``positions`` has
    the bit mask of each term in the item."""
    full = (1 << size) - 1
    state = full
    for x in region.tolist():
        if m := positions.get(x):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return size - state.bit_count()


def masks(ids: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(ids.tolist()):
        out[x] = out.get(x, 0) | (1 << k)
    return out


class Wording:
    """An item's words or its last ones, with the ends of the sentences in them."""

    def __init__(self, ids: np.ndarray, sentences: tuple[int, ...]):
        self.size, self.mask, self.words = len(ids), masks(ids), Counter(ids.tolist())
        starts = (len(ids) - np.cumsum(sentences[::-1], dtype=np.int64)[::-1]).clip(0) if sentences else np.zeros(0, np.int64)
        cuts = np.unique([0, *starts.tolist(), len(ids)]).tolist()
        self.parts = [(masks(ids[a:b]), b - a) for a, b in zip(cuts, cuts[1:])] if len(cuts) > 2 else []

    def share(self, region: np.ndarray, least: float) -> float:
        """Share of the words that the region has in order or, where that is below ``least``, in order by
        sentence. 0 where it has too few of the words for ``least`` in any order."""
        own = [x for x in region.tolist() if x in self.mask]
        if len(own) < least * self.size:
            return 0.0
        region = np.array(own, np.int64)
        most = common_length(self.mask, region, self.size)
        if self.parts and most < least * self.size:
            here = Counter(own)
            both = sum(min(n, here[x]) for x, n in self.words.items())
            if both >= least * self.size:
                most = max(most, min(both, sum(common_length(m, region, n) for m, n in self.parts)))
        return most / self.size


def occurrences(flat: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, entry) for the ``count`` entries of each word's term that begin at ``first``."""
    counts = count[flat]
    word = np.repeat(np.arange(len(flat)), counts)
    return word, np.repeat(first[flat] - (np.cumsum(counts) - counts), counts) + np.arange(len(word))


class Sequences:
    """Items of fewer than LEAST_WORDS words, by the term of their rarest word."""

    def __init__(self, queries: Queries, idf: np.ndarray):
        self.sizes = np.array([len(i.ids) for i in queries.tiny], np.int64)
        self.ids = np.full((len(queries.tiny), LEAST_WORDS), -2, np.int32)
        for k, i in enumerate(queries.tiny):
            self.ids[k, : len(i.ids)] = i.ids
        self.place = np.array([int(np.argmax(idf[i.ids])) for i in queries.tiny], np.int64)
        term = self.ids[np.arange(len(self.place)), self.place]
        self.items = np.argsort(term, kind="stable")
        self.count = np.bincount(term, minlength=len(queries.terms) + 1)
        self.first = np.cumsum(self.count) - self.count

    def found(self, w: Windows) -> Iterator[tuple[int, int, int]]:
        """(document, item, place of its first word) for each place where all words of an item follow one another."""
        word, entry = occurrences(w.flat, self.count, self.first)
        item = self.items[entry]
        doc = np.searchsorted(w.first_word, word, "right") - 1
        start = word - self.place[item]
        live = (start >= w.first_word[doc]) & (start + self.sizes[item] <= w.first_word[doc + 1])
        item, doc, start = item[live], doc[live], start[live]
        same = np.ones(len(item), bool)
        for k in range(LEAST_WORDS - 1):
            inside = k < self.sizes[item]
            same &= ~inside | (w.flat[np.minimum(start + k, len(w.flat) - 1)] == self.ids[item, k])
        yield from zip(doc[same].tolist(), item[same].tolist(), (start - w.first_word[doc])[same].tolist())


class Anchors:
    """The rarest words of some short items, by term.

    ``need`` of an item's anchors occur wherever ``share`` of its words do.
    """

    def __init__(self, queries: Queries, numbers: list[int], idf: np.ndarray, share: float):
        self.half = np.ones(len(queries.items), np.int64)
        self.need = np.ones(len(queries.items), np.int64)
        terms, items = [], []
        for k in numbers:
            ids = queries.items[k].ids
            least = max(1, int(np.ceil(share * len(ids) - 1e-9)))
            self.need[k], self.half[k] = max(1, least // 3), -(-len(ids) // 2)
            rarest = np.argsort(-idf[ids], kind="stable")[: len(ids) - least + self.need[k]]
            own = np.unique(ids[rarest])
            terms.append(own)
            items.append(np.full(len(own), k))
        term, item = np.concatenate(terms), np.concatenate(items)
        self.items = item[np.argsort(term, kind="stable")]
        # One more entry: the words out of the vocabulary have no items.
        self.count = np.bincount(term, minlength=len(queries.terms) + 1)
        self.first = np.cumsum(self.count) - self.count

    def stretches(self, w: Windows) -> Iterator[tuple[int, int, int]]:
        """(document, item, stretch) with enough anchors; a stretch is four halves of the item long and starts at each half."""
        word, entry = occurrences(w.flat, self.count, self.first)
        item = self.items[entry]
        doc = np.searchsorted(w.first_word, word, "right") - 1
        half = (word - w.first_word[doc]) // self.half[item]
        most = int(half.max(initial=0)) + 1
        pair = (doc * len(self.half) + item) * most
        keys, found = np.unique(np.concatenate([(pair + half - back)[half >= back] for back in range(4)]), return_counts=True)
        item = keys // most % len(self.half)
        live = found >= self.need[item]
        yield from zip((keys[live] // most // len(self.half)).tolist(), item[live].tolist(), (keys[live] % most).tolist())


class Search:
    """Candidate search and verification for one block of queries."""

    def __init__(self, queries: Queries, space: Space, latent_cosine: float, item_share: float, answer_share: float):
        self.queries, self.space = queries, space
        self.latent_cosine, self.item_share, self.answer_share = latent_cosine, item_share, answer_share
        self.of, pieces = queries.pieces()
        self.known = queries.least_known
        self.rows = np.zeros((len(pieces), space.vectors.shape[1]), np.float32)
        self.weights: list[dict[int, float]] = []
        for k, ids in enumerate(pieces):
            term, count = np.unique(ids, return_counts=True)
            weight = count * space.idf[term]
            self.rows[k] = count @ space.vectors[term]
            self.weights.append(dict(zip(term.tolist(), (weight / np.linalg.norm(weight)).tolist())))
        self.rows /= np.maximum(np.linalg.norm(self.rows, axis=1, keepdims=True), 1e-9)
        self.whole = [Wording(i.ids, i.sentences) for i in queries.items]
        self.answers = [Wording(i.ids[i.answer :], i.sentences) for i in queries.items]
        short = [k for k, i in enumerate(queries.items) if len(i.ids) < WINDOW]
        self.anchors = [Anchors(queries, short[at : at + SHORT_ITEMS], space.idf, item_share) for at in range(0, len(short), SHORT_ITEMS)]
        self.sequences = Sequences(queries, space.idf) if queries.tiny else None

    def candidates(self, w: Windows) -> Iterator[tuple[int, np.ndarray]]:
        """(window, pieces) that are close in the latent space."""
        live = np.flatnonzero(w.paired(w.known) >= self.known)
        rows = w.projected(self.space.vectors)
        for at in range(0, len(live), 4096):
            some = live[at : at + 4096]
            own = rows[some]
            least = self.latent_cosine * np.maximum(np.sqrt(np.einsum("ij,ij->i", own, own)), 1e-9)
            scores = own @ self.rows.T
            for k in np.flatnonzero(scores.max(1, initial=-1.0) >= least):
                yield int(some[k]), np.flatnonzero(scores[k] >= least[k])

    def exact(self, w: Windows, window: int, ids: np.ndarray, piece: int) -> float:
        """TF-IDF cosine of a window and a piece."""
        term, count = np.unique(ids[ids >= 0], return_counts=True)
        weight = count * self.space.idf[term]
        norm = np.sqrt((weight**2).sum() + (ids < 0).sum() * self.space.idf_unknown**2)
        own = self.weights[piece]
        return float(sum(x * own.get(t, 0.0) for t, x in zip(term.tolist(), weight.tolist())) / max(norm, 1e-9))

    def matches(self, w: Windows, doc_ids: list[int]) -> list[tuple]:
        best: dict[tuple[int, int], tuple] = {}
        for window, pieces in self.candidates(w):
            doc = int(w.doc[window])
            lo, hi = w.first_word[doc], w.first_word[doc + 1]
            start = lo + int(w.place[window]) * STRIDE
            ids = w.flat[start : min(hi, start + WINDOW)]
            for item in np.unique(self.of[pieces]).tolist():
                q = self.queries.items[item]
                size = len(q.ids)
                region = w.flat[max(lo, start - size) : min(hi, start + WINDOW + size)]
                share = self.whole[item].share(region, self.item_share)
                if share < self.item_share or (doc, item) in best and best[doc, item][3] >= share:
                    continue
                in_answer = self.answers[item].share(region, self.answer_share)
                cosine = max(self.exact(w, window, ids, p) for p in pieces[self.of[pieces] == item].tolist())
                if in_answer >= self.answer_share:
                    best[doc, item] = (doc_ids[doc], q.item_id, cosine, share, in_answer, int(start - lo))
        for anchors in self.anchors:
            for doc, item, stretch in anchors.stretches(w):
                q, half = self.queries.items[item], int(anchors.half[item])
                size = len(q.ids)
                lo, hi = int(w.first_word[doc]), int(w.first_word[doc + 1])
                start = lo + stretch * half
                region = w.flat[start : min(hi, start + 4 * half)]
                share = self.whole[item].share(region, self.item_share)
                if share < self.item_share or (doc, item) in best and best[doc, item][3] >= share:
                    continue
                in_answer = self.answers[item].share(region, self.answer_share)
                piece = int(np.searchsorted(self.of, item))  # a short item has one
                cosine, at = max((self.exact(w, 0, region[k : k + size], piece), -k) for k in range(max(1, len(region) - size + 1)))
                if in_answer >= self.answer_share:
                    best[doc, item] = (doc_ids[doc], q.item_id, cosine, share, in_answer, start - at - lo)
        for doc, item, start in self.sequences.found(w) if self.sequences else ():
            best.setdefault((doc, -1 - item), (doc_ids[doc], self.queries.tiny[item].item_id, 1.0, 1.0, 1.0, start))
        return list(best.values())


def contaminated(docs: DataFrame, benchmark: DataFrame, latent_cosine: float = LATENT_COSINE, item_share: float = ITEM_SHARE, answer_share: float = ANSWER_SHARE, rank: int = RANK) -> DataFrame:
    """Matches (doc_id, item_id, ...) of documents with benchmark items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    # Equal rows would all fall into one block, and find the same.
    items = items.distinct()
    size = F.greatest(F.regexp_count("text", F.lit(WORD)), F.ceil(F.octet_length("text") / WORD_BYTES))
    words = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-words // BLOCK_WORDS))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = sorted((r["item_id"], r["text"]) for r in numbered.where(F.col("block") == block).collect())
        own = _matches(docs, Queries.of(rows), (latent_cosine, item_share, answer_share), rank)
        found = own if found is None else found.unionAll(own)
    # One row for each pair: the best of repeated rows and items.
    best = F.max(F.struct("item_share", "answer_share", "cosine", (-F.col("first_word")).alias("at"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.item_share", "b.answer_share", (-F.col("b.at")).alias("first_word"))


def _matches(docs: DataFrame, queries: Queries, limits: tuple[float, ...], rank: int) -> DataFrame:
    spark = docs.sparkSession
    if not queries.items and not queries.tiny:
        return spark.createDataFrame([], MATCHES)
    encoded = written(encode(docs, queries), "encoded")
    space = latent_space(encoded, queries.width, rank)
    search = spark.sparkContext.broadcast((queries, space, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Search(*search.value[:2], *search.value[2])
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
        names = ["doc_id", "item_id", "cosine", "item_share", "answer_share", "first_word"]
        for batch in slices(batches, "ids", IDS_BYTES):
            if rows := own.matches(Windows(batch.column(1).to_pylist(), own.queries.width), batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    out = written(encoded.mapInArrow(run, MATCHES), "matches")
    dropped(encoded)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, all columns."""
    return without_ids(docs, contaminated(docs, benchmark).select("doc_id").distinct())
