"""Licence notices in texts, with a bounded number of edits.

A notice of m characters that occurs with at most k edits has, cut into k + 1
pieces, one piece that occurs unchanged (pigeonhole). An Aho-Corasick machine
finds these pieces in one walk over a text. Only the surroundings of a piece go
to the bounded-error matching of the regex library: it says whether a window
has a span from word boundary to word boundary within the bound, and then which
spans those are and how many edits each takes. Word boundaries are part of what
is matched, and no best match is asked for, so no span hides another one. Of
spans of one notice that overlap, the one with fewest edits counts (the first
of equals), and what doesn't overlap it is reported as well.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case; notices are matched on the words joined by single spaces, from word
boundary to word boundary.

Defined results: a null text counts as empty; empty texts have no words, no
places, empty label strings and score 0. Rows are independent: repeated rows
and null ids pass through. Other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.llm.common import shipped, slices

# The base phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    edits: int


#: Short notices that are searched with edits. About one edit for nine characters.
NOTICES = (
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("gpl", "the terms of the gnu general public", 3),
    Notice("apache", "under the apache license", 2),
    Notice("apache", "apache license version 2", 2),
    Notice("mit", "under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("bsd", "bsd 3 clause license", 1),
    Notice("bsd", "bsd 2 clause license", 1),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("unlicense", "released into the public domain", 2),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by", "licensed under cc by", 2),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
    Notice("cc0", "creative commons zero", 2),
    Notice("proprietary", "all rights reserved", 1),
)

_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

MATCH = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, start long, end long, edits int, score double>>"


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of the edits + 1 pieces of nearly equal length."""
    n, k = len(phrase), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds base phrases and fuzzy notices in a text given as UTF-8."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE_PHRASES):
        import ahocorasick
        import regex

        self.notices = notices
        self.base = [(p.encode().split(), p.encode(), label) for p, label in base]
        errors = lambda n, k: f"(?:{regex.escape(n.phrase)}){{e<={k}}}"
        self.within = [regex.compile(rf"(?<![^ ]){errors(n, n.edits)}(?![^ ])") for n in notices]
        #: For each notice, patterns of at most 0, 1, 2, ... edits.
        self.by_edits = [[regex.compile(errors(n, k)) for k in range(n.edits + 1)] for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for at, piece in pieces(n.phrase, n.edits):
                seeds.setdefault(piece, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.machine.make_automaton()

    def candidates(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, merged windows of the text that may hold it."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.machine.iter(text):
            start = end + 1 - size
            for k, at in uses:
                n = self.notices[k]
                lo = max(0, start - at - n.edits)
                hi = min(len(text), start - at + len(n.phrase) + n.edits)
                own = spans.setdefault(k, [])
                if own and lo <= own[-1][1]:
                    own[-1] = (min(lo, own[-1][0]), max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        return spans

    def spans(self, k: int, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(edits, start, end) of the spans of whole words in a window that are within the bound."""
        n = self.notices[k]
        size = len(n.phrase)
        # One character more, so that a word that goes on is not taken for one that ends.
        if not self.within[k].search(text, max(0, lo - 1), hi + 1):
            return
        for start in range(lo, hi):
            if start and text[start - 1] != " ":
                continue
            for end in range(max(start + 1, start + size - n.edits), min(hi, start + size + n.edits) + 1):
                if end == len(text) or text[end] == " ":
                    edits = next((e for e, p in enumerate(self.by_edits[k]) if p.fullmatch(text, start, end)), None)
                    if edits is not None:
                        yield edits, start, end

    def matches(self, text: str) -> list[dict]:
        """Verified notices, as spans of the words joined by spaces."""
        out = []
        for k, windows in self.candidates(text).items():
            n = self.notices[k]
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted({x for lo, hi in windows for x in self.spans(k, text, lo, hi)}):
                at = bisect(taken, (start, end))
                if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                    continue
                taken.insert(at, (start, end))
                out.append({"label": n.label, "start": start, "end": end, "edits": edits, "score": 1 - edits / len(n.phrase)})
        return sorted(out, key=lambda x: (x["start"], x["end"], x["label"]))

    def scan(self, text: bytes) -> tuple:
        words = text.translate(_TO_WORDS).split()
        joined = b" ".join(words)
        places, labels = [], set()
        for parts, phrase, label in self.base:
            if phrase in joined:
                at = [i for i, w in enumerate(words) if w == parts[0] and words[i : i + len(parts)] == parts]
                if at:
                    places += at
                    labels.add(label)
        found = self.matches(joined.decode()) if joined else []
        every = labels | {m["label"] for m in found}
        score = 1.0 if labels else max((m["score"] for m in found), default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, found


@lru_cache(4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and places of the base phrases, labels,
    score and the verified spans (``matches``). A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(notices)
        for batch in slices(batches, "t"):
            rows = [own.scan(t or b"") for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            n, base, first, last, bl, al, score, found = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(bl, pa.string()), pa.array(al, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(MATCH))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    return shipped(docs).selectExpr(f"cast(`{id_col}` as long) i", f"cast(`{text_col}` as string) t").mapInArrow(run, SCHEMA)
