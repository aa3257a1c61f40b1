"""Batches of more text than a worker takes at a time: every operator cuts them
into slices, whose offsets do not begin at 0."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators import brute_groups, brute_license, lower

from lodeline.llm import common, decontamination, jaccard_join, license_scan, packing, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"


def long_texts(seed=3, n=36, words=21_000):
    """Texts of more than SLICE_BYTES together: groups of near copies, licences and benchmark items among them."""
    draw, out = random.Random(seed), []
    vocabulary = [f"W{draw.randrange(10**6)}é" if k % 5 else f"w{draw.randrange(10**6)}" for k in range(4000)]
    for k in range(n):
        if k % 3 == 0:
            base = [draw.choice(vocabulary) for _ in range(words - 100 * draw.randrange(50))]
        own = list(base)
        for _ in range(40 * (k % 3)):
            own[draw.randrange(len(own))] = f"v{draw.randrange(10**6)}"
        if k % 7 == 0:
            own[100:100] = ["GNU", "General", "Public", "License"]
        if k % 11 == 5:
            own[500:500] = ITEM.split()
        out.append((k, " ".join(own)))
    return out


@pytest.fixture(scope="module")
def rows():
    found = long_texts()
    assert sum(len(t.encode()) for _, t in found) > common.SLICE_BYTES
    return found


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("nulls", [False, True])
def test_words_of_slices(kind, nulls):
    texts = [None if nulls and k % 4 == 3 else f" Ab{k}  cDé\t{'x' * (k % 5)}ß\n" for k in range(300)]
    for start in (0, 1, 7, 250, 299, 300):
        column = common.texts_of(pa.array(texts, kind).slice(start))
        of, words, ids = common.split_words(column)
        got = [[] for _ in texts[start:]]
        for r, w in zip(of.tolist(), ids.tolist()):
            got[r].append(words[w].as_py())
        assert got == [WORDS.findall(lower(t)) for t in texts[start:]]


def test_licences_in_slices(table, rows):
    got = {r["doc_id"]: tuple(r)[1:6] for r in license_scan.scan_licenses(table).collect()}
    assert got == {d: brute_license(t) for d, t in rows}


def test_packing_of_slices(table, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packing.pack_documents(table).collect()}
    for d, t in rows[::6]:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            assert got[d, k] == (start, length, zlib.crc32(ids[start : start + length].tobytes()))


def severity(text, model):
    """Expected severity by its definition."""
    counts = collections.Counter()
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()):
        counts.update([w, *(w[:k] + "~" for k in toxicity.STEMS if len(w) > k)])
    margin = sum(model.weights.get(f, 0.0) * math.log1p(n) for f, n in counts.items())
    return sum(1 / (1 + math.exp(min(60, max(-60, t - margin)))) for t in model.thresholds)


def test_severity_of_slices(table, rows):
    words = sorted({w for _, t in rows for w in t.lower().split()})
    model = toxicity.Model({w: math.sin(k) for k, w in enumerate(words[::9])} | {w[:4] + "~": math.cos(k) for k, w in enumerate(words[::13])}, (-1.0, 2.5))
    want = {d: severity(t, model) for d, t in rows}
    got = {r["doc_id"]: r["severity"] for r in toxicity.score(table, model).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    assert {r["doc_id"] for r in toxicity.keep_clean(table, model).collect()} == {d for d, s in want.items() if s < toxicity.TOXIC_FROM}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10)])
def test_groups_of_slices(table, rows, n, num, den):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.similar_groups(table, n, num, den).collect()}
    want = brute_groups(rows, n, num, den)
    assert got == want and len(set(want.values())) == len(rows) // 3


def test_leaks_in_slices(spark, table, rows):
    benchmark = spark.createDataFrame([(2, ITEM)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table, benchmark).collect()}
    assert got == {(d, 2) for d, _ in rows if d % 11 == 5}
