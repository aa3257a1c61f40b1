"""Toxicity grades by cumulative-link ordinal regression.

The severity of a document has grades 0..K-1. One weight vector w serves all
ordered thresholds t_1 < ... < t_{K-1}: P(grade >= k) = sigmoid(w.x - t_k). The
expected severity is the sum of these probabilities.

Features x are sparse counts of a text's words and of word stems (prefixes of
3 to 5 characters), each divided by nothing but squashed by log1p, so that one
hit counts the same in a short and in a long text. Only features that occur in
enough labelled documents are candidates; the strongest by the labels' log odds
enter the regression. The labels give two classes; the grade of a toxic
document is 1, or 2 where the log-odds mass of its words is at least the median
over toxic documents.

The fit takes at most ``max_labels`` labelled documents, those with the
smallest hash of the id (a documented bound), with their whole texts. Features
are counted and chosen on the executors; the driver fits the weights on sparse
counts of the chosen ones. Scoring covers every document and its whole text in
one map.

Defined results: a null text counts as empty and has the severity of no
feature. Without toxic or without clean labels nothing is rejected. Documents
with contradicting labels are not used. Repeated rows and null ids pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import dropped, shipped, slices, texts_of, written

MAX_LABELS = 6_000
MAX_FEATURES = 4_000
STEMS = (3, 4, 5)
LEAST_DOCS = 4
TOXIC_FROM = 0.5  # expected severity from which a document is toxic
SCORES = "doc_id long, severity double, grade int, toxic boolean"


def features_of(words: pa.Array) -> list[list[str]]:
    """Feature names of each distinct word: the word and its stems ("abc~")."""
    return [[w, *(w[:k] + "~" for k in STEMS if len(w) > k)] for w in words.to_pylist()]


def letters(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of lower-cased texts: runs of letters, digits and non-ASCII."""
    bare = pc.replace_substring_regex(pc.utf8_lower(texts), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    lists = pc.split_pattern(bare, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    found = flat.dictionary_encode()
    words, ids = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
    keep = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[ids]
    return rows[keep], words, ids[keep]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def severity(self, margin: np.ndarray) -> np.ndarray:
        return sum(1 / (1 + np.exp(np.clip(t - margin, -60, 60))) for t in self.thresholds) if self.thresholds else np.zeros(len(margin))

    def grade(self, margin: np.ndarray) -> np.ndarray:
        """The most probable grade under ordered thresholds at one half."""
        return sum((margin > t).astype(np.int32) for t in self.thresholds) if self.thresholds else np.zeros(len(margin), np.int32)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """w.x of each text."""
        rows, words, ids = letters(texts)
        index: dict[str, int] = {}
        pairs_word, pairs_feature = [], []
        for k, names in enumerate(features_of(words)):
            for name in names:
                if name in self.weights:
                    pairs_word.append(k)
                    pairs_feature.append(index.setdefault(name, len(index)))
        out = np.zeros(len(texts))
        if not index:
            return out
        weight = np.array([self.weights[n] for n in index])
        rows, features = _hits(rows, ids, len(words), np.array(pairs_word), np.array(pairs_feature))
        keys, counts = np.unique(rows * len(index) + features, return_counts=True)
        np.add.at(out, keys // len(index), weight[keys % len(index)] * np.log1p(counts))
        return out


def _hits(rows: np.ndarray, ids: np.ndarray, n_words: int, of_word: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each occurrence of a word that has features."""
    counts = np.bincount(of_word, minlength=n_words)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = counts[ids]
    rows, ids, n = rows[n > 0], ids[n > 0], n[n > 0]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(rows, n), feature[np.repeat(first[ids], n) + step]


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative logits with shared weights, by Adam on the whole sample.

    Grades weigh by the inverse root of their share. Thresholds stay ordered:
    t_k = t_1 + the sum of exponentials.
    """
    n = len(grades)
    w, b, gaps = np.zeros(n_features), 1.0, np.zeros(max(0, n_grades - 2))
    share = np.bincount(grades, minlength=n_grades) / n
    weight = (1 / np.sqrt(np.maximum(share, 1e-9)))[grades]
    weight /= weight.sum()
    above = np.stack([grades >= k for k in range(1, n_grades)], 1).astype(float)
    state = [np.zeros(n_features + n_grades - 1) for _ in range(2)]
    for step in range(1, steps + 1):
        margin = np.bincount(rows, values * w[columns], n)
        t = b + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        p = 1 / (1 + np.exp(np.clip(t[None, :] - margin[:, None], -60, 60)))
        error = (p - above) * weight[:, None]
        back = error.sum(1)
        grad_w = np.bincount(columns, values * back[rows], n_features) + l2 * w
        per_t = -error.sum(0)
        grad_gaps = np.array([per_t[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))])
        grad = np.concatenate([grad_w, [per_t.sum()], grad_gaps])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad * grad
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w, b, gaps = w - move[:n_features], b - move[n_features], gaps - move[n_features + 1 :]
    return w, b + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def sampled(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``max_labels`` labelled documents, half
    of them toxic at most; a written table. Of rows of one id the smallest text counts."""
    clear = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .select("doc_id", "toxic")
    )
    some = [clear.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels // 2) for k in (0, 1)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = own.join(F.broadcast(some[0].unionAll(some[1])), "doc_id")
    return written(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")


def occurring(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, feature, count) of all features of texts, and the features' names."""
    rows, words, ids = letters(texts)
    index: dict[str, int] = {}
    names = features_of(words)
    of_word = np.array([k for k, own in enumerate(names) for _ in own], np.int64)
    feature = np.array([index.setdefault(x, len(index)) for own in names for x in own], np.int64)
    if not len(of_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    rows, feature = _hits(rows, ids, len(words), of_word, feature)
    keys, counts = np.unique(rows * len(index) + feature, return_counts=True)
    return keys // len(index), keys % len(index), counts, list(index)


def candidates(sample: DataFrame, n_toxic: int, n_clean: int, most: int = MAX_FEATURES) -> list[tuple[str, float]]:
    """The ``most`` strongest features of the sample with their log odds.

    Documents with each feature are counted where they lie; a feature speaks
    for toxicity where it is rare among clean documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            toxic = batch.column(0).to_numpy()
            rows, feature, _, names = occurring(texts_of(batch.column(1)))
            tox = np.bincount(feature, toxic[rows], len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(tox), pa.array(np.bincount(feature, minlength=len(names)) - tox)], ["feature", "tox", "clean"])

    counted = sample.select("toxic", "text").mapInArrow(run, "feature string, tox long, clean long")
    of = counted.groupBy("feature").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean")).where(F.col("tox") + F.col("clean") >= LEAST_DOCS)
    of = of.withColumn("odds", F.log((F.col("tox") + 0.1) / (n_toxic + 1)) - F.log((F.col("clean") + 0.1) / (n_clean + 1)))
    common = (F.col("odds") > 0) & (F.col("clean") * n_toxic > 0.2 * F.col("tox") * n_clean)
    weight = F.when(common, 0.0).when(F.col("odds") < 0, 0.1).otherwise(1.0)
    strong = of.withColumn("strength", weight * F.abs("odds") * F.sqrt(F.least(F.col("tox") + F.col("clean"), F.lit(50)))).where("strength > 0")
    return [(r["feature"], r["odds"]) for r in strong.orderBy(F.desc("strength"), "feature").limit(most).collect()]


def fit_model(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Fit on at most ``max_labels`` labelled documents: toxic ones are at most half.

    Texts stay on the executors. The driver gets the sample's counts of the
    chosen features: ``max_labels`` sparse rows of at most MAX_FEATURES entries.
    """
    sample = sampled(docs, labels, max_labels)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    chosen = candidates(sample, n[1], n[0]) if len(n) == 2 else []
    if not chosen:
        dropped(sample)
        return Model({}, ())
    place = {name: k for k, (name, _) in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, feature, counts, names = occurring(texts_of(batch.column(2)))
            at = np.array([place.get(x, -1) for x in names], np.int64)
            keep = at[feature] >= 0 if len(names) else np.zeros(0, bool)
            rows, column, counts = rows[keep], at[feature[keep]], counts[keep]
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (column, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "toxic", "features", "counts"])

    got = sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, features array<int>, counts array<int>").toArrow().sort_by("doc_id").combine_chunks()
    dropped(sample)
    toxic = got["toxic"].to_numpy() == 1
    rows = np.repeat(np.arange(len(toxic)), pc.list_value_length(got["features"]).to_numpy())
    columns, values = pc.list_flatten(got["features"]).to_numpy(), np.log1p(pc.list_flatten(got["counts"]).to_numpy())
    odds = np.array([x for _, x in chosen])
    mass = np.bincount(rows, np.maximum(odds, 0)[columns] * values, len(toxic))
    grades = toxic.astype(np.int64) + (toxic & (mass >= np.median(mass[toxic])))
    w, t = fit_ordinal(rows, columns, values, grades, len(chosen), int(grades.max()) + 1)
    return Model({name: float(x) for (name, _), x in zip(chosen, w) if abs(x) > 1e-3}, tuple(map(float, t)))


def score(docs: DataFrame, model: Model, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """Expected severity, grade and verdict of every document."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            margin = kept.value.margins(texts_of(batch.column(1)))
            severity = kept.value.severity(margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(kept.value.grade(margin), pa.int32()), pa.array(severity >= toxic_from)], ["doc_id", "severity", "grade", "toxic"])

    return shipped(docs).selectExpr("cast(doc_id as long) i", "cast(text as string) t").mapInArrow(run, SCORES)


def keep_clean(docs: DataFrame, model: Model, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            margin = kept.value.margins(texts_of(batch.column(at)))
            yield batch.filter(pa.array(kept.value.severity(margin) < toxic_from))

    return shipped(docs).mapInArrow(run, docs.schema)
