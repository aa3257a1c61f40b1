"""The corpus pipeline: toxicity, quality rules, near-duplicate groups,
benchmark decontamination and packing, each stage on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Between stages the rows are a written
table in the shared folder.

Defined results: extra columns stay, whatever their names. Null texts count as
empty: they are not toxic, fail the quality base (fewer than ten words), are
near copies of nothing and hold no benchmark item. Rows without an id are
judged by their text alone where a stage does so; they are in no group and
match no item by name, so they stay. Repeated rows stay or go together, since
they are one document. Empty tables give empty results, and without usable
labels or items nothing is rejected by what would be learned from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeline.llm.common import table, written
from lodeline.llm.decontamination import without_leaks
from lodeline.llm.jaccard_join import keep_one
from lodeline.llm.packing import pack_documents
from lodeline.llm.quality_rules import fit_rules, keep_good
from lodeline.llm.toxicity import fit_model, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low expected severity; the model is fitted on all labelled documents' sample."""
    return keep_clean(docs, fit_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return keep_good(docs, fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, n=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
