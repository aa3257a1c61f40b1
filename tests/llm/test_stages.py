"""Pipeline stages on odd rows: nulls, blanks, very long texts, repeats, empty tables, clashing names."""

import collections

import pytest
from pyspark.sql import functions as F
from test_operators import CLASH, ODD, brute_statistics, check_sequences

import corpus_pipeline
from lodeline.llm import common, decontamination, sharding

NAMES = [name for name, _ in corpus_pipeline.STAGES]
STAGES = dict(corpus_pipeline.STAGES)
GOOD = " ".join(f"plain{k} words{k} of{k} a{k} clean{k} text{k}" for k in range(40))


@pytest.fixture(scope="module")
def rows():
    item = "one two three four five six seven eight nine ten eleven twelve"
    more = [(20, GOOD), (21, GOOD), (21, GOOD), (22, GOOD + " and one more end"), (23, f"{GOOD} {item}"), (None, GOOD), (None, GOOD)]
    return ODD + more, item


@pytest.fixture(scope="module")
def tables(spark, data, rows, tmp_path_factory):
    """A folder of the odd documents, the given labels and a benchmark with null and empty items."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd = spark.createDataFrame([(d, t, "x", "y", 1, 2, 3, "z", 4, 5, 6, 7, "s") for d, t in rows[0]], CLASH + ", lost_id long, leak_id long, _table_slot int, statistics string")
    odd.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, rows[1]), (2, None), (3, ""), (None, "an item without an id of its own")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def kept(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = STAGES[name](spark, docs, tables)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    return collections.Counter((r["doc_id"], r["text"]) for r in out.collect())


def test_order():
    assert NAMES == ["toxicity", "quality_rules", "jaccard_join", "decontamination", "packing"]


def test_toxicity_without_usable_labels_keeps_all(spark, tables, rows):
    # The labels are of other documents, or of rows without a text: nothing toxic to learn from.
    assert kept(spark, tables, "toxicity") == collections.Counter(rows[0])


def test_quality_rules_judge_each_row(spark, tables, rows):
    got = kept(spark, tables, "quality_rules")
    for d, t in rows[0]:
        n, *_, repeated = brute_statistics(t)  # the labels are of other texts, so only the base decides
        assert got[d, t] == (0 if n < 10 or 100 * repeated > 20 * n else rows[0].count((d, t))), d


def test_jaccard_join_keeps_one_of_each_group(spark, tables, rows):
    got = kept(spark, tables, "jaccard_join")
    lost = {d for d, _ in rows[0]} - {d for d, _ in got}
    assert lost == {9, 21, 22, 23}
    assert all(n == rows[0].count(x) for x, n in got.items())


def test_decontamination_removes_the_copy(spark, tables, rows):
    assert kept(spark, tables, "decontamination") == collections.Counter(x for x in rows[0] if x[0] != 23)


def test_packing_takes_every_row(spark, tables, rows):
    packed = STAGES["packing"](spark, spark.read.parquet(f"{tables}/documents.parquet"), tables).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows[0])
    check_sequences(packed)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    assert STAGES[name](spark, docs, tables).count() == 0


def test_run_on_odd_tables(spark, tables):
    check_sequences(corpus_pipeline.run(spark, tables).collect())


def test_placement_beside_clashing_names(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumnRenamed("leak_id", "table_slot").withColumnRenamed("lost_id", "table_shard")
    out = sharding.place(docs, ["a", "b", "c"], slots=101)
    assert out.columns == [*docs.columns, "slot", "shard"] and out.count() == docs.count()
    assert {r["shard"] for r in out.collect()} <= {0, 1, 2}


def test_rows_without_an_id_stay_apart(spark):
    docs = spark.range(100_000).selectExpr("CASE WHEN id < 10 THEN id END AS doc_id", "'x' AS text", "id AS lost_id").repartition(8)
    ids = spark.range(3).withColumnRenamed("id", "doc_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = common.without_ids(docs, ids)
        assert out.count() == 99_997 and out.columns == docs.columns
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_benchmark_blocks_go_by_words_and_bytes(spark, monkeypatch):
    """Tabs between words, words of many bytes, and repeated rows."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 1000)
    seen = []
    monkeypatch.setattr(decontamination, "_matches", lambda docs, queries, *_: seen.append(sum(len(i.ids) for i in queries.items)) or spark.createDataFrame([], decontamination.MATCHES))
    docs = spark.createDataFrame([(1, GOOD)], "doc_id long, text string")
    items = [(k, "\t".join(f"w{k}x{i}" for i in range(100))) for k in range(60)] * 3
    decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).count()
    assert len(seen) == 6 and sum(seen) == 6000 and max(seen) < 3000
    seen.clear()
    decontamination.contaminated(docs, spark.createDataFrame([(k, "é" * 4000 + " " + "b " * 8) for k in range(20)], "item_id long, text string")).count()
    assert len(seen) >= 10
