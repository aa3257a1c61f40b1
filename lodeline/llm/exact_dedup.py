"""Exact duplicates by radix partitioning from the most significant byte.

Documents are split by successive bytes of their texts until a group is a
singleton or its texts have ended; equality needs no digest. The number of
bytes comes before the text, so texts of one group all end together. A level
takes a run of bytes: 64 first, then 4 KB, then eight times as many each time,
up to 4 MB. The first level counts, without whole texts, how many documents
begin alike; those that are alone are done, and later levels send only the
bytes of groups that are still together. To find them, texts are exchanged only
where a broadcast bit table has their beginning, which is exact for "alone"; the
others are looked up in the counts.

A group is named by the row that would stay if it ended there: the largest
doc_id, then the largest row number. Hot groups are split: beginnings that a
thousandth of all rows have (a thousand at most) are broadcast, so their rows
stay where they are; later, each task's rows of a group are first summed to one
row, and the name goes back to the rows task by task. No task gets all rows of
a group, however many copies a text has. Levels are written tables, so a lost
executor costs a part of one level.

Defined results: null texts are empty, and empty texts are copies of each
other. Rows without an id are documents too; one stays only in a group where
no row has an id (``keep_id`` is then null). Of rows with the same largest id
and text one stays, whichever has the largest row number. An empty table gives
an empty result. Extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import dropped, free_name, written

# Bytes of the first level, of the second, and at most of the others.
FIRST, SECOND, MOST = 64, 4 << 10, 4 << 20
GROWTH = 8
#: Beginnings that more than one row in so many has are broadcast; there can't be more of them.
HOT = 1000
#: Bits of the table of beginnings that several texts have: 4 MB at most, broadcast.
MARKS = 1 << 25


def levels(longest: int) -> Iterator[tuple[int, int]]:
    """(start, width) of the levels after the first, for texts of at most ``longest`` bytes."""
    start, width = FIRST, SECOND
    yield start, width
    while start + width < longest:
        start, width = start + width, min(MOST, GROWTH * width)
        yield start, width


def measured(text: str) -> list[Column]:
    whole = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    return [F.octet_length(whole).cast("long").alias("n"), F.substring(whole, 1, FIRST).alias("head"), F.substring(whole, FIRST + 1, 2**31 - 1 - FIRST).alias("tail")]


def marked(docs: DataFrame, shared: DataFrame, n_rows: int) -> DataFrame:
    """``docs`` with ``marked``: whether a bit table has their beginnings. It holds
    the ``shared`` ones, in 16 bits for each of all rows, and MARKS bits at most:
    a bit that is set by chance only sends a text in vain."""
    spot = F.pmod(F.xxhash64("n", "head"), F.lit(min(MARKS, 1 << max(15, (16 * n_rows).bit_length()))))
    at = shared.select(spot.alias("spot")).select(F.bitmap_bucket_number("spot").alias("bucket"), F.bitmap_bit_position("spot").alias("at"))
    table = at.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    placed = docs.withColumn("spot", spot).join(F.broadcast(table), F.bitmap_bucket_number("spot") == F.col("bucket"), "left")
    place = F.bitmap_bit_position("spot").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.lit(1).cast("int").bitwiseAND(F.call_function("shiftright", byte, place.bitwiseAND(7)))
    return placed.withColumn("marked", F.coalesce(bit == 1, F.lit(False))).drop("spot", "bucket", "bits")


def opened(docs: DataFrame) -> DataFrame:
    """``docs`` (n, head, tail, ...) with the first level: ``alone`` says that no other text begins so."""
    counts = written(docs.groupBy("n", "head").agg(F.count("*").alias("n_rows")), "beginnings")
    n_rows = counts.agg(F.sum("n_rows")).first()[0] or 0
    shared = counts.where("n_rows > 1")
    names = {"n": "n_", "head": "head_"}
    same = (F.col("n") == F.col("n_")) & (F.col("head") == F.col("head_"))
    hot = F.broadcast(shared.where(F.col("n_rows") > n_rows / HOT).select("n", "head", F.lit(True).alias("hot")).withColumnsRenamed(names))
    cold = shared.where(F.col("n_rows") <= n_rows / HOT).select("n", "head").withColumnsRenamed(names)
    seen = marked(docs.join(hot, same, "left").drop("n_", "head_"), shared, n_rows)
    stay = seen.where("hot OR NOT marked").withColumn("alone", F.col("hot").isNull())
    rest = seen.where("hot IS NULL AND marked").join(cold, same, "left").withColumn("alone", F.col("n_").isNull()).drop("n_", "head_")
    return stay.unionByName(rest).drop("hot", "marked")


def split(rows: DataFrame, by: list[str], salt: Column) -> DataFrame:
    """``rows`` (row, doc_id, ...) with the name and size of their group by the
    columns ``by``; ``salt`` numbers the tasks that sum rows of a group first."""
    salted = rows.withColumn("salt", salt)
    own = salted.groupBy(*by, "salt").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n_rows"))
    whole = own.groupBy(*by).agg(F.max("keep").alias("keep"), F.sum("n_rows").alias("size"))
    named = own.select(*by, "salt").join(whole, by)
    return salted.join(named, [*by, "salt"]).drop("salt")


def groups_of(rows: DataFrame) -> DataFrame:
    """(row, keep, size) for each of ``rows`` (row, doc_id, n, head, tail), which
    have gone through the first level; keep is the (doc_id, row) that stays."""
    longest = rows.agg(F.max("n")).first()[0] or 0
    tasks = F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups, together = None, None
    for start, width in levels(longest):
        digit = F.substring("tail", start - FIRST + 1, width).alias("digit")
        if together is None:
            # The upper bits of a row number are the number of the task that gave it.
            found = split(rows.select("row", "doc_id", "n", "head", digit), ["n", "head", "digit"], F.shiftright("row", 33))
        else:
            level = written(together.join(rows.where(F.col("n") > start).select("row", digit), "row"), "level")
            # The join has brought the rows to the tasks of their hashes.
            found = split(level, ["group", "digit"], F.pmod(F.hash("row"), tasks))
        state = written(found.select("row", "doc_id", "n", "keep", "size"), "groups")
        if together is not None:
            dropped(level)
        settled = (F.col("size") == 1) | (F.col("n") <= start + width)
        now = state.where(settled).select("row", "keep", "size")
        groups = now if groups is None else groups.unionAll(now)
        together = state.where(~settled).select("row", "doc_id", "n", F.col("keep.row").alias("group"))
        if together.isEmpty():
            break
    return groups


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256
    (for readers: no comparison uses it)."""
    begun = opened(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), *measured(text)))
    light = ["doc_id", "n", "head", F.sha2(F.concat("head", "tail"), 256).alias("text_sha256"), F.when(~F.col("alone"), F.col("tail")).alias("tail"), "alone"]
    # Row numbers have to stay what they are, so they are written.
    rows = written(begun.select(F.monotonically_increasing_id().alias("row"), *light), "texts")
    single = rows.where("alone").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shared = rows.where("NOT alone")
    found = shared.select("row", "doc_id", "text_sha256").join(groups_of(shared), "row")
    return single.unionAll(found.select("doc_id", "keep.doc_id", "size", F.col("row") == F.col("keep.row"), "text_sha256"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    number = free_name(docs, "row_number")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    begun = opened(numbered.select(F.col(f"`{number}`").alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"), *measured(text)))
    shared = written(begun.where("NOT alone").drop("alone"), "texts")
    lost = groups_of(shared).where(F.col("row") != F.col("keep.row")).select(F.col("row").alias(number))
    return numbered.join(lost, number, "left_anti").drop(number)
