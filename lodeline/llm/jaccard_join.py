"""Size-aware heavy-light similarity join on sets of word shingles.

Two documents link when num / den of the union of their shingle sets is common
to both. Equal sets are one class, represented by its smallest doc_id; the
join runs over classes.

*Light* sets (up to a boundary size) enumerate subsets. Sets of sizes s and t
link only with o(s, t) = ceil(num (s + t) / (num + den)) common elements, and
then they have a subset of exactly that size in common; each light set emits a
hash of every such subset for each partner size it can have, and sets that meet
on a subset are linked to the smallest of them.

*Heavy* sets scan inverted lists. In any global order of the elements, linked
sets have a common element among their first s - ceil(num s / den) + 1. The
order here: elements of a hash range ``sampled`` come first, by their number of
sets and then by hash; the rest by hash. Counting covers the range alone, a
fixed share of the elements that is larger than the prefix, so that rare
elements fill the prefix and common passages never do. Light sets that a heavy
set can link with are in the lists too.

The *boundary* is chosen by cost: rows that enumeration emits against rows that
the lists take, from the counts of sets by size.

Lists do not emit all their pairs. First each list links its members to a hub
of like size; verified links give provisional components. Members of lists
that still have several components go through lists over all their elements,
where the position filter is at its sharpest: again hubs first, and then the
pairs across components that pass the length and position filters. Every
candidate pair is verified on the two texts.

Defined results: null or empty texts have an empty set and link with nothing
(component: the own id). Rows of one doc_id are one node, and each row reports
the size of its own set. A null doc_id takes no part in links and has a null
component. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import SLICE_BYTES, dropped, hash_words, shipped, slices, split_words, texts_of, without_ids, written
from lodeline.llm.components import components

#: Sizes up to which enumeration is ever considered.
MOST_LIGHT = 48
BLOOM_BITS = 1 << 23
#: Texts that are compared with one text in a task.
HUB_PAIRS = 2048

SIGNATURES = "doc_id long, n long, f1 long, f2 long, inner int, elements array<long>"


def ceil_share(num: int, den: int, s: int) -> int:
    return -(-num * s // den)


def common_needed(num: int, den: int, s: int, t: int) -> int:
    """Least intersection of sets of sizes s and t that link."""
    return -(-num * (s + t) // (num + den))


def partners(num: int, den: int, s: int) -> range:
    """Sizes that a set of size s can link with."""
    return range(ceil_share(num, den, s), den * s // num + 1)


def mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    rows, words, ids = split_words(texts)
    h = hash_words(words)[ids] if len(ids) else np.zeros(0, np.uint64)
    ends = np.searchsorted(rows, np.arange(len(texts)), "right")
    if len(h) >= n:
        rolled = mix(h[: len(h) - n + 1], 0)
        for k in range(1, n):
            rolled = mix(rolled + h[k : len(h) - n + 1 + k], k)
    start = 0
    for end in ends:
        if end - start >= n:
            yield np.unique(rolled[start : end - n + 1])
        elif end > start:
            own = np.uint64([end - start])
            for k, x in enumerate(h[start:end]):
                own = mix(own + x, 16 + k)
            yield own
        else:
            yield np.zeros(0, np.uint64)
        start = end


def signatures(docs: DataFrame, n: int, num: int, den: int, sampled: float) -> DataFrame:
    """Per row: set size, fingerprint and the elements that its prefix can have.

    ``elements`` are the set's elements below the range's bound; ``inner`` of
    them. Where these are fewer than the prefix, the next ones by hash follow.
    Small sets keep all elements, which enumeration needs.
    """
    bound = np.uint64(min(int(sampled * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            size, f1, f2, inner, kept = [], [], [], [], []
            for s in shingle_sets(texts_of(batch.column(1)), n):
                size.append(len(s))
                f1.append(int(np.bitwise_xor.reduce(mix(s, 40))) if len(s) else 0)
                f2.append(int(mix(s, 41).sum(dtype=np.uint64)) if len(s) else 0)
                low = int(np.searchsorted(s, bound))
                prefix = len(s) - ceil_share(num, den, len(s)) + 1
                inner.append(low)
                kept.append(s if len(s) <= MOST_LIGHT else s[: max(low, prefix)])
            lengths = np.array([len(k) for k in kept], np.int32)
            flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            elements = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), signed(f1), signed(f2), pa.array(inner, pa.int32()), elements], ["doc_id", "n", "f1", "f2", "inner", "elements"])

    return shipped(docs).selectExpr("cast(doc_id as long) i", "cast(text as string) t").mapInArrow(run, SIGNATURES)


def subset_rows(num: int, den: int, s: int) -> int:
    """Subsets that a set of size s emits for partners of all sizes."""
    return sum(math.comb(s, o) for t in partners(num, den, s) if (o := common_needed(num, den, s, t)) <= s and (s, t) != (o, o))


def boundary(sizes: dict[int, int], num: int, den: int, sampled: float) -> int:
    """The size up to which sets enumerate subsets, by least cost in rows."""
    best, at, cost = 0.0, 0, 0.0
    for s in range(1, MOST_LIGHT + 1):
        listed = max(sampled * s, s - ceil_share(num, den, s) + 1) * 3  # counted, joined and listed
        cost += sizes.get(s, 0) * (subset_rows(num, den, s) - listed)
        if cost <= best:
            best, at = cost, s
    return at


def subset_keys(elements: np.ndarray, num: int, den: int, most: int) -> Iterator[tuple[int, int]]:
    """(key, side) of the subsets of one light set; sides tell the smaller size
    of a pair from the larger, equal sizes have side 0."""
    s = len(elements)
    mixed = [int(x) for x in mix(elements, 50)]
    total = sum(mixed)
    for t in partners(num, den, s):
        o = common_needed(num, den, s, t)
        if t > most or o > s or o > t or (s == t == o):
            continue
        small, large = min(s, t), max(s, t)
        tag = (small << 48) ^ (large << 32) ^ 0x9E3779B97F4A7C15
        for left_out in combinations(mixed, s - o):
            x = (total - sum(left_out) + tag * 0xD6E8FEB86659FD93) & (2**64 - 1)
            yield (x if x < 2**63 else x - 2**64), (0 if s == t else 1 if s < t else 2)


def light_links(reps: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Candidate links of light sets: subset groups tied to their smallest members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sides = [], [], []
            for doc, elements in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, side in subset_keys(np.array(elements, np.int64).view(np.uint64), num, den, most):
                    ids.append(doc), keys.append(key), sides.append(side)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sides, pa.int8())], ["rep", "key", "side"])

    rows = reps.where(F.col("n") <= most).select("rep", "elements").mapInArrow(run, "rep long, key long, side byte")
    # Members of side 1 tie to the least of side 2 and the other way round; within side 0 all have the subset in common.
    low = rows.groupBy("key").agg(*(F.min(F.when(F.col("side") == k, F.col("rep"))).alias(f"m{k}") for k in (0, 1, 2)), F.count("*").alias("size"))
    low = low.where("size > 1 AND (m0 IS NOT NULL OR (m1 IS NOT NULL AND m2 IS NOT NULL))").drop("size")
    hub = F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    return rows.join(low, "key").select(F.col("rep").alias("a"), hub.alias("b")).where("a <> b")


def needed(num: int, den: int, s: str, t: str) -> str:
    """``common_needed`` as SQL."""
    return f"(({num} * ({s} + {t}) + {num + den - 1}) div {num + den})"


def listed(reps: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """(element, rep, n, pos): the prefixes of heavy sets and of light ones that
    a heavy set can link with, without elements of one set only. ``pos`` is the
    element's place in the set by the global order."""
    least = ceil_share(num, den, most + 1)
    own = reps.where(F.col("n") >= least)
    prefix = f"cast(n - ((n * {num} + {den} - 1) div {den}) + 1 as int)"
    rows = own.select("rep", "n", "inner", F.posexplode(F.expr(f"slice(elements, 1, greatest(inner, {prefix}))")).alias("at", "element"))
    rows = rows.withColumn("outer", F.col("at") >= F.col("inner"))
    shared = rows.groupBy("element").agg(F.count("*").alias("sets")).where("sets > 1")
    found = rows.join(shared, "element")
    # Elements of one set are first in the order; what they leave of the prefix goes to the rarest of the others.
    per_rep = found.groupBy("rep", "n", "inner").agg(F.sort_array(F.collect_list(F.when(~F.col("outer"), F.struct("sets", "element")))).alias("own"), F.collect_list(F.when(F.col("outer"), F.struct("element", F.col("at").alias("pos")))).alias("rest"))
    placed = F.expr("transform(own, (x, i) -> struct(x.element as element, cast(inner - size(own) + i as int) as pos))")
    out = per_rep.select("rep", "n", F.inline(F.concat(placed, F.col("rest"))))
    return out.where(f"pos < {prefix}").select("element", "rep", "n", "pos")


def hub_links(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Each member of a list with the list's hub among members of like size: the
    one where the fewest rare elements come before."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num))) if num < den else F.col("n")
    rows = lists.withColumn("band", band.cast("int"))
    low = rows.groupBy("element", "band").agg(F.min(F.struct("pos", F.col("rep").alias("b"), F.col("n").alias("n_b"))).alias("hub"), F.count("*").alias("m")).where("m > 1").select("element", "band", "hub.b", "hub.n_b", F.col("hub.pos").alias("pos_b"))
    fits = f"rep <> b AND n * {num} <= n_b * {den} AND n_b * {num} <= n * {den} AND least(n - pos, n_b - pos_b) >= {needed(num, den, 'n', 'n_b')}"
    return rows.join(low, ["element", "band"]).where(fits).select(F.col("rep").alias("a"), "b").distinct()


def labelled(lists: DataFrame, of: DataFrame) -> DataFrame:
    """Lists with the provisional component ``c`` of each member."""
    return lists.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("element", "rep", "n", "pos", F.coalesce("component", "rep").alias("c"))


def spread_elements(rows: DataFrame) -> DataFrame:
    """Elements whose members lie in several components."""
    return rows.groupBy("element").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("element")


def unsettled(lists: DataFrame, of: DataFrame) -> DataFrame:
    """Ids of members of lists with several components."""
    rows = labelled(lists, of)
    return rows.join(spread_elements(rows), "element", "left_semi").select(F.col("rep").alias("doc_id")).distinct()


def across_components(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (a, b) in order, without those of one component."""
    a, b = (of.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    named = pairs.join(a, "a", "left").join(b, "b", "left")
    apart = named.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
    return apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def across_rows(lists: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of lists whose members lie in different provisional components; a written table."""
    rows = labelled(lists, of)
    return written(rows.join(spread_elements(rows), "element"), "across")


def across_links(rows: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Pairs of a list, from ``across_rows``, in different components.

    A linked pair has a first common element, and what follows it in both sets
    must hold the common elements needed (position filter). The smaller set of
    a pair has that element early: only few members can take this part. Both
    tests run on summaries by component and size before members are paired, so
    that a component with many members in a list costs one row for each size.
    """
    early = f"n - pos >= {needed(num, den, 'n', 'n')}"
    larger = rows.groupBy("element", "c", "n").agg(F.min("pos").alias("pos")).select("element", F.col("c").alias("c_1"), F.col("n").alias("n_1"), F.col("pos").alias("pos_1"))
    smaller = rows.where(early).groupBy("element", "c", "n").agg(F.min("pos").alias("pos")).select("element", F.col("c").alias("c_2"), F.col("n").alias("n_2"), F.col("pos").alias("pos_2"))
    fits = f"c_1 <> c_2 AND n_2 <= n_1 AND n_1 * {num} <= n_2 * {den} AND n_1 > {most} AND least(n_1 - pos_1, n_2 - pos_2) >= {needed(num, den, 'n_1', 'n_2')}"
    keys = larger.join(smaller, "element").where(fits).select("element", "c_1", "n_1", "c_2", "n_2")
    a, b = (rows.select("element", F.col("c").alias(f"c_{k}"), F.col("n").alias(f"n_{k}"), F.col("rep").alias(f"rep_{k}"), F.col("pos").alias(f"pos_{k}")) for k in (1, 2))
    both = keys.join(a, ["element", "c_1", "n_1"]).join(b, ["element", "c_2", "n_2"]).where(fits)
    return both.select(F.greatest("rep_1", "rep_2").alias("a"), F.least("rep_1", "rep_2").alias("b")).distinct()


def _bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A bit table of fixed size with the ids' hashes set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            at = mix(batch.column(0).to_numpy().view(np.uint64), 60) & np.uint64(BLOOM_BITS - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in ids.select(column).coalesce(8).mapInArrow(run, "bits binary").collect():  # at most eight tables of a fixed size
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def texts_with(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """(doc_id, text) of the documents in ``ids`` (doc_id), a written table. The
    bit table keeps most other texts out of the exchange."""
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(ids, "doc_id"))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = mix(doc.view(np.uint64), 60) & np.uint64(BLOOM_BITS - 1)
            yield batch.filter(pa.array((bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1, pa.uint8()).cast(pa.bool_()))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return written(own.mapInArrow(maybe, "doc_id long, text string").join(ids, "doc_id", "left_semi"), f"{label}-texts")


def verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int, label: str) -> DataFrame:
    """The pairs (a, b) whose texts link; a written table."""
    pairs = written(pairs, f"{label}-pairs")
    texts = texts_with(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step := max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))):
                batch = whole.slice(start, step)
                sets = list(shingle_sets(pa.concat_arrays([texts_of(batch.column(2)), texts_of(batch.column(3))]), n))
                half, ok = len(sets) // 2, []
                for x, y in zip(sets[:half], sets[half:]):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # The texts that are compared with a hub's go to several tasks, each of which gets the hub's text.
    # Written, so that its size is known before texts are exchanged for it.
    hubs = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts")).where("parts > 1"), f"{label}-hubs")
    dealt = pairs.join(hubs, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    right = right.join(hubs, "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = dealt.join(left, "a").join(right, ["b", "part"]).select("a", "b", "text_a", "text_b")
    out = written(both.mapInArrow(run, "a long, b long"), f"{label}-links")
    dropped(pairs, texts, hubs)
    return out


def similar_groups(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, sampled: float | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    prefix = (den - num) / den
    sampled = min(1.0, 1.5 * prefix + 0.005) if sampled is None else sampled
    marks = written(signatures(docs, n, num, den, sampled), "signatures")
    filled = marks.where("doc_id IS NOT NULL AND n > 0")
    classes = written(filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes.withColumnsRenamed({"f1": "g1", "f2": "g2", "rep": "r"}), F.expr("f1 = g1 AND f2 = g2 AND doc_id = r")).select(F.col("doc_id").alias("rep"), "n", "f1", "f2", "inner", "elements")
    reps = reps.dropDuplicates(["rep", "f1", "f2"])
    sizes = {r["n"]: r["count"] for r in marks.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").count().collect()}
    most = boundary(sizes, num, den, sampled)

    lists = written(listed(reps, num, den, most).distinct(), "lists")
    first = hub_links(lists, num, den)
    if most:
        first = first.unionAll(light_links(reps, num, den, most))
    near = verified(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), docs, n, num, den, "near")
    provisional = components(near, "provisional")
    rest = texts_with(docs, unsettled(lists, provisional), "rest")
    whole = signatures(rest, n, num, den, 1.0).where("n > 0").select(F.col("doc_id").alias("rep"), "n", "inner", "elements")
    finer = written(listed(whole, num, den, most).distinct(), "finer")
    again = across_components(hub_links(finer, num, den), provisional)
    near = near.unionAll(verified(again, docs, n, num, den, "again"))
    provisional = components(near, "provisional")
    spread = across_rows(finer, provisional)
    far = verified(across_links(spread, num, den, most), docs, n, num, den, "far")
    dropped(lists, rest, finer, spread)

    # Rows of one id in several classes tie these classes.
    of = filled.select("doc_id", "f1", "f2").join(classes, ["f1", "f2"]).select("doc_id", "rep")
    several = of.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b < most").drop("most")
    tied = of.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    final = components(near.unionAll(far).unionAll(tied), "final")
    by_class = classes.join(final, classes["rep"] == final["node"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    # A node's component is the smallest representative; representatives are the smallest ids of their classes.
    out = marks.drop("elements", "inner").join(by_class, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Of each group the document with the smallest id, all columns; documents
    without a group stay. Rows of one id are one document, so they stay or go
    together; rows without an id stay."""
    groups = similar_groups(docs, n, num, den)
    return without_ids(docs, written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "lost"))
