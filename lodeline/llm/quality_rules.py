"""Quality rules as a learned decision list, in Spark expressions only.

Statistics of a text are plain SQL expressions over its word array. From the
statistics of labelled documents, sequential covering grows one conjunction of
threshold tests at a time (FOIL gain on a growing set), prunes it on a held-out
set, and keeps it while it stays precise; documents it covers leave the set.
The ordered rules become one ``CASE WHEN`` expression. No Python runs on the
executors.

The fit takes at most ``max_labels`` labelled documents, those with the
smallest hash of the id, a documented bound; statistics and verdicts cover all
documents and whole texts.

Words are ``[^\\x20\\x09-\\x0D]+``. Windows of five words are compared by 64-bit
hashes within one text.

A text of many words does not fit one expression, which holds all of them at
once. Such texts are cut at white space into rows, their windows, words and
lines are counted by exchanges, and the counts join the rows by the text's
digest. Tables without such texts have neither exchange nor join.

Defined results: a null text counts as empty (no words, base failed). Without
usable labels the list is empty and only the base decides. A document with
contradicting labels is not used for the fit. Repeated rows and null ids pass
through, each row judged by its own text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.common import free_name, written

# The characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r"

#: White space in a text, or its bytes, beyond which it is cut; bytes of a piece, more where a word or line is longer.
LONG_SPACES, LONG_BYTES, PIECE = 1 << 20, 16 << 20, 1 << 20

MAX_LABELS = 20_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_exclaims", "n_digits")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """The text with all white space as blanks."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(spaced(text), " "), "")


def occurrences(text: Column, chars: str) -> Column:
    """How often any of ``chars`` occurs."""
    bare = text
    for c in chars:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(bare)).cast("long")


def repeated_words(of: Column, size: int = 5) -> Column:
    """Words that lie in a window of ``size`` words found at least twice."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spots(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < last) & (s[F.least(j + 1, last)]["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.zip_with(F.slice(at, 2, F.size(at) - 1), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(size)))
            return F.aggregate(gaps, F.lit(size).cast("long"), lambda sum_, x: sum_ + x)

        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, let(let(pairs, spots), total)).otherwise(F.lit(0).cast("long"))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(h[i + k] for k in range(size))))

    hashed = let(F.transform(of, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))
    return F.when(F.size(of) > size, hashed).otherwise(F.lit(0).cast("long"))


def filled_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" " + SPACES)) != "")


def duplicate_lines(text: Column) -> tuple[Column, Column]:
    """(lines with a word, those of them that equal an earlier one)."""
    both = let(filled_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return both["n"], both["dup"]


def statistics(text: Column) -> Column:
    """A struct of the counts of one text (COUNTS)."""

    def of(w: Column) -> Column:
        lines, dup = duplicate_lines(text)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            occurrences(text, SYMBOLS).alias("n_symbols"),
            dup.alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            lines.alias("n_lines"),
            occurrences(text, "!").alias("n_exclaims"),
            occurrences(text, "0123456789").alias("n_digits"),
        )

    return let(words(text), of)


def text_of(docs: DataFrame) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def is_long(text: Column) -> Column:
    """Whether the words of a text are too many for one expression."""
    size = F.octet_length(text)
    return F.when(size <= LONG_SPACES, False).when(size > LONG_BYTES, True).otherwise(occurrences(text, " " + SPACES) > LONG_SPACES)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_key(text: Column) -> Column:
    """60 bits of the text's digest: long texts are few."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def pieces(longs: DataFrame, text: Column, mark: str) -> DataFrame:
    """(key, piece, part): texts cut before the first ``mark`` of each PIECE
    bytes, so that nothing between two marks is cut. Offsets are of bytes, which
    are reached at once; no byte of a longer character is a mark's."""

    def cut(b: Column) -> Column:
        size = F.octet_length(b)
        head = lambda i: F.octet_length(F.substring_index(b.substr(i * PIECE + 1, F.lit(PIECE)).cast("string"), mark, 1))
        found = lambda i: let(head(i), lambda n: F.when(n < F.least(F.lit(PIECE), size - i * PIECE), i * PIECE + n))
        at = F.transform(F.sequence(F.lit(0), F.floor(size / PIECE).cast("int")), lambda i: F.when(i == 0, 0).otherwise(found(i)))
        part = lambda at: F.transform(at, lambda x, i: b.substr(x + 1, F.coalesce(F.get(at, i + 1), size) - x).cast("string"))
        return let(F.filter(at, lambda x: x.isNotNull()), part)

    return longs.select(text_key(text_of(longs)).alias("key"), F.posexplode_outer(let(text.cast("binary"), cut)).alias("piece", "part"))


def repeated_of_pieces(hashed: DataFrame, size: int = 5) -> DataFrame:
    """(key, n_repeat_words) from (key, piece, n, hashes): the words' hashes of
    each piece that has words. Texts without repeats are left out."""
    order = Window.partitionBy("key").orderBy("piece")
    after = F.flatten(F.collect_list(F.slice("hashes", 1, size - 1)).over(order.rowsBetween(1, size - 1)))
    whole = hashed.select("key", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.concat("hashes", F.slice(after, 1, size - 1)).alias("h"))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    rows = whole.where(F.size("h") >= size).select("key", "before", F.posexplode_outer(let(F.col("h"), windows)).alias("i", "window")).select("key", "window", (F.col("before") + F.col("i")).alias("start"))
    alike = Window.partitionBy("key", "window").orderBy("start")
    twice = rows.select("key", "start", (F.lag("start").over(alike).isNotNull() | F.lead("start").over(alike).isNotNull()).alias("twice")).where("twice")
    gap = F.lead("start").over(Window.partitionBy("key").orderBy("start")) - F.col("start")
    spots = twice.select("key", F.least(gap, F.lit(size)).alias("gap"))  # least() skips the last one's null
    return spots.groupBy("key").agg(F.sum("gap").alias("n_repeat_words"))


def long_statistics(longs: DataFrame) -> DataFrame | None:
    """(key, s) for each different text of ``longs``, equal to ``statistics``;
    None if there is none. Pieces, not texts, are what a task holds."""
    chars = {"n_symbols": SYMBOLS, "n_exclaims": "!", "n_digits": "0123456789"}

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            *(occurrences(F.col("part"), c).alias(name) for name, c in chars.items()),
            F.transform(w, lambda x: F.xxhash64(x)).alias("hashes"),
            F.transform(F.array_distinct(w), digest).alias("distinct"),
        )

    parts = pieces(longs, spaced(text_of(longs)), " ").dropDuplicates(["key", "piece"])
    split = written(parts.select("key", "piece", let(F.array_remove(F.split("part", " "), ""), of).alias("w")), "long-words")
    if not split.limit(1).count():
        return None
    counts = split.groupBy("key").agg(F.sum("w.n").alias("n_words"), F.sum("w.chars").alias("word_chars"), *(F.sum(f"w.{name}").alias(name) for name in chars))
    different = split.select("key", F.explode("w.distinct").alias("word")).distinct().groupBy("key").agg(F.count("*").alias("n_distinct_words"))
    repeats = repeated_of_pieces(split.select("key", "piece", "w.n", "w.hashes").where("n > 0"))
    lines = pieces(longs, text_of(longs), "\n").select("key", "piece", F.transform(filled_lines(F.col("part")), digest).alias("lines")).dropDuplicates(["key", "piece"])
    lines = lines.select("key", F.explode_outer("lines").alias("line")).where("line IS NOT NULL").groupBy("key", "line").agg(F.count("*").alias("times"))
    lines = lines.groupBy("key").agg(F.sum("times").alias("n_lines"), F.sum(F.col("times") - 1).alias("n_dup_lines"))
    every = counts
    for some in (different, repeats, lines):
        every = every.join(some, "key", "left")
    return written(every.select("key", F.struct(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS)).alias("s")), "long-statistics")


def measured(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the statistics of each text as a column ``name``."""
    text = text_of(docs)
    longs = docs.where(is_long(text))
    found = long_statistics(longs)
    if found is None:
        return docs.withColumn(name, statistics(text))
    short = F.when(is_long(text), "").otherwise(text)  # a filter on the statistics may run before or with that on the length
    key = free_name(docs, "text_key")
    joined = longs.withColumn(key, text_key(text)).join(F.broadcast(found.toDF(key + "_of", name)), F.col(key) == F.col(key + "_of"))
    return docs.where(~is_long(text)).withColumn(name, statistics(short)).unionAll(joined.select(*docs.columns, name))


#: Name, numerator and denominator of each ratio that rules may test.
RATIOS = (
    ("chars_per_word", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("exclaims_per_word", "n_exclaims", "n_words"),
    ("digits_per_word", "n_digits", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_word_share", "n_repeat_words", "n_words"),
    ("distinct_word_share", "n_distinct_words", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
)
FEATURES = ("n_words", *(name for name, _, _ in RATIOS))


def feature(name: str, s: Column) -> Column:
    if name == "n_words":
        return s["n_words"].cast("double")
    _, a, b = next(r for r in RATIOS if r[0] == name)
    return F.coalesce(F.try_divide(s[a].cast("double"), s[b].cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: Sequence[float]) -> bool:
        x = row[FEATURES.index(self.feature)]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, s: Column) -> Column:
        x = feature(self.feature, s)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def covers(self, row: Sequence[float]) -> bool:
        return all(t.holds(row) for t in self.tests)

    def column(self, s: Column) -> Column:
        out = self.tests[0].column(s)
        for t in self.tests[1:]:
            out &= t.column(s)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _cuts(values: list[float], most: int = 48) -> list[float]:
    """Midpoints between neighbouring distinct values, thinned to quantiles."""
    distinct = sorted(set(values))
    mids = [(a + b) / 2 for a, b in zip(distinct, distinct[1:])]
    return mids if len(mids) <= most else [mids[len(mids) * i // most] for i in range(most)]


def _grow(rows: list[Sequence[float]], bad: list[bool], most_tests: int) -> list[Test]:
    tests: list[Test] = []
    live = list(range(len(rows)))
    while len(tests) < most_tests:
        p, n = sum(bad[i] for i in live), len(live)
        if p == n or not p:
            break
        base, best = math.log2(p / n), (0.0, None)
        for k, name in enumerate(FEATURES):
            order = sorted(live, key=lambda i: rows[i][k])
            values = [rows[i][k] for i in order]
            cuts, j, pj = _cuts(values), 0, 0
            for cut in cuts:
                while j < n and values[j] <= cut:
                    pj += bad[order[j]]
                    j += 1
                for above, q, m in ((False, pj, j), (True, p - pj, n - j)):
                    if q and (gain := q * (math.log2(q / m) - base)) > best[0] + 1e-9:
                        best = (gain, Test(name, above, cut))
        if best[1] is None:
            break
        tests.append(best[1])
        live = [i for i in live if best[1].holds(rows[i])]
    return tests


def _precision(tests: Sequence[Test], rows: list[Sequence[float]], bad: list[bool]) -> tuple[int, int]:
    hit = [b for r, b in zip(rows, bad) if all(t.holds(r) for t in tests)]
    return sum(hit), len(hit)


def learn(rows: list[Sequence[float]], bad: list[bool], *, most_rules: int = 12, most_tests: int = 4, least_precision: float = 0.9, least_hits: int = 3) -> list[Rule]:
    """Sequential covering: ordered rules for the bad class. Every third row is for pruning."""
    rules: list[Rule] = []
    live = list(range(len(rows)))
    while len(rules) < most_rules:
        grow, prune = [i for k, i in enumerate(live) if k % 3], [i for k, i in enumerate(live) if k % 3 == 0]
        if not any(bad[i] for i in grow):
            break
        tests = _grow([rows[i] for i in grow], [bad[i] for i in grow], most_tests)
        if not tests:
            break
        held = [rows[i] for i in prune], [bad[i] for i in prune]

        def worth(some: list[Test]) -> float:
            p, n = _precision(some, *held)
            return (p + 1) / (n + 2) + p / (10 * len(held[0]) + 1)

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        p, n = _precision(tests, *held)
        q, m = _precision(tests, [rows[i] for i in live], [bad[i] for i in live])
        if q < least_hits or q < least_precision * m or (n and p < least_precision * n):
            break
        rules.append(Rule(tuple(tests)))
        live = [i for i in live if not rules[-1].covers(rows[i])]
    return rules


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def fit_rules(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[Rule]:
    """Rules for low quality from at most ``max_labels`` labelled documents."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labels)
    )
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(usable.select("doc_id", "quality")), "doc_id")
    found = (
        measured(labelled, "s")
        .select("doc_id", "quality", base_failed(F.col("s")).alias("failed"), *(feature(f, F.col("s")).alias(f) for f in FEATURES))
        .dropDuplicates(["doc_id"])  # a filter on statistics here would run below the join, on every document
        .collect()
    )
    found = sorted((r for r in found if not r["failed"]), key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"]))
    return learn([tuple(r)[3:] for r in found], [r["quality"] == 0 for r in found])


def verdict(s: Column, rules: Sequence[Rule]) -> Column:
    """The number of the first rule that rejects, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(s), k) if out is None else out.when(rule.column(s), k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Statistics and verdict per document: one pass, no shuffle but for texts that are cut."""
    s = F.col("s")
    judged = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "s")
    return judged.select(
        "doc_id",
        *(s[c].alias(c) for c in COUNTS[:5]),
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & (verdict(s, rules) == 0)).alias("kept"),
        verdict(s, rules).alias("rule"),
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows of ``docs`` that the base and the rules keep, all columns."""
    name = free_name(docs, "statistics")
    s = F.col(name)
    out = measured(docs, name)
    return out.where(~base_failed(s) & (verdict(s, rules) == 0)).drop(name)
