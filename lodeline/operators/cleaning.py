"""Audited cleaning and typing of raw tables.

One aggregate counts cells and tests what texts could be numbers, one more
counts dates where a name asks for them; the driver decides; the typed rows are
written once, with fingerprints, and whole rows are compared only where
fingerprints meet. So the source is parsed by two passes, three with dates, and
later work reads the written table. Rows keep the order of their source in a
hidden column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions.columns import ORDER, col, kinds, present, q, spark_names, unique_names, user_columns, with_order
from lodeline.operators.roles import detect_roles
from lodeline.operators.stats import kept as kept_table
from lodeline.plans.model import Audit, Roles

# Name parts that ask for dates or protect from numbers, and the shares that must parse.
DATE_PARTS = ("date", "time", "timestamp", "created", "updated")
PROTECTED_PARTS = ("id", "code", "zip", "postal", "phone")
DATE_SHARE, NUMBER_SHARE = 0.80, 0.95
OPERATIONS = ("Empty rows removed", "Empty columns removed", "Exported index columns removed", "Duplicate rows removed", "Numeric columns inferred", "Datetime columns inferred")
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity|INF|Inf|Infinity)$"
#: Formats in the order in which the first value of a column is tried.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd", "M/d/yyyy", "d/M/yyyy", "M/d/yyyy H:mm", "d/M/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "yyyyMMdd", "yyyy-MM", "M/d/yy",
)


def stripped(name: str) -> Column:
    """Without white space at the ends, blanks as NULL."""
    return F.nullif(F.regexp_replace(col(name), r"(?U)^\s+|\s+$", F.lit("")), F.lit(""))


def parsed_number(text: Column) -> Column:
    """NULL unless the text is a plain number. Spark alone would take 1d and 1f."""
    value = F.when(F.regexp_like(F.trim(text), F.lit(NUMBER)), F.trim(text)).try_cast("double")
    return F.when(~F.isnan(value), value)


def parsed_time(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def date_format(spark, sample: str | None) -> str | None:
    """The first known format that reads a sample."""
    if sample is None:
        return None
    # A row of literals is folded by the optimizer, so no job runs.
    tests = ", ".join(f"try_to_timestamp(:s, :f{k}) IS NOT NULL AS f{k}" for k in range(len(DATE_FORMATS)))
    row = spark.sql(f"SELECT {tests} FROM VALUES (1) AS one(x)", args={"s": sample} | {f"f{k}": f for k, f in enumerate(DATE_FORMATS)}).first()
    return next((f for f, ok in zip(DATE_FORMATS, row) if ok), None)


@dataclass(frozen=True)
class Inference:
    """What the text columns become."""

    times: dict[str, str]
    numbers: tuple[str, ...]


def counted(df: DataFrame, names: list[str]) -> Row:
    """One aggregate: rows, rows with a cell, present cells (c), and of texts
    values before stripping (n), numbers (v) and the first value of date-like ones (f)."""
    of, wanted = kinds(df), [F.count(F.lit(1)).alias("rows"), F.count_if(F.greatest(*(present(n, df).cast("int") for n in names), F.lit(0)) == 1).alias("filled")]
    for k, n in enumerate(names):
        wanted.append(F.count_if(present(n, df)).alias(f"c{k}"))
        if of[n] == "text":
            wanted.append(F.count(col(n)).alias(f"n{k}"))
            if is_open(n):
                wanted.append(F.count(parsed_number(stripped(n))).alias(f"v{k}"))
            if is_dated(n):
                wanted.append(F.min_by(stripped(n), F.when(stripped(n).isNotNull(), F.col(ORDER))).alias(f"f{k}"))
    return df.agg(*wanted).first()


def is_dated(name: str) -> bool:
    return any(p in name.lower() for p in DATE_PARTS)


def is_open(name: str) -> bool:
    return not any(p in name.lower() for p in PROTECTED_PARTS)


def infer(df: DataFrame, texts: list[str], counts: Row | None = None, numbered: list[str] | None = None) -> Inference:
    """What texts become, by the shares that parse. Shares are of the values
    present before stripping, so blanks count against. ``counts`` may hold what
    ``counted`` gives for the columns ``numbered``."""
    if counts is None:
        counts, numbered = counted(df, texts), texts
    place = {n: numbered.index(n) for n in texts}
    formats = {n: f for n, k in place.items() if is_dated(n) and (f := date_format(df.sparkSession, counts[f"f{k}"]))}
    parsed = df.agg(*(F.count(parsed_time(stripped(n), f)).alias(n) for n, f in formats.items())).first() if formats else ()
    share = lambda hits, n: counts[f"n{place[n]}"] and hits / counts[f"n{place[n]}"]
    times = {n: f for (n, f), hits in zip(formats.items(), parsed) if hits and share(hits, n) >= DATE_SHARE}
    return Inference(times, tuple(n for n, k in place.items() if is_open(n) and n not in times and (hits := counts[f"v{k}"]) and share(hits, n) >= NUMBER_SHARE))


def typed(df: DataFrame, texts: list[str], found: Inference) -> DataFrame:
    def of(n: str) -> Column:
        if n in found.times:
            return parsed_time(stripped(n), found.times[n]).alias(n)
        if n in found.numbers:
            return parsed_number(stripped(n)).alias(n)
        return (stripped(n) if n in texts else col(n)).alias(n)

    return df.select(*(of(n) for n in user_columns(df)), ORDER)


def positions(df: DataFrame) -> DataFrame:
    """Consecutive row numbers from 0 in source order, without one task for all:
    counts of partitions first, then places within each."""
    marked = df.withColumn("_part", F.spark_partition_id())
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"), F.min(ORDER).alias("_low"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(ORDER)) - 1
    return marked.join(F.broadcast(before), "_part").withColumn("_position", F.col("_before") + place).drop("_part", "_before")


def exported_indexes(df: DataFrame) -> list[str]:
    """Unnamed columns that count the rows from 0."""
    named = [c for c in user_columns(df) if c.lower().startswith("unnamed")]
    if not named:
        return []
    equal = positions(df).agg(*(F.bool_and(F.coalesce(F.col(q(c)).try_cast("double") == F.col("_position"), F.lit(False))).alias(f"e{k}") for k, c in enumerate(named))).first()
    return [c for k, c in enumerate(named) if equal[f"e{k}"]]


def clean(raw: DataFrame) -> tuple[DataFrame, Audit]:
    """Rename, drop what is empty, drop exported indexes, strip and type texts,
    drop repeated rows; with the audit of each step."""
    df = with_order(raw)
    labels = user_columns(df)
    names = spark_names(unique_names(labels))
    df = df.select(*(col(a).alias(b) for a, b in zip(labels, names)), ORDER)
    if not names:
        raise ValueError("The table has no columns to analyze.")
    counts = counted(df, names)
    if not counts["rows"]:
        raise ValueError("The table has no rows to analyze.")
    empty = [n for k, n in enumerate(names) if not counts[f"c{k}"]]
    kept = [n for n in names if n not in empty]
    if not kept:
        raise ValueError("Nothing is left to analyze after removing empty rows and columns.")
    filled = df.select(*map(col, kept), ORDER).where(F.greatest(*(present(n, df).cast("int") for n in kept), F.lit(0)) == 1)
    indexes = exported_indexes(filled)
    kept = [n for n in kept if n not in indexes]
    if not kept:
        raise ValueError("Nothing is left to analyze after removing empty rows and columns.")
    df = filled.select(*map(col, kept), ORDER)
    texts = [n for n, k in kinds(df).items() if k == "text"]
    found = infer(df, texts, counts, names)
    single, repeats = without_repeats(typed(df, texts, found), kept)
    done = dict(zip(OPERATIONS, (counts["rows"] - counts["filled"], len(empty), len(indexes), repeats, len(found.numbers), len(found.times))))
    return single, Audit((counts["rows"], len(names)), (counts["filled"] - repeats, len(kept)), done)


def without_repeats(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """The first in source order of equal rows, NULLs equal too, and how many went.

    Rows are written once, with two 64-bit hashes; only hashes are exchanged,
    and whole rows only where hashes of two rows meet.
    """
    same = [c + F.lit(0.0) if isinstance(rows.schema[n].dataType, (T.DoubleType, T.FloatType)) else c for n, c in ((n, col(n)) for n in columns)]  # both zeros are equal
    a, b = free_names(columns, 2)
    table = kept_table(rows.withColumns({a: F.xxhash64(*same), b: F.xxhash64(F.lit("b"), *same)}), "cleaned")
    met = table.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(a, b)
    if met.isEmpty():
        return table.drop(a, b), 0
    again = table.join(met, [a, b], "left_semi")
    first = again.groupBy(*map(col, columns)).agg(F.min(ORDER).alias(ORDER)).select(ORDER)
    lost = kept_table(again.select(ORDER).join(first, ORDER, "left_anti"), "repeats")
    return table.drop(a, b).join(lost, ORDER, "left_anti").select(*map(col, columns), ORDER), lost.count()


def free_names(taken: list[str], n: int) -> list[str]:
    lower, out, k = {t.lower() for t in taken}, [], 0
    while len(out) < n:
        if (name := f"_hash_{k}") not in lower:
            out.append(name)
        k += 1
    return out


def audit_frame(df: DataFrame, audit: Audit) -> DataFrame:
    return df.sparkSession.createDataFrame(list(audit.operations.items()), "operation string, count long")


@dataclass(frozen=True)
class Prepared:
    table: DataFrame
    audit: Audit
    roles: Roles
    truncated_rows: int

    def analyze(self, roles: Roles | None = None):
        from lodeline.operators.evidence import analyze

        return analyze(self.table, roles or self.roles)

    def release(self) -> None:
        """Let go of the cached table."""
        self.table.unpersist()


def bounded(raw: DataFrame, rows: int | None) -> tuple[DataFrame, int]:
    """The first rows in source order, and how many are beyond.

    Where the parts of the table have consecutive numbers, as readers give them,
    counts of the parts say which number is the last one, and no row is sorted.
    """
    raw = with_order(raw)
    if rows is None:
        return raw, 0
    parts = sorted(raw.groupBy(F.spark_partition_id().alias("part")).agg(F.min(ORDER).alias("low"), F.max(ORDER).alias("high"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["low"])
    beyond = max(sum(r["n"] for r in parts) - rows, 0)
    if not beyond:
        return raw, 0
    if any(r["high"] - r["low"] + 1 != r["n"] for r in parts) or any(a["high"] >= b["low"] for a, b in zip(parts, parts[1:])):
        return raw.orderBy(ORDER).limit(rows), beyond
    before = 0
    for r in parts:
        if before + r["n"] >= rows:
            return raw.where(F.col(ORDER) < r["low"] + rows - before), beyond
        before += r["n"]
    return raw, 0


def prepare(raw: DataFrame, *, row_limit: int | None = None) -> Prepared:
    """Bound, clean, and find the roles. The cleaned table is cached."""
    first, beyond = bounded(raw, row_limit)
    table, audit = clean(first)
    table = table.persist()
    return Prepared(table, audit, detect_roles(table), beyond)
