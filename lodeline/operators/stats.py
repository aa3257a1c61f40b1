"""Statistics of all columns in few passes: profile, completeness, quartiles,
outliers, correlations, category shares."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions.columns import ORDER, col, kinds, number, present, shown, user_columns, with_order
from lodeline.functions.shipping import scratch, ship

# Fixed values.
CATEGORY_DISTINCT, CATEGORY_RATIO = 50, 0.2
MODE_DISTINCT = 100
IQR_FACTOR = 1.5
#: Values that one rank may gather, half the width of a rank's bracket, and the
#: accuracy of approximate percentiles, whose error is a fifth of that width.
SMALL, BRACKET, ACCURACY = 50_000, 0.005, 1000
#: Most distinct values that a rule asks for, the estimate from which a column
#: surely has more, and the estimates' standard error.
FEW, SURELY, ERROR = 100, 150, 0.02
#: Numeric columns from which correlations are summed as matrices, columns of a
#: block, and sums that one task adds. A variance below FLAT of the mean square is rounding.
WIDE, BLOCK, SLOTS, FLAT = 24, 128, 256, 1e-13
#: Parts of the grid on which brackets of segments are read off.
GRID = 200


@dataclass(frozen=True)
class ColumnStats:
    """``distinct`` is exact up to FEW, and beyond where ``exact`` says so; else it is an estimate above FEW."""

    name: str
    kind: str
    rows: int
    present: int
    distinct: int
    exact: bool = True

    @property
    def missing(self) -> int:
        return self.rows - self.present


def first_pass(df: DataFrame, more: Iterable[Column] = ()) -> Row:
    """One aggregate: rows, present values (p) and estimates of distinct ones (d) of every column, and what else is asked for."""
    names = list(kinds(df))
    value = [F.when(present(n, df), col(n)) for n in names]
    guess = [F.approx_count_distinct(v, ERROR) if sortable(df, n) else F.lit(None).cast("long") for n, v in zip(names, value)]
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(v).alias(f"p{k}") for k, v in enumerate(value)), *(g.alias(f"d{k}") for k, g in enumerate(guess)), *more).first()


def column_stats(df: DataFrame, exact: Iterable[str] = (), near: dict[str, float] | None = None, first: Row | None = None) -> dict[str, ColumnStats]:
    """Rows, present and distinct values of every column; ``first`` may hold a ``first_pass``.

    One aggregate counts, and estimates distinct values from sketches of a fixed
    size. Columns of few values, by an estimate that is far beyond its error,
    are then counted exactly in one more aggregate, whose sets stay as small.
    Others keep their estimate, unless they are in ``exact``, or in ``near`` with
    a ratio of distinct to present values that the estimate doesn't decide: their
    values are exchanged as fingerprints of 128 bits. So keys and free texts are
    neither copied nor exchanged where only a rule asks for them.
    """
    of = kinds(df)
    names = list(of)
    if not names:
        return {}
    first = first or first_pass(df)
    value = {n: F.when(present(n, df), col(n)) for n in names}
    counted = {n: first[f"p{k}"] for k, n in enumerate(names)}
    guess = {n: first[f"d{k}"] for k, n in enumerate(names)}
    few = [n for n in names if guess[n] is not None and guess[n] <= SURELY]
    sets = df.agg(*(F.size(F.collect_set(value[n])).alias(f"s{k}") for k, n in enumerate(few))).first() if few else ()
    found = {n: (x, True) for n, x in zip(few, sets)}

    def undecided(n: str) -> bool:
        ratio = (near or {}).get(n)
        return ratio is not None and abs(guess[n] / max(counted[n], 1) - ratio) <= 5 * ERROR * ratio

    wanted = [n for n in names if n not in found and (guess[n] is None or n in set(exact) or undecided(n))]
    if wanted:
        marks = df.select(F.explode(F.array(*(F.when(present(n, df), F.struct(F.lit(k).alias("k"), *fingerprint(n, df))) for k, n in enumerate(wanted)))).alias("x")).select("x.*")
        numbers = {r["k"]: r["n"] for r in marks.where("k IS NOT NULL").distinct().groupBy("k").agg(F.count("*").alias("n")).collect()}
        found |= {n: (numbers.get(k, 0), True) for k, n in enumerate(wanted)}
    return {n: ColumnStats(n, of[n], first["rows"], counted[n], *found.get(n, (guess[n], False))) for n in names}


def sortable(df: DataFrame, name: str) -> bool:
    """Whether values of the column's type can be told apart by sketches and sets (maps can't)."""
    return not isinstance(df.schema[name].dataType, (T.MapType, T.VariantType, T.ArrayType, T.StructType))


def fingerprint(name: str, df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a value, as columns a and b; equal numbers have equal ones."""
    c = col(name)
    if not sortable(df, name):
        c = F.to_json(F.struct(c))
    elif isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)  # both zeros are one value
    return [F.xxhash64(c).alias("a"), F.xxhash64(F.lit("b"), c).alias("b")]


def profile(df: DataFrame) -> DataFrame:
    """A data dictionary: a row for each column."""
    df = with_order(df)
    found = column_stats(df, exact=user_columns(df))
    firsts = df.agg(*(F.min_by(shown(n, s.kind), F.when(present(n, df), F.col(ORDER))).alias(f"e{k}") for k, (n, s) in enumerate(found.items()))).first() if found else None
    rows = []
    for k, (name, s) in enumerate(found.items()):
        if s.kind in ("datetime", "numeric"):
            kind = s.kind
        elif s.kind == "bool":
            kind = "numeric"
        else:
            kind = "category" if s.distinct <= CATEGORY_DISTINCT or s.distinct / max(s.present, 1) <= CATEGORY_RATIO else "text"
        example = firsts[f"e{k}"]
        rows.append((k, name, kind, df.schema[name].dataType.simpleString(), s.present, s.missing, round(100 * s.missing / s.rows, 2) if s.rows else 0.0, s.distinct, "—" if example is None else example[:80]))
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, data_type string, present long, missing long, missing_percent double, distinct long, example string")


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing, missing_percent), most missing first: one pass."""
    names = user_columns(df)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*(F.struct(F.lit(n).alias("column"), F.count_if(~present(n, df)).alias("missing")) for n in names)).alias("all"))
    out = counts.select("rows", F.inline("all"))
    return out.select("column", "missing", (F.coalesce(F.try_divide("missing", "rows"), F.lit(0.0)) * 100).alias("missing_percent")).orderBy(F.desc("missing_percent"))


def completeness(df: DataFrame) -> DataFrame:
    """One row: cells, missing cells, complete_percent."""
    names = user_columns(df)
    missing = sum((F.count_if(~present(n, df)) for n in names), F.lit(0))
    out = df.agg((F.count(F.lit(1)) * len(names)).alias("cells"), missing.cast("long").alias("missing"))
    return out.withColumn("complete_percent", 100 - F.coalesce(F.try_divide("missing", "cells"), F.lit(0.0)) * 100)


def pearson(a: str, b: str) -> Column:
    """Pairwise-complete correlation; NULL where a side is constant."""
    both = number(a).isNotNull() & number(b).isNotNull()
    x, y = F.when(both, number(a)), F.when(both, number(b))
    # Deviations of equal values can differ from zero by rounding, extremes can't.
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, left, right, r) of every pair of columns: in one aggregate, or
    for wide tables from matrices of sums."""
    if len(columns) > WIDE:
        return wide_correlations(df, columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "position int, left string, right string, r double")
    every = [F.struct(F.lit(k).alias("position"), F.lit(a).alias("left"), F.lit(b).alias("right"), pearson(a, b).alias("r")) for k, (a, b) in enumerate(pairs)]
    return df.agg(F.array(*every).alias("all")).select(F.inline("all"))


#: Of a pair of blocks of columns (rows: first block): rows present in both,
#: sums of the first and the second, of their squares, and of their product.
SUMS = ("n", "x", "y", "xx", "yy", "xy")
TABLES = "a int, b int, slot int, " + ", ".join(f"{s} binary" for s in SUMS)
_TABLES = pa.schema([(n, pa.int32()) for n in ("a", "b", "slot")] + [(s, pa.binary()) for s in SUMS])


def wide_correlations(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """``correlations`` of many columns: each task sums products of blocks of
    columns as matrices, and these sums are added in two steps, so that no task
    adds more than SLOTS of them for a pair of blocks after the first. Values are
    taken from about the median of their column, which keeps sums of squares small."""
    names = list(columns)
    middle = df.agg(*(F.percentile_approx(number(c), 0.5, 100).alias(f"m{k}") for k, c in enumerate(names))).first()
    shift = np.array([m or 0.0 for m in middle])
    cuts = [slice(k, min(k + block, len(names))) for k in range(0, len(names), block)]
    pairs = [(a, b) for a in range(len(cuts)) for b in range(a, len(cuts))]

    def rows(found: dict[tuple[int, int, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (a, b, slot), sums in found.items():
            yield pa.record_batch([[a], [b], [slot], *([s.tobytes()] for s in sums)], schema=_TABLES)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[tuple[int, int, int], list[np.ndarray]] = {}
        slot = TaskContext.get().partitionId() % SLOTS
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
            there = ~np.isnan(x)
            x = np.where(there, x - shift, 0.0)
            there = there.astype(float)
            for a, b in pairs:
                u, v, p, q = x[:, cuts[a]], x[:, cuts[b]], there[:, cuts[a]], there[:, cuts[b]]
                own = [p.T @ q, u.T @ q, p.T @ v, (u * u).T @ q, p.T @ (v * v), u.T @ v]
                for s, more in zip(found.setdefault((a, b, slot), [np.zeros_like(m) for m in own]), own):
                    s += more
        yield from rows(found)

    def added(slots: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int, int], list[np.ndarray]] = {}
            for batch in batches:
                for a, b, slot, *sums in zip(*(c.to_pylist() for c in batch.columns)):
                    own = [np.frombuffer(s) for s in sums]
                    for s, more in zip(found.setdefault((a, b, slot if slots else 0), [np.zeros_like(m) for m in own]), own):
                        s += more
            yield from rows(found)

        return run

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = len(names)
        for batch in batches:
            for a, b, _, *sums in zip(*(c.to_pylist() for c in batch.columns)):
                shape = (cuts[a].stop - cuts[a].start, cuts[b].stop - cuts[b].start)
                n, x, y, xx, yy, xy = (np.frombuffer(s).reshape(shape) for s in sums)
                with np.errstate(all="ignore"):
                    u, v = xx - x * x / n, yy - y * y / n
                    r = (xy - x * y / n) / np.sqrt(u * v)
                none = ~((n > 0) & (u > FLAT * xx) & (v > FLAT * yy))
                i, j = np.meshgrid(np.arange(cuts[a].start, cuts[a].stop), np.arange(cuts[b].start, cuts[b].stop), indexing="ij")
                ok = i < j
                i, j = i[ok], j[ok]
                yield pa.record_batch([pa.array(i * wide - i * (i + 1) // 2 + j - i - 1, pa.int32()), pa.array([names[k] for k in i], pa.string()), pa.array([names[k] for k in j], pa.string()), pa.array(np.clip(r[ok], -1, 1), pa.float64(), mask=none[ok])], ["position", "left", "right", "r"])

    ship(df.sparkSession)
    parts = df.select(*(number(c).alias(f"c{k}") for k, c in enumerate(names))).mapInArrow(summed, TABLES)
    once = parts.repartition("a", "b", "slot").mapInArrow(added(True), TABLES)
    return once.repartition("a", "b").mapInArrow(added(False), TABLES).mapInArrow(finished, "position int, left string, right string, r double")


def strongest_pair(df: DataFrame, columns: list[str]) -> DataFrame:
    """The pair with the largest magnitude; the first on ties; none if undefined."""
    return correlations(df, columns).where("r IS NOT NULL AND NOT isnan(r)").orderBy(F.desc(F.abs("r")), "position").limit(1)


@dataclass
class _Rank:
    """A rank that is sought: the bracket that has it, and the rows before the bracket."""

    column: str
    share: float
    rank: float
    low: float
    high: float
    before: int
    inside: int

    def within(self, m: Column) -> Column:
        return (m >= self.low) & (m <= self.high)

    def halve(self, df: DataFrame, m: Column) -> None:
        """Go on in the half of the bracket's values that has the rank."""
        inside, first = self.within(m), m <= self.low / 2 + self.high / 2
        n, below, above = df.agg(F.count_if(inside & first), F.max(F.when(inside & first, m)), F.min(F.when(inside & ~first, m))).first()
        place = self.rank - self.before
        if place <= n - 1:
            self.high, self.inside = below, n
        elif place >= n:
            self.low, self.before, self.inside = above, self.before + n, self.inside - n
        else:  # its neighbours are in different halves
            self.low = self.high = below + (place - (n - 1)) * (above - below)


def percentiles(df: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.25, 0.75), small: int = SMALL) -> dict[str, tuple[int, list[float | None]]]:
    """{column: (values present, exact percentiles)}, linear between neighbours.

    Approximate percentiles with a known error bracket each rank; a count says
    how many values lie before and inside; and brackets shrink until they hold
    ``small`` values, which are read. Each pass is one aggregate of all columns,
    so no task holds more than ``small`` values of a rank, however many there are.
    """
    ms = {c: number(c) for c in columns}
    first = df.agg(*(F.struct(F.count(m).alias("n"), F.min(m).alias("low"), F.max(m).alias("high")).alias(f"c{k}") for k, m in enumerate(ms.values()))).first() if ms else ()
    counted = dict(zip(ms, first))
    ranks = [_Rank(c, p, p * (r["n"] - 1), r["low"], r["high"], 0, r["n"]) for c, r in counted.items() if r["n"] for p in shares]
    while wide := [r for r in ranks if r.inside > small and r.low < r.high]:
        at = [(r.rank - r.before) / r.inside for r in wide]
        cuts = df.agg(*(F.percentile_approx(F.when(r.within(ms[r.column]), ms[r.column]), [max(0.0, x - BRACKET), min(1.0, x + BRACKET)], ACCURACY).alias(f"b{k}") for k, (r, x) in enumerate(zip(wide, at)))).first()
        inner = [(r, low, high, ms[r.column]) for r, (low, high) in zip(wide, cuts)]
        counts = df.agg(*(F.struct(F.count_if(m < low).alias("before"), F.count_if((m >= low) & (m <= high)).alias("inside")).alias(f"n{k}") for k, (_, low, high, m) in enumerate(inner))).first()
        for (r, low, high, _), n in zip(inner, counts):
            if n["inside"] < r.inside and n["before"] <= r.rank <= n["before"] + n["inside"] - 1:
                r.low, r.high, r.before, r.inside = low, high, n["before"], n["inside"]
            else:
                r.halve(df, ms[r.column])
    read = [r for r in ranks if r.low < r.high]
    lists = df.agg(*(F.sort_array(F.collect_list(F.when(r.within(ms[r.column]), ms[r.column]))).alias(f"v{k}") for k, r in enumerate(read))).select(*(F.slice(f"v{k}", int(r.rank) - r.before + 1, 2).alias(f"v{k}") for k, r in enumerate(read))).first() if read else ()
    found: dict[str, list[float | None]] = {c: [] for c in ms}
    near = iter(lists)
    for r in ranks:
        if r.low < r.high:
            own = next(near)
            r.low = own[0] + (r.rank - int(r.rank)) * (own[-1] - own[0])
        found[r.column].append(r.low)
    return {c: (counted[c]["n"], found[c] or [None] * len(shares)) for c in ms}


def grouped_percentile(df: DataFrame, by: Column, measure: str, share: float = 0.5, small: int = SMALL) -> DataFrame:
    """(segment, value): the exact percentile of a measure in each segment,
    linear between neighbours; NULL where a segment has no value.

    Segments of at most ``small`` values are computed as they are. For the others
    the two values that the rank lies between are sought as in ``percentiles``,
    for all of these segments at once: sketches bracket them, counts say how many
    values lie before and inside, and brackets shrink until they hold ``small``
    values. The brackets are a table, joined to the rows, so there may be many
    such segments; no task holds more than ``small`` values of one.
    """
    rows = df.where(by.isNotNull()).select(by.alias("segment"), number(measure).alias("m"))
    sizes = rows.groupBy("segment").agg(F.count("m").alias("n"))
    state = kept(sizes.where(F.col("n") > small), "segments")
    if state.isEmpty():
        return rows.groupBy("segment").agg(F.percentile("m", F.lit(share)).alias("value"))
    light = rows.join(state.select("segment"), "segment", "left_anti").groupBy("segment").agg(F.percentile("m", F.lit(share)).alias("value"))
    heavy = rows.where("m IS NOT NULL").join(state.select("segment"), "segment", "left_semi")
    rank = share * (F.col("n") - 1)
    ends = heavy.groupBy("segment").agg(F.min("m").alias("low"), F.max("m").alias("high"))
    # Places k1 and k2 from 0 are of the values that the rank lies between.
    state = kept(state.join(ends, "segment").select("segment", rank.alias("rank"), F.floor(rank).alias("k1"), F.ceil(rank).alias("k2"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), F.lit(None).cast("double").alias("v1"), F.lit(None).cast("double").alias("v2")), "brackets")
    wide = (F.col("inside") > small) & (F.col("low") < F.col("high")) & F.col("v1").isNull()
    while not (narrowing := state.where(wide)).isEmpty():
        near = heavy.join(narrowing, "segment").where("m BETWEEN low AND high")
        places = F.array(F.greatest((F.first("k1") - F.first("before")) / F.first("inside") - BRACKET, F.lit(0.0)), F.least((F.first("k2") - F.first("before")) / F.first("inside") + BRACKET, F.lit(1.0)))
        # Percentages of an approximate percentile are literals, so a grid of them is read off at both places.
        grid = [k / GRID for k in range(GRID + 1)]
        cuts = near.groupBy("segment").agg(F.percentile_approx("m", grid, ACCURACY).alias("cuts"), places.alias("at"))
        at = lambda k, up: F.expr(f"cuts[cast({'ceil' if up else 'floor'}(at[{k}] * {GRID}) as int)]")
        cuts = cuts.select("segment", at(0, False).alias("lo"), at(1, True).alias("hi"))
        mid = F.col("low") / 2 + F.col("high") / 2
        told = near.join(cuts, "segment").groupBy("segment").agg(
            F.count_if(F.col("m") < F.col("lo")).alias("under"), F.count_if(F.col("m").between(F.col("lo"), F.col("hi"))).alias("within"),
            F.count_if(F.col("m") <= mid).alias("half"), F.max(F.when(F.col("m") <= mid, F.col("m"))).alias("below"), F.min(F.when(F.col("m") > mid, F.col("m"))).alias("above"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        )
        both = state.join(told, "segment", "left")
        cut = "within < inside AND before + under <= k1 AND k2 <= before + under + within - 1"
        step = F.when(F.col("half").isNull(), "stay").when(F.expr(cut), "cut").when(F.expr("k2 <= before + half - 1"), "lower").when(F.expr("k1 >= before + half"), "upper").otherwise("apart")
        both = both.withColumn("step", step)
        pick = lambda cut, lower, upper, stay: F.when(F.col("step") == "cut", F.expr(cut)).when(F.col("step") == "lower", F.expr(lower)).when(F.col("step") == "upper", F.expr(upper)).otherwise(F.expr(stay))
        state = kept(both.select("segment", "rank", "k1", "k2", pick("lo", "low", "above", "low").alias("low"), pick("hi", "below", "high", "high").alias("high"), pick("before + under", "before", "before + half", "before").cast("long").alias("before"), pick("within", "half", "inside - half", "inside").cast("long").alias("inside"), F.when(F.col("step") == "apart", F.col("below")).otherwise(F.col("v1")).alias("v1"), F.when(F.col("step") == "apart", F.col("above")).otherwise(F.col("v2")).alias("v2")), "brackets")
    left = state.where("v1 IS NULL AND low < high")
    lists = heavy.join(left, "segment").where("m BETWEEN low AND high").groupBy("segment").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    values = state.join(lists, "segment", "left")
    one, two = F.coalesce("v1", F.expr("ms[cast(k1 - before as int)]"), "low"), F.coalesce("v2", F.expr("ms[cast(k2 - before as int)]"), "high")
    return light.unionByName(values.select("segment", (one + (F.col("rank") - F.col("k1")) * (two - one)).alias("value")))


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: later plans start from it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, q1, q3), exact."""
    rows = [(c, n, *cuts) for c, (n, cuts) in percentiles(df, columns).items()]
    return df.sparkSession.createDataFrame(rows, "column string, n long, q1 double, q3 double")


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, q1, q3, low, high, outliers, percent): quartiles first, then
    one counting pass for all columns. A zero range has no outliers."""
    cuts = percentiles(df, columns)

    def of(c: str) -> Column:
        (n, (q1, q3)), m = cuts[c], number(c)
        low = high = None
        outliers = F.lit(0).cast("long")
        if q1 is not None:
            reach = IQR_FACTOR * (q3 - q1)
            low, high = q1 - reach, q3 + reach
            outliers = F.count_if((m < low) | (m > high)) if reach else outliers
        values = {"q1": q1, "q3": q3, "low": low, "high": high}
        return F.struct(F.lit(c).alias("column"), F.lit(n).cast("long").alias("n"), *(F.lit(x).cast("double").alias(k) for k, x in values.items()), outliers.alias("outliers"))

    out = df.agg(F.array(*map(of, columns)).alias("all")).select(F.inline("all"))
    return out.withColumn("percent", F.coalesce(F.try_divide("outliers", "n"), F.lit(0.0)) * 100)


def few_outliers(df: DataFrame, column: str) -> tuple[int, float]:
    """(outliers, their percent) by quartiles, of a column of at most SMALL
    values: they are put in order once, and looked at there, in one aggregate."""
    ordered = df.agg(F.sort_array(F.collect_list(number(column))).alias("v")).withColumn("n", F.size("v"))

    def at(share: float) -> str:
        place = f"({share} * (n - 1))"
        return f"(v[int(floor({place}))] + ({place} - floor({place})) * (v[int(ceil({place}))] - v[int(floor({place}))]))"

    cut = ordered.where("n > 0").selectExpr("v", "n", f"{at(0.25)} AS q1", f"{at(0.75)} AS q3")
    r = cut.selectExpr("n", f"CASE WHEN q3 > q1 THEN size(filter(v, x -> x < q1 - {IQR_FACTOR} * (q3 - q1) OR x > q3 + {IQR_FACTOR} * (q3 - q1))) ELSE 0 END AS outliers").first()
    return (r["outliers"], 100 * r["outliers"] / r["n"]) if r else (0, 0.0)


def mode_share(df: DataFrame, column: str, most_distinct: int = MODE_DISTINCT) -> DataFrame:
    """The most common value of a column and its share of present rows; none for
    columns of too many values. Ties go to the smaller value."""
    counts = df.where(present(column, df)).groupBy(shown(column, kinds(df)[column]).alias("value")).agg(F.count("*").alias("rows"))
    top = counts.agg(F.max("rows").alias("rows"), F.sum("rows").alias("all"), F.count("*").alias("distinct"))
    first = counts.groupBy("rows").agg(F.min("value").alias("value")).withColumnRenamed("rows", "r")
    out = top.join(F.broadcast(first.orderBy(F.desc("r")).limit(1)), F.col("rows") == F.col("r"))
    return out.where(F.col("distinct") <= most_distinct).select(F.lit(column).alias("column"), "value", (F.try_divide("rows", "all") * 100).alias("percent"))


def time_coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(col(column)).alias("first"), F.max(col(column)).alias("last"))
