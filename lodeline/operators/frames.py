"""Aggregates over periods and segments, as lazy DataFrames.

All of them aggregate the base rows once by period, segment or both; what
follows (ranks, shares, changes) works on the few rows that are left, so the
windows without a partition never see base rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.columns import col, kinds, number, shown, user_columns
from lodeline.functions.periods import bucket, preferred_grain
from lodeline.operators.stats import grouped_percentile, percentiles
from lodeline.plans.model import Roles

OTHERS = "Other segments"
#: Points of a scatter for each segment, segments that have a colour of their own, and bins of each axis.
POINTS, COLOURS, BINS = 60, 8, 40


def total(measure: str | None, when: Column | None = None) -> Column:
    """Sum of the measure, or the number of rows, as double. No rows sum to 0."""
    value = F.lit(1.0) if measure is None else number(measure)
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0.0))


def trend(df: DataFrame, roles: Roles, grain: str | None = None) -> DataFrame:
    """(period, value), ascending and without gaps filled in."""
    grain = grain or preferred_grain(df, roles.date)
    rows = df.where(col(roles.date).isNotNull())
    return rows.groupBy(bucket(roles.date, grain).alias("period")).agg(total(roles.measure).alias("value")).orderBy("period")


def segments(df: DataFrame, roles: Roles, limit: int | None = 12) -> DataFrame:
    """(segment, value), largest first; ties by segment."""
    out = df.where(col(roles.dimension).isNotNull()).groupBy(col(roles.dimension).alias("segment")).agg(total(roles.measure).alias("value")).orderBy(F.desc_nulls_last("value"), "segment")
    return out if limit is None else out.limit(limit)


def segment_trend(df: DataFrame, roles: Roles, grain: str) -> DataFrame:
    """(segment, period, value): the trend of each segment."""
    rows = df.where(col(roles.date).isNotNull() & col(roles.dimension).isNotNull())
    return rows.groupBy(col(roles.dimension).alias("segment"), bucket(roles.date, grain).alias("period")).agg(total(roles.measure).alias("value"))


def shares(frame: DataFrame, value: str = "value") -> DataFrame:
    """Adds each row's share of the whole in percent, to one place, half to even.
    The whole is a scalar, so that segments stay where they are."""
    whole = frame.agg(F.sum(value)).scalar()
    return frame.withColumn("share", F.bround(F.try_divide(F.col(value), whole) * 100, 1))


def concentration(df: DataFrame, roles: Roles, top: int = 3, limit: int = 100) -> DataFrame:
    """One row: leader, its value and share, and the share of the first ``top``
    in the ``limit`` largest segments, which alone are ranked."""
    first = Window.orderBy(F.desc_nulls_last("value"), "segment")
    ranked = segments(df, roles, limit).withColumn("rank", F.row_number().over(first))
    of = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("value")))
    return ranked.agg(
        F.min(F.when(F.col("rank") == 1, F.col("segment"))).alias("leader"),
        of(1).alias("leader_value"),
        (F.try_divide(of(1), F.sum("value")) * 100).alias("leader_share"),
        (F.try_divide(of(top), F.sum("value")) * 100).alias("top_share"),
        F.sum("value").alias("total"),
    )


@dataclass(frozen=True)
class Driver:
    segment: object
    previous: float
    latest: float
    change: float
    net: float


@dataclass(frozen=True)
class Cube:
    """What a brief needs of segments by period: the trend, the largest segments
    with the total of the first hundred, and the driver of the latest change."""

    trend: list[tuple[datetime, float]]
    top: list[tuple[object, float]]
    total: float
    driver: Driver | None


def cube(df: DataFrame, roles: Roles, grain: str | None, most: int = 100) -> Cube:
    """One pass over the rows: sums by segment and period, and from them, in
    the same query, the trend, the ``most`` largest segments, and the segments
    that moved most to either side between the two latest periods."""
    if grain is None and not roles.dimension:
        return Cube([], [], 0.0, None)
    none = F.lit(None).cast("timestamp_ntz")
    name = col(roles.dimension) if roles.dimension else F.lit(None).cast("string")
    value = number(roles.measure) if roles.measure else F.lit(1.0)
    cells = df.groupBy(name.cast("string").alias("segment"), (bucket(roles.date, grain) if grain else none).alias("period")).agg(F.sum(value).alias("value"))
    # Sums of no value are NULL here: such a cell is no part of a change.
    trend_ = cells.where("period IS NOT NULL").groupBy("period").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    sizes = cells.where("segment IS NOT NULL").groupBy("segment").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    order = (F.desc_nulls_last("value"), "segment")
    columns = {"part": "int", "segment": "string", "period": "timestamp_ntz", "value": "double", "previous": "double", "net": "double"}

    def part(k: int, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(k).alias("part"), *(F.col(c).cast(t) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items() if c != "part"))

    found = part(0, trend_).unionAll(part(1, sizes.orderBy(*order).limit(most)))
    if grain and roles.dimension:
        latest = trend_.select("period").orderBy(F.desc("period")).limit(2)
        ends = {"_a": latest.agg(F.min("period")).scalar(), "_b": latest.agg(F.max("period")).scalar()}
        two = cells.where("segment IS NOT NULL AND value IS NOT NULL").withColumns(ends).where("_a < _b AND period IN (_a, _b)")
        at = lambda c: F.coalesce(F.sum(F.when(F.col("period") == F.col(c), F.col("value"))), F.lit(0.0))
        change = two.groupBy("segment").agg(at("_a").alias("previous"), at("_b").alias("value"))
        moved = F.col("value") - F.col("previous")
        change = change.withColumn("net", change.agg(F.sum(moved)).scalar()).where("net <> 0")
        found = found.unionAll(part(2, change.orderBy(F.desc(F.when(F.col("net") > 0, moved).otherwise(-moved)), "segment").limit(1)))
    rows = found.collect()
    top = sorted(((r["segment"], r["value"]) for r in rows if r["part"] == 1), key=lambda x: (-x[1], x[0]))
    driver = next((Driver(r["segment"], r["previous"], r["value"], r["value"] - r["previous"], r["net"]) for r in rows if r["part"] == 2), None)
    return Cube(sorted((r["period"], r["value"]) for r in rows if r["part"] == 0), top, sum(v for _, v in top), driver)


def last_two(trend_rows: DataFrame) -> list[tuple[datetime, float]]:
    """The latest two observed periods, oldest first."""
    rows = trend_rows.orderBy(F.desc("period")).limit(2).collect()
    return [(r["period"], r["value"]) for r in reversed(rows)]


def period_change(df: DataFrame, roles: Roles, grain: str, previous: datetime, current: datetime) -> DataFrame:
    """(segment, previous, latest, change) of two periods: one conditional aggregate."""
    at = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    # The lower bound on the bare date column prunes the scan.
    rows = df.where((col(roles.date) >= at(previous)) & col(roles.dimension).isNotNull())
    if roles.measure:
        rows = rows.where(number(roles.measure).isNotNull())
    rows = rows.select(col(roles.dimension).alias("segment"), bucket(roles.date, grain).alias("period"), *([number(roles.measure).alias("m")] if roles.measure else []))
    two = rows.where(F.col("period").isin(at(previous), at(current)))
    m = "m" if roles.measure else None
    out = two.groupBy("segment").agg(total(m, F.col("period") == at(previous)).alias("previous"), total(m, F.col("period") == at(current)).alias("latest"))
    return out.withColumn("change", F.col("latest") - F.col("previous"))


def drivers(change: DataFrame, limit: int = 9) -> DataFrame:
    """(segment, change): the largest movements and the rest as one row, if it
    isn't zero; sums to the net change. Only the largest ones are ranked; the
    rest is the net change without them."""
    named = change.select(F.col("segment").cast("string").alias("segment"), "change")
    order = (F.desc(F.abs("change")), "segment")
    top = named.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    rest = named.agg(F.sum("change").alias("net"), F.count("*").alias("n")).where(F.col("n") > limit)
    rest = rest.select(F.lit(OTHERS).alias("segment"), (F.col("net") - top.agg(F.sum("change")).scalar()).alias("change"), F.lit(limit + 1).alias("place"))
    return top.unionByName(rest.where("change <> 0")).orderBy("place").select("segment", "change")


def largest_driver(change: DataFrame) -> DataFrame:
    """One row for the segment that moved most in the direction of the net
    change, or none where that is zero."""
    with_net = change.withColumn("net", change.agg(F.sum("change")).scalar()).where("net <> 0")
    toward = F.when(F.col("net") > 0, F.col("change")).otherwise(-F.col("change"))
    return with_net.orderBy(F.desc(toward), F.col("segment").cast("string")).limit(1)


def heatmap(df: DataFrame, roles: Roles, limit: int = 8, grain: str | None = None) -> DataFrame:
    """(segment, period, value) of the largest segments, in long form."""
    top = segments(df, roles, limit).select(F.col("segment").alias("top"))
    rows = df.where(col(roles.date).isNotNull() & col(roles.dimension).isNotNull())
    kept = rows.join(top, col(roles.dimension) == F.col("top"), "left_semi")
    grain = grain or preferred_grain(kept, roles.date)
    return kept.groupBy(col(roles.dimension).alias("segment"), bucket(roles.date, grain).alias("period")).agg(total(roles.measure).alias("value"))


def matrix(long: DataFrame) -> DataFrame:
    """The heatmap as one column for each period, zeros filled, largest first."""
    periods = [r["period"] for r in long.select("period").distinct().orderBy("period").collect()]
    wide = long.groupBy("segment").pivot("period", periods).agg(F.sum("value")).na.fill(0.0)
    names = wide.columns[1:]
    whole = sum((F.col(f"`{n}`") for n in names), F.lit(0.0))
    return wide.orderBy(F.desc(whole), "segment")


def growth(trend_rows: DataFrame) -> DataFrame:
    """(period, previous, latest, change_percent) for the latest period; undefined
    change on a zero base is NULL."""
    w = Window.orderBy("period")
    last = trend_rows.withColumn("previous", F.lag("value").over(w)).orderBy(F.desc("period")).limit(1)
    change = F.try_divide(F.col("value") - F.col("previous"), F.when(F.col("previous") != 0, F.abs("previous"))) * 100
    return last.where("previous IS NOT NULL").select("period", "previous", F.col("value").alias("latest"), change.alias("change_percent"))


def ranked_growth(change: DataFrame, ascending: bool = False, limit: int | None = 12) -> DataFrame:
    """(segment, previous, latest, change_percent), ordered by the rounded change;
    segments that start from zero have none and are left out."""
    percent = F.bround((F.col("latest") - F.col("previous")) / F.abs("previous") * 100, 1)
    out = change.where("previous <> 0").select("segment", "previous", "latest", percent.alias("change_percent"))
    order = F.asc_nulls_last("change_percent") if ascending else F.desc_nulls_last("change_percent")
    out = out.orderBy(order, "segment")
    return out if limit is None else out.limit(limit)


def grouped(df: DataFrame, dimension: str, measure: str | None, aggregation: str, ascending: bool = False) -> DataFrame:
    """(segment, value[, share]) by any aggregation."""
    rows = df.where(col(dimension).isNotNull()).groupBy(col(dimension).alias("segment"))
    if aggregation == "median" and measure is not None:
        out = grouped_percentile(df, col(dimension), measure)
    elif aggregation == "count" or measure is None:
        out = rows.agg(F.count(F.lit(1)).alias("value"))
    else:
        out = rows.agg(aggregate(measure, aggregation).alias("value"))
    if aggregation in ("sum", "count"):
        out = shares(out)
    order = F.asc_nulls_last("value") if ascending else F.desc_nulls_last("value")
    return out.orderBy(order, "segment")


def aggregate(measure: str, aggregation: str) -> Column:
    m = number(measure)
    match aggregation:
        case "sum":
            return F.coalesce(F.sum(m), F.lit(0.0))
        case "mean":
            return F.avg(m)
        case "median":
            return F.median(m)
        case "min":
            return F.min(m)
        case "max":
            return F.max(m)
        case "count":
            return F.count(m)
    raise ValueError(f"unknown aggregation {aggregation!r}")


def scalar(df: DataFrame, measure: str, aggregation: str) -> DataFrame:
    """(value, rows) of a whole table. A median is found by its rank, since one
    task can't hold all values."""
    if aggregation == "median":
        n, (value,) = percentiles(df, [measure], (0.5,))[measure]
        return df.sparkSession.createDataFrame([(value, n)], "value double, rows long")
    return df.agg(aggregate(measure, aggregation).alias("value"), F.count(number(measure)).alias("rows"))


def histogram(df: DataFrame, measure: str, bins: int = 35) -> DataFrame:
    """(bin, low, high, rows) of equal widths between the extremes."""
    m = number(measure)
    ends = df.agg(F.min(m).alias("low"), F.max(m).alias("high")).first()
    if ends["low"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, rows long")
    low, width = ends["low"], (ends["high"] - ends["low"]) / bins or 1.0
    place = F.least(F.floor((m - low) / width), F.lit(bins - 1)).cast("int")
    out = df.where(m.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("rows"))
    return out.select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "rows")


def scatter_partner(df: DataFrame, roles: Roles) -> str | None:
    """The first other numeric column of more than two values: one with a value
    strictly between its extremes. Two aggregates of all columns."""
    others = [c for c in roles.numeric if c != roles.measure]
    if not others:
        return None
    ends = df.agg(*(F.struct(F.min(number(c)).alias("low"), F.max(number(c)).alias("high")).alias(f"c{k}") for k, c in enumerate(others))).first()
    wide = [(c, e) for c, e in zip(others, ends) if e["low"] is not None and e["low"] < e["high"]]
    if not wide:
        return None
    between = df.agg(*(F.bool_or((number(c) > e["low"]) & (number(c) < e["high"])).alias(f"b{k}") for k, (c, e) in enumerate(wide))).first()
    return next((c for (c, _), b in zip(wide, between) if b), None)


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = BINS) -> DataFrame:
    """(x_bin, y_bin, x_low, x_high, y_low, y_high, rows): how many rows fall in
    each cell of a grid between the extremes of both columns; at most
    bins x bins rows, whatever the table. Rows without one of the two are in none."""
    a, b = number(x), number(y)
    both = df.where(a.isNotNull() & b.isNotNull()).select(a.alias("x"), b.alias("y"))
    ends = both.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if ends["x0"] is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, x_low double, x_high double, y_low double, y_high double, rows long")
    steps = {c: (ends[f"{c}0"], (ends[f"{c}1"] - ends[f"{c}0"]) / bins or 1.0) for c in "xy"}
    place = {c: F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1)).cast("int").alias(f"{c}_bin") for c, (low, width) in steps.items()}
    cells = both.groupBy(place["x"], place["y"]).agg(F.count("*").alias("rows"))
    edge = lambda c, k: F.lit(steps[c][0]) + (F.col(f"{c}_bin") + k) * steps[c][1]
    return cells.select("x_bin", "y_bin", *(edge(c, k).alias(f"{c}_{name}") for c in "xy" for k, name in enumerate(("low", "high"))), "rows")


def scatter_sample(df: DataFrame, roles: Roles, x: str, y: str, key: tuple[str, ...] = (), points: int = POINTS, colours: int = COLOURS) -> DataFrame:
    """(segment, x, y): for each of the largest segments, and for all others
    together, the rows whose hashes are the smallest; at most
    points x (colours + 1) rows, whatever the table.

    The hash is of the ``key`` columns (else of all), so the same rows come up each
    time. Counts of the segments say below which hash about ``points`` of their
    rows lie, with some to spare; only those are read and ranked, so no row is
    sorted that is not nearly drawn. A segment that was short of rows gets a
    wider bound.
    """
    a, b = number(x), number(y)
    name = shown(roles.dimension, kinds(df)[roles.dimension]) if roles.dimension else F.lit(None).cast("string")
    of = [shown(c, kinds(df)[c]) for c in key or user_columns(df)]
    # The first 13 hex digits are a whole number below 2^52, which a double holds.
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(c, F.lit("")) for c in of)).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    both = df.where(a.isNotNull() & b.isNotNull()).select(name.alias("segment"), a.alias("x"), b.alias("y"), spot.alias("spot"))
    sizes = both.groupBy("segment").agg(F.count("*").alias("rows"))
    top = {r["segment"]: r["rows"] for r in sizes.where("segment IS NOT NULL").orderBy(F.desc("rows"), "segment").limit(colours).collect()}
    rest = (sizes.agg(F.sum("rows")).first()[0] or 0) - sum(top.values())
    labelled = both.withColumn("segment", F.when(F.col("segment").isin(*top), F.col("segment")).otherwise(OTHERS if roles.dimension else None))
    found, wanted = [], {**top, **({(OTHERS if roles.dimension else None): rest} if rest else {})}
    spare = 4.0
    while wanted:
        bound = F.lit(None).cast("double")
        for segment, n in wanted.items():
            bound = F.when(F.col("segment").eqNullSafe(F.lit(segment)), F.lit(min(1.0, (points + spare * (points**0.5 + 1)) / n))).otherwise(bound)
        near = labelled.where(F.col("spot") <= bound)
        place = F.row_number().over(Window.partitionBy("segment").orderBy("spot", "x", "y"))
        drawn: dict[str | None, list] = {}
        for r in near.withColumn("place", place).where(F.col("place") <= points).select("segment", "x", "y").collect():
            drawn.setdefault(r["segment"], []).append(tuple(r))
        done = [s for s, n in wanted.items() if len(drawn.get(s, ())) >= min(points, n)]
        for s in done:
            found += drawn.get(s, [])
            del wanted[s]
        spare *= 8
    return df.sparkSession.createDataFrame(found, "segment string, x double, y double")
