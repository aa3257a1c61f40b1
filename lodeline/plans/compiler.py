"""Query plans to DataFrames, and to worded answers.

``scoped`` and ``table_of`` are lazy; ``execute`` runs the plan and collects the
few rows that an answer names.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.columns import col, kinds, shown
from lodeline.functions.periods import UNITS, in_scope, preferred_grain
from lodeline.functions.text import format_number
from lodeline.operators import frames
from lodeline.plans.model import Answer, QueryPlan, Roles
from lodeline.plans.parser import MONTHS, parse

BREAKDOWN_ROWS = 12
LABELS = {"sum": "Total", "mean": "Average", "median": "Median", "max": "Maximum", "min": "Minimum", "count": "Count of"}


def check(plan: QueryPlan, df: DataFrame) -> None:
    used = [plan.measure, plan.dimension, plan.count_column, *(f.column for f in plan.filters)]
    if unknown := [c for c in used if c is not None and c not in df.columns]:
        raise ValueError(f"The plan names unknown columns: {', '.join(unknown)}")


def scoped(plan: QueryPlan, df: DataFrame, roles: Roles) -> tuple[DataFrame, list[str]]:
    """The plan's rows, and its filters in words. Years become ranges on the
    bare date column, which reach the scan."""
    of, words = kinds(df), []
    for f in plan.filters:
        df = df.where(shown(f.column, of[f.column]).isin(*f.values))
        words.append(f"{f.column} in ({', '.join(f.values)})")
    if plan.year or plan.month:
        when = " ".join(([MONTHS[plan.month - 1][0].title()] if plan.month else []) + ([str(plan.year)] if plan.year else []))
        if roles.date and roles.date in of:
            df = df.where(in_scope(roles.date, plan.year, plan.month))
            words.append(f"{roles.date} in {when}")
        else:
            words.append(f"no date column, so {when} is not applied")
    return df, words


def value_name(plan: QueryPlan) -> str:
    return f"{LABELS[plan.aggregation]} {plan.measure}" if plan.measure and plan.aggregation != "count" else "Rows"


def grain_for(plan: QueryPlan, rows: DataFrame, roles: Roles) -> str:
    return plan.grain or preferred_grain(rows, roles.date)


def table_of(plan: QueryPlan, df: DataFrame, roles: Roles) -> DataFrame:
    """The plan's result as a DataFrame."""
    check(plan, df)
    rows, _ = scoped(plan, df, roles)
    part = replace(roles, measure=plan.measure, dimension=plan.dimension)
    match plan.intent:
        case "count":
            return rows.agg((F.count_distinct(col(plan.count_column)) if plan.count_column else F.count(F.lit(1))).alias("value"))
        case "aggregate":
            return frames.scalar(rows, plan.measure, plan.aggregation)
        case "rank" | "breakdown":
            limit = (plan.top_n if plan.intent == "rank" else None) or BREAKDOWN_ROWS
            return frames.grouped(rows, plan.dimension, plan.measure, plan.aggregation, plan.ascending).limit(limit)
        case "trend":
            return frames.trend(rows, part, grain_for(plan, rows, roles))
        case "growth":
            grain = grain_for(plan, rows, roles)
            trend = frames.trend(rows, part, grain)
            if not plan.dimension:
                return frames.growth(trend)
            two = frames.last_two(trend)
            if len(two) < 2:
                raise ValueError("growth needs two periods")
            return frames.ranked_growth(frames.period_change(rows, part, grain, two[0][0], two[1][0]), plan.ascending, BREAKDOWN_ROWS)
    raise ValueError(f"unknown intent {plan.intent!r}")


def execute(plan: QueryPlan, df: DataFrame, roles: Roles) -> Answer:
    check(plan, df)
    rows, words = scoped(plan, df, roles)
    scope = f" · filtered to {', '.join(words)}" if words else ""
    phrase = f" for {'; '.join(words)}" if words else ""
    made = lambda answer, calculation, table=None, chart=None: Answer("", plan, answer, calculation + scope, table, chart)
    if rows.isEmpty():
        return made("No row is in that scope, so nothing was calculated.", "0 rows after filters")
    result = None if plan.intent == "growth" and plan.dimension else table_of(plan, df, roles)
    money = lambda x: format_number(x, plan.measure)

    if plan.intent == "count":
        n = result.first()["value"]
        if plan.count_column:
            return made(f"{plan.count_column} has {n:,} distinct values{phrase}.", f"count distinct {plan.count_column}", result)
        return made(f"The table has {n:,} rows{phrase}.", "row count", result)

    if plan.intent == "aggregate":
        r = result.first()
        return made(f"{LABELS[plan.aggregation]} {plan.measure}{phrase}: {money(r['value'])}, from {r['rows']:,} rows.", f"{plan.aggregation}({plan.measure})", result)

    if plan.intent in ("rank", "breakdown"):
        name = value_name(plan)
        top = result.collect()
        if not top:
            return made(f"{plan.dimension} is empty in that scope, so nothing was calculated.", f"{plan.aggregation} by {plan.dimension}")
        value = format_number(float(top[0]["value"]), None if name == "Rows" else plan.measure) if top[0]["value"] is not None else format_number(None)
        share = f" ({top[0]['share']:.1f}% of the total)" if "share" in result.columns and top[0]["share"] is not None else ""
        place = "lowest" if plan.ascending else "leading"
        table = result.withColumnsRenamed({"segment": plan.dimension, "value": name, "share": "Share %"})
        return made(f"{top[0]['segment']} is the {place} {plan.dimension} by {name}{phrase}: {value}{share}.", f"{plan.aggregation}({plan.measure or 'rows'}) by {plan.dimension}, {'ascending' if plan.ascending else 'descending'}, {len(top)} shown", table, "bar")

    what = plan.measure or "Records"
    if plan.intent == "trend":
        unit = UNITS[grain_for(plan, rows, roles)]
        series = result.collect()
        if len(series) < 2:
            return made("That scope has too few periods for a trend.", "trend needs at least 2 periods")
        first, last = series[0]["value"], series[-1]["value"]
        change = 100 * (last - first) / abs(first) if first else 0.0
        return made(f"{what} per {unit}{phrase} went from {money(first)} to {money(last)} ({change:+.1f}% over {len(series)} {unit}s).", f"sum({plan.measure or 'rows'}) per {unit}", result, "line")

    # growth
    grain = grain_for(plan, rows, roles)
    part = replace(roles, measure=plan.measure, dimension=plan.dimension)
    trend = frames.trend(rows, part, grain)
    two = frames.last_two(trend)
    if len(two) < 2:
        return made("That scope has too little history to measure a change.", "growth needs at least 2 periods")
    (before, previous), (now, latest) = two
    if plan.dimension:
        change = frames.period_change(rows, part, grain, before, now)
        ranked = frames.ranked_growth(change, plan.ascending, BREAKDOWN_ROWS)
        top = ranked.first()
        if top is None:
            return made("No segment has a value in the earlier period, so no rate is defined.", f"growth by {plan.dimension} undefined")
        pace = "slowest" if plan.ascending else "fastest"
        table = ranked.withColumnsRenamed({"segment": plan.dimension, "previous": "Previous", "latest": "Latest", "change_percent": "Change %"})
        return made(f"{top['segment']} moved {pace}{phrase}: {top['change_percent']:+.1f}% (from {money(top['previous'])} to {money(top['latest'])}) in the latest period.", f"{plan.measure or 'row count'} by {plan.dimension}, latest against previous period, by change in percent", table, "bar")
    if not previous:
        return made("The earlier period is zero, so no growth rate is defined.", "growth undefined for a zero base")
    change = 100 * (latest - previous) / abs(previous)
    return made(f"{what}{phrase} is {'up' if change >= 0 else 'down'} {abs(change):.1f}% on the period before (from {money(previous)} to {money(latest)}).", "(latest − previous) ÷ |previous| of period sums", trend, "line")


def figure(result: Answer) -> DataFrame | None:
    """What an answer's figure shows, in the order in which it is drawn: (label,
    value) of a bar for each segment, smallest first, or (period, value) of a
    line. Bars show a change in percent where there is one, else the first value."""
    if result.table is None or result.chart is None:
        return None
    names = result.table.columns
    if result.chart == "line":
        return result.table.select("period", "value").orderBy("period") if {"period", "value"} <= set(names) else None
    value = "Change %" if "Change %" in names else names[1]
    return result.table.select(col(names[0]).cast("string").alias("label"), col(value).cast("double").alias("value")).orderBy(F.asc_nulls_first("value"), F.desc("label"))


def answer(question: str, df: DataFrame, roles: Roles, values: dict[str, list[str]] | None = None) -> Answer | None:
    """Parse and execute; None where the rules can't read or run the question."""
    plan = parse(question, df, roles, values)
    if plan is None:
        return None
    try:
        return replace(execute(plan, df, roles), question=question)
    except ValueError:
        return None
