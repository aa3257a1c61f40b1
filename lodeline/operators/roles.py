"""Which columns are the date, the measure, the segment and the identifier."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodeline.functions.columns import col, kinds, shown
from lodeline.functions.text import spaced
from lodeline.operators.stats import ColumnStats, column_stats
from lodeline.plans.model import Roles

# Scores of name parts, whole-word marks and limits.
MEASURE_SCORES = {
    "revenue": 14, "sales": 14, "gmv": 14, "profit": 13, "margin": 12, "amount": 11, "value": 10, "income": 10, "spend": 9,
    "cost": 8, "expense": 8, "price": 7, "quantity": 6, "units": 6, "orders": 6, "volume": 6, "balance": 6, "score": 4,
}
DIMENSION_SCORES = {
    "product": 12, "category": 12, "segment": 12, "region": 11, "country": 10, "channel": 10, "state": 9, "city": 9,
    "customer": 8, "client": 8, "team": 7, "department": 7, "status": 6, "type": 5,
}
IDENTIFIER_WORDS = frozenset(("id", "uuid", "key", "code", "number", "invoice", "order"))
TIME_PARTS = ("year", "month", "week", "day", "hour", "minute", "quarter")
IDENTIFIER_RATIO = 0.8
IDENTIFIER_PENALTY, TIME_PENALTY = 20, 15
LEAST_SEGMENTS, MOST_SEGMENTS, MOST_SEGMENT_RATIO = 2, 100, 0.65
DATE_PARTS = ("date", "time", "created")


def score(name: str, table: dict[str, int]) -> int:
    return max((points for part, points in table.items() if part in spaced(name)), default=0)


def is_marked(name: str) -> bool:
    return not IDENTIFIER_WORDS.isdisjoint(re.findall(r"[^\W_]+", spaced(name)))


def is_identifier(s: ColumnStats) -> bool:
    """A whole-word mark in the name, and mostly distinct values."""
    return is_marked(s.name) and s.distinct / max(s.present, 1) >= IDENTIFIER_RATIO


def is_time_part(name: str) -> bool:
    words = spaced(name)
    return any(words == part or words.endswith(" " + part) for part in TIME_PARTS)


def choose_roles(stats: dict[str, ColumnStats]) -> Roles:
    """Roles from statistics alone; first columns win ties."""
    every = list(stats.values())
    numeric = [s for s in every if s.kind == "numeric"]
    dates = [s for s in every if s.kind == "datetime"]

    def as_measure(s: ColumnStats) -> tuple[float, float]:
        points = score(s.name, MEASURE_SCORES) - IDENTIFIER_PENALTY * is_identifier(s) - TIME_PENALTY * is_time_part(s.name)
        return points, s.present / max(s.rows, 1)

    def groups(s: ColumnStats) -> bool:
        return s.kind not in ("numeric", "datetime") and LEAST_SEGMENTS <= s.distinct <= MOST_SEGMENTS and s.distinct / max(s.present, 1) <= MOST_SEGMENT_RATIO

    segments = [s for s in every if groups(s)]
    name = lambda s: s and s.name
    return Roles(
        date=name(max(dates, key=lambda s: (any(p in spaced(s.name) for p in DATE_PARTS), s.present), default=None)),
        measure=name(max(numeric, key=as_measure, default=None)),
        dimension=name(max(segments, key=lambda s: (score(s.name, DIMENSION_SCORES), -abs(s.distinct - 10)), default=None)),
        identifier=name(next((s for s in every if is_identifier(s)), None)),
        numeric=tuple(s.name for s in numeric),
        dimensions=tuple(s.name for s in segments),
    )


def role_stats(df: DataFrame, first: Row | None = None) -> dict[str, ColumnStats]:
    """Statistics that are as exact as roles need them."""
    return column_stats(df, near={n: IDENTIFIER_RATIO for n in kinds(df) if is_marked(n)}, first=first)


def detect_roles(df: DataFrame) -> Roles:
    return choose_roles(role_stats(df))


def override_roles(roles: Roles, *, date: str | None = None, measure: str | None = None, dimension: str | None = None) -> Roles:
    """Replaces the roles that are given."""
    return replace(roles, date=date or roles.date, measure=measure or roles.measure, dimension=dimension or roles.dimension)


def select_roles(detected: Roles, *, date: str, measure: str, dimension: str) -> Roles:
    """A user's selection, where "None" clears a role."""
    picked = {k: None if v == "None" else v for k, v in {"date": date, "measure": measure, "dimension": dimension}.items()}
    return replace(detected, **picked)


def focus_options(df: DataFrame, roles: Roles, limit: int = 40) -> DataFrame:
    """(value, rows) of the segment, most common first."""
    value = shown(roles.dimension, kinds(df)[roles.dimension])
    return df.where(col(roles.dimension).isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "value").limit(limit)


def apply_focus(df: DataFrame, roles: Roles, focus: str | None) -> tuple[DataFrame, Roles]:
    """The slice of one segment value, regrouped by the next dimension that
    still has two values in it. An empty slice changes nothing."""
    if not focus or not roles.dimension:
        return df, roles
    of = kinds(df)
    part = df.where(shown(roles.dimension, of[roles.dimension]) == focus)
    rest = [d for d in roles.dimensions if d != roles.dimension and d in of]
    # Two values or more: the smallest and the largest differ, which needs no distinct count.
    seen = part.agg(F.count(F.lit(1)).alias("rows"), *((F.min(shown(d, of[d])) < F.max(shown(d, of[d]))).alias(f"d{k}") for k, d in enumerate(rest))).first()
    if not seen["rows"]:
        return df, roles
    following = next((d for k, d in enumerate(rest) if seen[f"d{k}"]), None)
    return part, replace(roles, dimension=following)


def schema_rows(roles: Roles) -> list[tuple[str, str]]:
    """Role and column, for display."""
    named = (("Primary metric", roles.measure), ("Business segment", roles.dimension), ("Date", roles.date), ("Identifier", roles.identifier))
    return [(role, column or "Not detected") for role, column in named]


def schema_frame(df: DataFrame, roles: Roles) -> DataFrame:
    return df.sparkSession.createDataFrame(schema_rows(roles), "role string, column string")
