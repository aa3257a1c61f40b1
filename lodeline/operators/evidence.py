"""Evidence, recommendations and the brief: rules over computed frames.

Executors aggregate; the driver words at most a few hundred collected rows. A
brief asks the table four times: for all single-row aggregates, for exact numbers
of few distinct values, for segments by period, and for outliers of the measure.
The last takes more passes where the measure has over ``stats.SMALL`` values,
and identifiers near their limit, or shown by their number, take one of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodeline.functions.columns import col, kinds, number
from lodeline.functions.periods import grain_of, span_days
from lodeline.functions.text import format_number, format_period, spaced
from lodeline.operators import frames, stats, timeseries
from lodeline.operators.roles import TIME_PARTS, choose_roles, is_identifier, role_stats
from lodeline.plans.model import Brief, Fact, Observation, Roles, Step, Tile

# Fixed values.
CORRELATION_FLOOR = 0.45
LEAST_FOR_OUTLIERS, LEAST_DISTINCT = 12, 4
INSIGHT_LEAST, INSIGHT_DISTINCT = 8, 3
CONCENTRATED, INCOMPLETE, MISSING_WARNING = 70.0, 5.0, 20.0
MOST_FACTS, MOST_RECOMMENDATIONS, TILES, MOST_INSIGHTS = 6, 4, 4, 6


@dataclass
class Findings:
    """Computed facts of one table, each at most once."""

    df: DataFrame
    given: Roles | None = None

    @cached_property
    def candidates(self) -> list[str]:
        """Numeric columns that a correlation may be about, before identifiers are known."""
        numeric = self.given.numeric if self.given else [n for n, k in kinds(self.df).items() if k == "numeric"]
        return [c for c in numeric if spaced(c) not in TIME_PARTS]

    @cached_property
    def first(self) -> Row:
        """All single-row aggregates: counts, sums and means of what can be the
        measure, ends of what can be the date, and correlations."""
        of = kinds(self.df)
        measures = [self.given.measure] if self.given else [n for n, k in of.items() if k == "numeric"]
        dates = [self.given.date] if self.given else [n for n, k in of.items() if k == "datetime"]
        wanted = []
        for m in filter(None, measures):
            wanted += [F.coalesce(F.sum(number(m)), F.lit(0.0)).alias(f"sum {m}"), F.avg(number(m)).alias(f"mean {m}")]
        wanted += [span_days(F.min(col(d)), F.max(col(d))).alias(f"days {d}") for d in filter(None, dates)]
        if len(self.candidates) <= stats.WIDE:
            wanted += [stats.pearson(a, b).alias(f"r{k}") for k, (a, b) in enumerate(combinations(self.candidates, 2))]
        return stats.first_pass(self.df, wanted)

    @cached_property
    def columns(self) -> dict[str, stats.ColumnStats]:
        return role_stats(self.df, self.first)

    def distinct_of(self, column: str) -> int:
        """An exact number of distinct values, for display."""
        s = self.columns[column]
        return s.distinct if s.exact else stats.column_stats(self.df.select(col(column)), exact=[column])[column].distinct

    @cached_property
    def roles(self) -> Roles:
        return self.given or choose_roles(self.columns)

    @cached_property
    def rows(self) -> int:
        return next((s.rows for s in self.columns.values()), 0)

    @cached_property
    def missing(self) -> int:
        return sum(s.missing for s in self.columns.values())

    @cached_property
    def usable(self) -> list[str]:
        """Numeric columns that a correlation may be about."""
        return [c for c in self.candidates if not is_identifier(self.columns[c])]

    def of_measure(self, what: str) -> float | None:
        return self.first[f"{what} {self.roles.measure}"]

    @cached_property
    def pair(self) -> tuple[str, str, float] | None:
        """The columns with the strongest correlation; the first of equals."""
        if len(self.candidates) > stats.WIDE:
            row = stats.strongest_pair(self.df, self.usable).first()
            return row and (row["left"], row["right"], row["r"])
        pairs = [(a, b, self.first[f"r{k}"]) for k, (a, b) in enumerate(combinations(self.candidates, 2))]
        found = [(a, b, r) for a, b, r in pairs if a in self.usable and b in self.usable and r is not None and r == r]
        return max(found, key=lambda x: abs(x[2]), default=None)

    @cached_property
    def grain(self) -> str:
        return grain_of(self.first[f"days {self.roles.date}"])

    @cached_property
    def cube(self) -> frames.Cube:
        return frames.cube(self.df, self.roles, self.grain if self.roles.date else None)

    @property
    def trend(self) -> list[tuple]:
        return self.cube.trend


def trend_fact(f: Findings) -> Fact | None:
    if len(f.trend) < 2 or not f.trend[-2][1]:
        return None
    (_, before), (period, now) = f.trend[-2:]
    change = 100 * (now - before) / abs(before)
    what = f.roles.measure or "Records"
    money = lambda x: format_number(x, f.roles.measure)
    text = f"{what} {'rose' if change >= 0 else 'fell'} {abs(change):.1f}% in {format_period(period, 'M')}, the latest period, from {money(before)} to {money(now)}."
    return Fact("trend", change, text, "(latest period − period before) ÷ |period before|", what, tone="positive" if change >= 0 else "negative")


def driver_fact(f: Findings) -> Fact | None:
    r, d = f.roles, f.cube.driver
    if not (r.date and r.measure and r.dimension) or d is None or not d.change:
        return None
    money = lambda x: format_number(x, r.measure)
    share = abs(d.change / d.net) * 100
    text = f"Among {r.dimension} values, {d.segment} moved the total most: {r.measure} {'grew' if d.change > 0 else 'shrank'} by {money(abs(d.change))}, from {money(d.previous)} to {money(d.latest)}, or {share:.1f}% of the net change."
    return Fact("driver", d.change, text, f"latest − previous {r.measure} by {r.dimension}, largest in the net direction", r.measure, str(d.segment), "positive" if d.change > 0 else "negative")


def segment_facts(f: Findings) -> list[Fact]:
    r, top = f.roles, f.cube.top
    if not r.dimension or not top or not f.cube.total:
        return []
    what, (name, first) = r.measure or "records", top[0]
    leader, three = 100 * first / f.cube.total, 100 * sum(v for _, v in top[:3]) / f.cube.total
    return [
        Fact("leader", leader, f"{name} has the most {what} of all {r.dimension} values: {format_number(first, r.measure)}, {leader:.1f}% of the total.", f"{what} of {name} ÷ total {what}", r.dimension, str(name), "positive"),
        Fact("concentration", three, f"Three {r.dimension} values hold {three:.1f}% of {what}.", f"{what} of the three largest ÷ total {what}", r.dimension, tone="warning" if three >= CONCENTRATED else "neutral"),
    ]


def anomaly_fact(f: Findings) -> Fact | None:
    found = timeseries.unusual(f.trend)
    if not found:
        return None
    a, money = found[0], lambda x: format_number(x, f.roles.measure)
    many = f"{len(found)} period{'s are' if len(found) > 1 else ' is'} outside the band."
    text = f"{format_period(a.period, f.grain)} stands out most: {money(a.value)} is {a.direction} the expected {money(a.band[0])} to {money(a.band[1])}. {many}"
    return Fact("anomaly", len(found), text, "period totals against a median-slope line ± 3 scaled MAD", tone="warning")


def relationship_fact(f: Findings) -> Fact | None:
    if f.pair is None or abs(f.pair[2]) < CORRELATION_FLOOR:
        return None
    left, right, r = f.pair
    way = "rise and fall together" if r > 0 else "move against each other"
    return Fact("relationship", r, f"{left} and {right} {way} (Pearson r {r:.2f}). This is association; it doesn't show a cause.", "Pearson correlation over rows with both values", f"{left}, {right}")


def outlier_fact(f: Findings) -> Fact | None:
    m = f.roles.measure
    if not m or f.columns[m].present < LEAST_FOR_OUTLIERS or f.columns[m].distinct < LEAST_DISTINCT:
        return None
    if f.columns[m].present <= stats.SMALL:
        n, percent = stats.few_outliers(f.df, m)
    else:
        n, percent = stats.iqr_outliers(f.df, [m]).select("outliers", "percent").first()
    if not n:
        return None
    return Fact("outliers", n, f"{n:,} values of {m} ({percent:.1f}% of those present) are beyond 1.5 interquartile ranges.", "below Q1 − 1.5 IQR or above Q3 + 1.5 IQR", m, tone="warning")


def quality_fact(f: Findings) -> Fact | None:
    cells = f.rows * len(f.columns)
    if not cells or not f.missing:
        return None
    rate = 100 * f.missing / cells
    return Fact("quality", 100 - rate, f"{f.missing:,} of {cells:,} cells are missing: the table is {100 - rate:.1f}% complete.", "present cells ÷ all cells", tone="warning" if rate >= INCOMPLETE else "neutral")


def recommend(facts: list[Fact], roles: Roles) -> tuple[Step, ...]:
    """At most four, in a fixed order of the kinds of facts."""
    by = {e.kind: e for e in facts}
    segment, out = roles.dimension or "segment", []
    trend, driver = by.get("trend"), by.get("driver")
    if trend:
        why = trend.statement + (f" {driver.statement}" if driver else "")
        who = driver.subject if driver else ""
        if trend.tone == "negative":
            title = f"Start with {who}" if who else "Locate the decline"
            action = f"Trace the fall in {who} to customers, channels and single transactions, and tell volume from price and mix." if who else f"Compare each {segment} of the latest period with the one before."
        else:
            title = f"Make {who}'s growth repeatable" if who else "Protect what grew"
            action = f"Split the rise of {who} into volume, price and mix, and try what repeats in another {segment}." if who else f"Find the {segment} behind the rise and test whether it lasts."
        out.append(Step("Now", title, action, why))
    leader, concentration = by.get("leader"), by.get("concentration")
    if concentration and concentration.tone == "warning":
        out.append(Step("Next", "Reduce concentration risk", f"Work out what a fall of the leading {segment} by a tenth or a fifth would do, and plan growth for the two after it.", concentration.statement))
    elif leader:
        out.append(Step("Next", "Learn from the leader", f"Set the leading {segment} beside the median one on price, volume and mix, and carry over what can be controlled.", leader.statement))
    rest = (
        ("anomaly", "Now", "Explain the unusual periods", "Find the event behind each one, such as a promotion, an outage, a price change or an error, before it enters targets."),
        ("relationship", "Test", "Check the relationship", "See whether it holds within segments and over time; if so, try a small change and measure it."),
        ("outliers", "Watch", "Review exceptional records", "Look at the largest ones for input errors, refunds and unusual deals before they bend plans."),
    )
    out += [Step(when, title, action, by[kind].statement) for kind, when, title, action in rest if kind in by]
    if "quality" in by and by["quality"].tone == "warning":
        out.append(Step("Fix", "Fill the measurement gaps", "Begin with missing fields that totals, margins, customers or dates depend on.", by["quality"].statement))
    if not out:
        out.append(Step("Next", "Add decision context", "Bring a date, an outcome such as revenue or cost, and a segment such as product or region.", "The table has too little structure for a more specific step."))
    return tuple(out[:MOST_RECOMMENDATIONS])


def tiles(f: Findings, facts: list[Fact]) -> tuple[Tile, ...]:
    r, by, out = f.roles, {e.kind: e for e in facts}, []
    if r.measure:
        out += [Tile(f"Total {r.measure}", f.of_measure("sum"), "All records", r.measure), Tile(f"Average {r.measure}", f.of_measure("mean"), "Per record with a value", r.measure)]
    if "trend" in by:
        out.append(Tile("Latest movement", by["trend"].value, "Against the period before", tone=by["trend"].tone))
    if "leader" in by:
        out.append(Tile(f"Top {r.dimension}", by["leader"].value, "Share of the leader"))
    if r.identifier and len(out) < TILES:
        out.append(Tile(f"Distinct {r.identifier}", f"{f.distinct_of(r.identifier):,}", "Different entities"))
    out.append(Tile("Records analyzed", f"{f.rows:,}", "After cleaning"))
    cells = f.rows * len(f.columns)
    while len(out) < TILES:
        out.append(Tile("Data completeness", f"{100 - 100 * f.missing / max(cells, 1):.1f}%", "Present cells"))
    return tuple(out[:TILES])


def all_facts(f: Findings) -> list[Fact]:
    found = [trend_fact(f), driver_fact(f), *segment_facts(f), anomaly_fact(f), relationship_fact(f), outlier_fact(f), quality_fact(f)]
    return [e for e in found if e]


def analyze(df: DataFrame, roles: Roles | None = None) -> Brief:
    f = Findings(df, roles)
    facts = all_facts(f)
    by = {e.kind: e for e in facts}
    r, growth, leader = f.roles, by.get("trend"), by.get("leader")
    if growth and leader:
        headline = f"Latest movement {growth.value}; {leader.value} comes from the leading {r.dimension}."
    elif growth or leader:
        headline = (growth or leader).statement
    elif r.measure:
        headline = f"{r.measure} adds up to {format_number(f.of_measure('sum'), r.measure)}."
    else:
        headline = f"{f.rows:,} records are ready to review."
    summary = " ".join(e.statement for e in (growth, leader) if e) or "No trend or segment stands out; what was calculated is listed as evidence."
    return Brief(r, headline, summary, tuple(facts[:MOST_FACTS]), recommend(facts, r), tiles(f, facts))


def evidence_frame(df: DataFrame, brief: Brief) -> DataFrame:
    rows = [(k, e.kind, e.title, e.value, float(e.number), e.subject, e.statement, e.calculation, e.tone) for k, e in enumerate(brief.facts)]
    return df.sparkSession.createDataFrame(rows, "position int, kind string, title string, value string, number double, subject string, statement string, calculation string, tone string")


def insights(df: DataFrame, limit: int = MOST_INSIGHTS) -> list[Observation]:
    """Generic observations without roles."""
    of, columns, out = kinds(df), stats.column_stats(df), []
    rows = next((s.rows for s in columns.values()), 0)
    worst = max(columns.values(), key=lambda s: s.missing, default=None)
    if worst and worst.missing:
        rate = 100 * worst.missing / rows
        out.append(Observation("warning" if rate >= MISSING_WARNING else "info", "Missing data deserves attention", f"{worst.name} lacks {rate:.1f}% of its values, more than any other column."))
    numeric = [n for n, k in of.items() if k == "numeric"]
    pair = stats.strongest_pair(df, numeric).first() if len(numeric) > 1 else None
    if pair:
        out.append(Observation("info", "Strongest numeric relationship", f"{pair['left']} and {pair['right']}: Pearson correlation {pair['r']:.2f}. Correlation isn't causation."))
    tested = [n for n in numeric if columns[n].present >= INSIGHT_LEAST and columns[n].distinct >= INSIGHT_DISTINCT]
    found = [r for r in stats.iqr_outliers(df, tested).collect() if r["outliers"]] if tested else []
    if found:
        r = max(found, key=lambda r: (r["percent"], -tested.index(r["column"])))
        out.append(Observation("warning", "Potential outliers", f"{r['column']} has {r['outliers']:,} values ({r['percent']:.1f}%) beyond 1.5 interquartile ranges."))
    modes = [m for n, k in of.items() if k != "numeric" and 0 < columns[n].distinct <= stats.MODE_DISTINCT and (m := stats.mode_share(df, n).first())]
    if modes:
        m = max(modes, key=lambda m: m["percent"])
        out.append(Observation("info", "Largest category share", f"{m['value']} makes up {m['percent']:.1f}% of the present values of {m['column']}."))
    times = [n for n, k in of.items() if k == "datetime"]
    if times and (t := stats.time_coverage(df, times[0]).first())["first"] is not None:
        out.append(Observation("info", "Time coverage", f"{times[0]} runs from {t['first']:%Y-%m-%d} to {t['last']:%Y-%m-%d}."))
    return out[:limit] or [Observation("success", "Dataset is ready to explore", f"{rows:,} rows in {len(columns):,} columns, without quality flags.")]
