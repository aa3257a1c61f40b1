"""Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodeline.operators.stats import profile
from lodeline.plans.model import Audit, Brief, Observation


def _blocks(*parts: str) -> str:
    return "\n\n".join(p for p in parts if p) + "\n"


def business_report(df: DataFrame, brief: Brief, *, source_name: str, context: str = "") -> str:
    """The brief with every calculation behind it."""
    facts = [f"**Source:** {source_name}", f"**Rows analyzed:** {df.count():,}"]
    if context.strip():
        facts.append(f"**Business context:** {context.strip()}")
    evidence = [f"### {e.title}: {e.value}\n\n{e.statement}\n\n*Calculation:* {e.calculation}" for e in brief.facts]
    steps = [f"### {s.when}: {s.title}\n\n{s.action}\n\n*Why:* {s.because}" for s in brief.steps]
    return _blocks("# Executive brief", "  \n".join(facts), "## Summary", brief.headline, brief.summary, "## Evidence", *(evidence or ["No signal was strong enough to report."]), "## Recommendations", *steps, "---", "Rules derive the recommendations from the calculations above; they are no proof of causes. No data left this system.")


def data_report(df: DataFrame, audit: Audit, insights: list[Observation], description: str = "") -> str:
    """Overview, observations and data dictionary."""
    columns = profile(df).orderBy("position").collect()
    rows = columns[0]["present"] + columns[0]["missing"] if columns else 0
    overview = [f"- Rows: {rows:,}", f"- Columns: {len(columns):,}", f"- Missing cells: {sum(c['missing'] for c in columns):,}", f"- Duplicate rows removed: {audit.operations['Duplicate rows removed']:,}"]
    dictionary = [f"- **{c['column']}**: {c['type']}, {c['missing_percent']:.2f}% missing, {c['distinct']:,} distinct" for c in columns]
    return _blocks("# Data analysis report", description.strip(), "## Dataset overview", "\n".join(overview), "## Key observations", "\n".join(f"- **{i.title}:** {i.text}" for i in insights), "## Data dictionary", "\n".join(dictionary))
