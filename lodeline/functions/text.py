"""Wording: normal forms of names, numbers and period labels."""

from __future__ import annotations

import math
import re
from datetime import datetime

# Parts of names that mean money.
CURRENCY_PARTS = ("revenue", "sales", "gmv", "profit", "amount", "income", "spend", "cost", "expense", "price", "balance")
_STEPS = ((1e9, "B"), (1e6, "M"), (1e3, "K"))
MISSING = "—"


def spaced(name: str) -> str:
    """Lower case with underscores and hyphens as spaces (role scoring)."""
    return re.sub(r"[_-]", " ", str(name)).lower()


def plain(text: object) -> str:
    """Lower-case letters and digits in single spaces (questions)."""
    return " ".join(re.findall(r"[0-9a-z]+", str(text).lower()))


def is_currency(column: str | None) -> bool:
    return column is not None and any(part in spaced(column) for part in CURRENCY_PARTS)


def format_number(value: float | None, column: str | None = None, *, compact: bool = True) -> str:
    if value is None or not math.isfinite(value):
        return MISSING
    money = "$" if is_currency(column) else ""
    if compact:
        for step, letter in _STEPS:
            if abs(value) >= step:
                return f"{money}{value / step:,.1f}{letter}"
    if not money and value == int(value):
        return format(int(value), ",")
    return f"{money}{value:,.2f}"


def format_period(period: datetime, grain: str) -> str:
    match grain:
        case "Q":
            return f"Q{(period.month + 2) // 3} {period.year}"
        case "D" | "W":
            return f"{period:%d %b %Y}"
        case "Y":
            return f"{period:%Y}"
    return f"{period:%b %Y}"
