"""The seeded example table of orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodeline.functions.shipping import ship

# Products with prices and shares, regions and channels with shares.
PRODUCTS = (("Core", 129.0, 0.40), ("Growth", 229.0, 0.27), ("Enterprise", 799.0, 0.11), ("Starter", 49.0, 0.22))
REGIONS = (("West", 0.31), ("Northeast", 0.27), ("South", 0.25), ("Midwest", 0.17))
CHANNELS = (("Direct", 0.45), ("Partner", 0.22), ("Self-serve", 0.33))
FIRST, LAST = np.datetime64("2024-01-01"), np.datetime64("2025-12-31")
SCHEMA = "`Order ID` string, `Order Date` timestamp_ntz, Product string, Region string, Channel string, Units long, Revenue double, Profit double"


def demo_rows(seed: int = 17, rows: int = 1800) -> list[tuple]:
    """The draws come in a fixed order, so that a seed gives the same table everywhere."""
    draw = np.random.default_rng(seed)
    pick = lambda table: draw.choice([t[0] for t in table], size=rows, p=[t[-1] for t in table])
    days = draw.choice(np.arange(FIRST, LAST + 1), size=rows)
    product, region, channel = pick(PRODUCTS), pick(REGIONS), pick(CHANNELS)
    units = draw.integers(1, 6, size=rows)
    day = (days - FIRST).astype(int)
    price = np.vectorize({name: p for name, p, _ in PRODUCTS}.get, otypes=[float])(product)
    trend = 1 + 0.28 * day / max(day.max(), 1)
    season = 1 + 0.13 * np.sin(2 * np.pi * day / 365)
    revenue = price * units * trend * season * np.where(region == "West", 1.10, 1) * np.where(product == "Enterprise", 1.18, 1) * draw.normal(1.0, 0.09, size=rows)
    profit = revenue * np.where(product == "Enterprise", 1 - 0.58, 1 - 0.67) - draw.uniform(4, 18, size=rows)
    order = np.argsort(days, kind="stable")
    return [(f"ORD-{100000 + k}", days[k].astype("datetime64[us]").item(), str(product[k]), str(region[k]), str(channel[k]), int(units[k]), round(float(revenue[k]), 2), round(float(profit[k]), 2)) for k in order.tolist()]


def demo(spark: SparkSession, seed: int = 17, rows: int = 1800) -> DataFrame:
    return ship(spark).createDataFrame(demo_rows(seed, rows), SCHEMA)
