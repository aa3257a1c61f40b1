"""Robust trend lines: anomalies and guarded forecasts on (period, value).

The line's slope is the median step between neighbouring periods and its
intercept the median of what is left. Residuals are measured by their median
magnitude, scaled to a standard deviation.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from statistics import fmean, median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.plans.model import Anomaly, Forecast

# Fixed values.
LEAST_PERIODS = 8
LEAST_SEASONAL = 18
BAND = 3.0
FORECAST_BAND = 2.0
MAD_SCALE = 1.4826
HOUR = 3_600_000_000  # microseconds
DAY = 24 * HOUR


def fitted(trend: DataFrame) -> DataFrame:
    """Adds position, expected value, residual and robust spread of the whole series."""
    t = trend.select("period", F.col("value").cast("double").alias("value"))
    t = t.withColumn("position", F.row_number().over(Window.orderBy("period")) - 1).withColumn("step", F.col("value") - F.lag("value").over(Window.orderBy("period")))
    t = t.withColumn("slope", F.median("step").over(Window.partitionBy())).withColumn("n", F.count("*").over(Window.partitionBy()))
    t = t.withColumn("intercept", F.median(F.col("value") - F.col("slope") * F.col("position")).over(Window.partitionBy()))
    t = t.withColumn("expected", F.col("intercept") + F.col("slope") * F.col("position"))
    t = t.withColumn("residual", F.col("value") - F.col("expected"))
    mad, mean = F.median(F.abs("residual")).over(Window.partitionBy()) * MAD_SCALE, F.avg(F.abs("residual")).over(Window.partitionBy())
    return t.withColumn("spread", F.when(mad == 0, mean).otherwise(mad)).drop("step")


def anomaly_band(trend: DataFrame, threshold: float = BAND, least: int = LEAST_PERIODS) -> DataFrame:
    """(period, value, expected_low, expected_high, severity, is_anomaly) of each period."""
    f = fitted(trend)
    off = F.abs("residual") > threshold * F.col("spread")
    return f.select(
        "period",
        "value",
        (F.col("expected") - threshold * F.col("spread")).alias("expected_low"),
        (F.col("expected") + threshold * F.col("spread")).alias("expected_high"),
        F.bround(F.try_divide(F.abs("residual"), F.col("spread")), 2).alias("severity"),
        F.when(F.col("residual") > 0, "above").otherwise("below").alias("direction"),
        F.coalesce(off & (F.col("spread") > 0) & (F.col("n") >= least), F.lit(False)).alias("is_anomaly"),
    )


def anomalies(trend: DataFrame, threshold: float = BAND, least: int = LEAST_PERIODS, limit: int = 5) -> DataFrame:
    """The most severe anomalies; ties by period."""
    return anomaly_band(trend, threshold, least).where("is_anomaly").drop("is_anomaly").orderBy(F.desc("severity"), "period").limit(limit)


def detect_anomalies(trend: DataFrame, *, min_periods: int = LEAST_PERIODS, threshold: float = BAND, limit: int = 5) -> tuple[Anomaly, ...]:
    return tuple(Anomaly(r["period"], r["value"], (r["expected_low"], r["expected_high"]), r["severity"]) for r in anomalies(trend, threshold, min_periods, limit).collect())


def seasonal_medians(trend: DataFrame) -> DataFrame:
    """(month, residual): median residual of calendar months seen at least twice."""
    f = fitted(trend)
    return f.groupBy(F.month("period").alias("month")).agg(F.median("residual").alias("residual"), F.count("*").alias("n")).where("n >= 2").drop("n")


# Forecasts work on the collected series: a row for each period, a few hundred at most.


def unusual(series: list[tuple[datetime, float]], threshold: float = BAND, limit: int = 5) -> list[Anomaly]:
    """The anomalies of a collected series, as ``anomalies`` finds them in a frame."""
    if len(series) < LEAST_PERIODS:
        return []
    line = Line([p for p, _ in series], [v for _, v in series], False)
    off = [v - line.at(i, p.month) for i, (p, v) in enumerate(series)]
    spread = median(map(abs, off)) * MAD_SCALE or fmean(map(abs, off))
    found = [Anomaly(p, v, (v - x - threshold * spread, v - x + threshold * spread), round(abs(x) / spread, 2)) for (p, v), x in zip(series, off) if spread and abs(x) > threshold * spread]
    return sorted(found, key=lambda a: (-a.severity, a.period))[:limit]


class Line:
    def __init__(self, periods: list[datetime], values: list[float], seasonal: bool):
        steps = [b - a for a, b in zip(values, values[1:])]
        self.slope = median(steps) if steps else 0.0
        self.intercept = median(v - self.slope * i for i, v in enumerate(values))
        self.months: dict[int, float] = {}
        if seasonal:
            left: dict[int, list[float]] = {}
            for i, (p, v) in enumerate(zip(periods, values)):
                left.setdefault(p.month, []).append(v - self.intercept - self.slope * i)
            self.months = {m: median(r) for m, r in left.items() if len(r) >= 2}

    def at(self, position: int, month: int) -> float:
        return self.intercept + self.slope * position + self.months.get(month, 0.0)


def is_monthly(periods: list[datetime]) -> bool:
    return len(periods) >= 3 and all(28 <= (b - a).days <= 31 for a, b in zip(periods, periods[1:]))


def add_months(t: datetime, months: int) -> datetime:
    k = t.year * 12 + t.month - 1 + months
    return t.replace(year=k // 12, month=k % 12 + 1)


def regular_step(periods: list[datetime]) -> int | timedelta:
    """Months between periods where all start on a first and step evenly; else
    the median gap."""
    if all(p.day == 1 for p in periods):
        gaps = {(b.year - a.year) * 12 + b.month - a.month for a, b in zip(periods, periods[1:])}
        if len(gaps) == 1 and gaps <= {1, 3, 12}:
            return gaps.pop()
    seconds = median((b - a).total_seconds() for a, b in zip(periods, periods[1:]))
    return timedelta(seconds=seconds)


def backtest(periods: list[datetime], values: list[float]) -> tuple[float | None, int]:
    """(mean absolute error in percent, held-out periods) of a refit on the earlier part."""
    n = len(values)
    held = min(max(3, n // 5), n - 5)
    cut = n - held
    if cut < 5:
        return None, 0
    line = Line(periods[:cut], values[:cut], is_monthly(periods) and cut >= LEAST_SEASONAL)
    errors = [abs(line.at(i, periods[i].month) - values[i]) / abs(values[i]) for i in range(cut, n) if abs(values[i]) > 1e-9]
    return (round(fmean(errors) * 100, 1) if errors else None), held


def forecast_series(periods: list[datetime], values: list[float], horizon: int = 6, least: int = LEAST_PERIODS) -> Forecast | None:
    n = len(values)
    if n < least:
        return None
    line = Line(periods, values, is_monthly(periods) and n >= LEAST_SEASONAL)
    residuals = [abs(v - line.at(i, p.month)) for i, (p, v) in enumerate(zip(periods, values))]
    band = FORECAST_BAND * (median(residuals) * MAD_SCALE or fmean(residuals))
    step = regular_step(periods)
    ahead = range(1, max(1, min(horizon, n // 2)) + 1)
    future = [add_months(periods[-1], step * k) if isinstance(step, int) else periods[-1] + step * k for k in ahead]
    floor = 0.0 if min(values) >= 0 else float("-inf")
    predicted = [max(line.at(n - 1 + k, p.month), floor) for k, p in zip(ahead, future)]
    error, held = backtest(periods, values)
    method = "Median-slope line" + (" with month-of-year seasonality" if line.months else "") + f"; band of ±{FORECAST_BAND:g} robust deviations"
    return Forecast(tuple((t, p, max(p - band, floor), p + band) for t, p in zip(future, predicted)), error, held, method)


def build_forecast(trend: DataFrame, *, horizon: int = 6, min_periods: int = LEAST_PERIODS) -> Forecast | None:
    rows = trend.orderBy("period").collect()
    return forecast_series([r["period"] for r in rows], [float(r["value"]) for r in rows], horizon, min_periods)


# Forecasts of many series at once, as one plan over (segment, period, value).


def micros(t: Column) -> Column:
    """Microseconds of a local time since 1970, in no zone."""
    return F.unix_date(t.cast("date")) * DAY + F.hour(t) * HOUR + F.minute(t) * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def forecast_by_segment(series: DataFrame, horizon: int = 6, least: int = LEAST_PERIODS) -> DataFrame:
    """(segment, period, value, lower, upper): what ``forecast_series`` gives for
    each segment of at least ``least`` periods. Medians, seasons and future
    periods are columns, so nothing is collected, however many segments there are."""
    own = Window.partitionBy("segment").orderBy("period")
    t = series.where("segment IS NOT NULL AND period IS NOT NULL").select("segment", F.col("period").cast("timestamp_ntz").alias("period"), F.col("value").cast("double").alias("value"))
    before = F.lag("period").over(own)
    months = (F.year("period") - F.year(before)) * 12 + F.month("period") - F.month(before)
    t = t.withColumns({"position": F.row_number().over(own) - 1, "step": F.col("value") - F.lag("value").over(own), "gap": micros(F.col("period")) - micros(before), "months": months})
    days = F.floor(F.col("gap") / DAY)
    shape = t.groupBy("segment").agg(
        F.count("*").alias("n"), F.max("period").alias("last"), F.coalesce(F.median("step"), F.lit(0.0)).alias("slope"), F.min("value").alias("least"), F.median("gap").alias("gap_"),
        (F.coalesce(F.bool_and(days.between(28, 31)), F.lit(False)) & (F.count("*") >= LEAST_SEASONAL)).alias("seasonal"),
        F.when(F.bool_and(F.dayofmonth("period") == 1) & (F.min("months") == F.max("months")) & F.max("months").isin(1, 3, 12), F.max("months")).alias("every"),
    ).where(F.col("n") >= least)
    t = t.select("segment", "period", "value", "position").join(shape.select("segment", "slope", "seasonal"), "segment")
    cut = t.groupBy("segment").agg(F.median(F.col("value") - F.col("slope") * F.col("position")).alias("intercept"))
    left = t.join(cut, "segment").withColumn("residual", F.col("value") - F.col("intercept") - F.col("slope") * F.col("position")).withColumn("month", F.month("period"))
    season = left.where("seasonal").groupBy("segment", "month").agg(F.median("residual").alias("season"), F.count("*").alias("seen")).where("seen >= 2").drop("seen")
    rest = F.abs(F.col("residual") - F.coalesce("season", F.lit(0.0)))
    spread = left.join(season, ["segment", "month"], "left").groupBy("segment", "intercept").agg(F.median(rest).alias("mid"), F.avg(rest).alias("mean"))
    spread = spread.select("segment", "intercept", (FORECAST_BAND * F.when(F.col("mid") == 0, F.col("mean")).otherwise(F.col("mid") * MAD_SCALE)).alias("band"))
    ahead = shape.join(spread, "segment").withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(horizon), F.floor(F.col("n") / 2))).cast("int"))))
    period = F.when(F.col("every").isNotNull(), F.col("last") + F.make_ym_interval(F.lit(0), F.col("every") * F.col("k"))).otherwise(F.col("last") + F.make_dt_interval(secs=(F.col("gap_") * F.col("k") / 1_000_000).cast("decimal(18,6)")))
    ahead = ahead.withColumn("period", period).withColumn("month", F.month("period")).join(season, ["segment", "month"], "left")
    floor = F.when(F.col("least") >= 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))
    value = F.greatest(F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("k")) + F.coalesce("season", F.lit(0.0)), floor)
    return ahead.withColumn("value", value).select("segment", "period", "value", F.greatest(F.col("value") - F.col("band"), floor).alias("lower"), (F.col("value") + F.col("band")).alias("upper"))
