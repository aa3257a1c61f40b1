"""Trends over streams: an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeline.functions.columns import col, number


def windowed_trend(stream: DataFrame, date: str, measure: str | None, *, width: str = "1 day", lateness: str = "1 day", dimension: str | None = None) -> DataFrame:
    """(period[, segment], value, rows) in tumbling windows; rows later than the
    watermark are dropped, and windows behind it are final."""
    at = col(date).cast("timestamp").alias("at")
    rows = stream.select(at, *([number(measure).alias("m")] if measure else []), *([col(dimension).alias("segment")] if dimension else [])).withWatermark("at", lateness)
    value = F.coalesce(F.sum("m"), F.lit(0.0)) if measure else F.count(F.lit(1)).cast("double")
    keys = [F.window("at", width), *(["segment"] if dimension else [])]
    out = rows.groupBy(*keys).agg(value.alias("value"), F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("period"), *(["segment"] if dimension else []), "value", "rows")


def run_to_end(trend: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; append writes final windows as parquet."""
    query = trend.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
