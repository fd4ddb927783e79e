"""Structured Streaming forms of the edge flow and the resampled frame, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_flow_stream(events: DataFrame, ts: str, origin: str, target: str, width: str = "30 minutes", late: str = "2 hours", weight: str | None = None) -> DataFrame:
    """start, from, to, x of each window; a window closes when the watermark passes it."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width), F.col(origin).alias("from"), F.col(target).alias("to")).agg(F.sum(w).alias("x"))
    return out.select(F.col("window.start").alias("start"), "from", "to", "x")


def frame_stream(events: DataFrame, ts: str, key: str, value: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """start, key, value: means of each window; empty windows are filled when the result is read as a batch."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width), key).agg(F.avg(value).alias("value")).select(F.col("window.start").alias("start"), key, "value")
