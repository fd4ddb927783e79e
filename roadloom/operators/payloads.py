"""Map payloads in pieces: frames of entries cut at a budget of bytes, with what each piece holds, and the facts of each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators.frames import congestion_runs
from roadloom.operators.quantiles import quantiles
from roadloom.operators.scans import ONE_TASK_ROWS, Scan

#: Bytes after which a piece is closed.
BUDGET = 1 << 20


def pieces(entries: DataFrame, frame: str, key: str, text: Column, budget: int = BUDGET, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """frame, piece, first, last, entries, bytes, body: each frame's entries as JSON lists by key, cut by size.

    An entry belongs to the piece in which its first byte stands, so a piece is shorter than the budget and one entry.
    Sizes are summed by a segmented scan, so a frame may hold any share of the rows, and no task or row holds a whole frame.
    """
    rows = entries.select(frame, key, text.alias("_text")).withColumn("_size", F.octet_length("_text") + 1)
    rows = Scan(rows, [frame], [key], one_task).sum("_end", F.col("_size").cast("bigint")).done()
    rows = rows.withColumn("piece", F.floor((F.col("_end") - F.col("_size")) / budget))
    out = rows.groupBy(frame, "piece").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("entries"), F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_text").alias("t")))).alias("_all"))
    body = F.concat(F.lit("["), F.array_join(F.transform("_all", lambda e: e["t"]), ","), F.lit("]"))
    return out.withColumn("body", body).select(frame, "piece", "first", "last", "entries", F.octet_length("body").alias("bytes"), "body")


def index(cut: DataFrame, frame: str) -> DataFrame:
    """frame, index: a frame's pieces as JSON, so that a page asks only for those whose keys it shows."""
    one = F.struct("piece", "first", "last", "entries", "bytes")
    return cut.groupBy(frame).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("index"))


def pair(key: str, value: Column) -> Column:
    return F.concat(F.lit("["), F.col(key).cast("string"), F.lit(","), value, F.lit("]"))


def durations(flow: DataFrame, frame: str, key: str, value: str, threshold: float, budget: int = BUDGET, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """Pieces of [key, frames] pairs: for how many frames in a row a key has been at or above the threshold."""
    runs = congestion_runs(flow, key, frame, value, threshold, one_task)
    return pieces(runs, frame, key, pair(key, F.col("streak").cast("string")), budget, one_task)


def frame_facts(flow: DataFrame, frame: str, value: str, volume: str, minutes: int, shown: int, threshold: float = 1.0, digits: int = 3) -> DataFrame:
    """frame, start_min, end_min, active, active_share, congested, congested_share, total, mean, p95, max of each frame.

    Shares are of the `shown` segments of the map, 0 where it has none; numbers are rounded half to even.
    """
    share = lambda c: F.bround(F.coalesce(F.try_divide(F.col(c).cast("double"), F.lit(float(shown))), F.lit(0.0)), 4)
    out = flow.groupBy(frame).agg(F.count("*").alias("active"), F.count_if(F.col(value) >= threshold).alias("congested"), F.sum(volume).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    p95 = quantiles(flow, [frame], value, (0.95,)).select(F.col(frame).alias("_f"), F.col("q")[0].alias("p95"))
    out = out.join(p95, F.col(frame).eqNullSafe(F.col("_f")), "left")
    start = (F.col(frame) * minutes).cast("int")
    return out.select(frame, start.alias("start_min"), (start + minutes).alias("end_min"), "active", share("active").alias("active_share"), "congested", share("congested").alias("congested_share"), *(F.bround(c, digits).alias(c) for c in ("total", "mean", "p95", "max")))
