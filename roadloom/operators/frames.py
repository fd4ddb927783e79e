"""Frames over time: resampling, interpolation, statistics, streaks, deltas, hot spots, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import congestion
from roadloom.operators.quantiles import quantiles
from roadloom.operators.scans import ONE_TASK_ROWS, Scan


def resample(rows: DataFrame, key: str, ts: str, value: str, minutes: int = 15) -> DataFrame:
    """key, slot, value: the mean of each slot from a key's first to its last, null in slots without rows."""
    slot = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / (60 * minutes)).cast("bigint")
    means = rows.select(key, slot.alias("slot"), value).groupBy(key, "slot").agg(F.avg(value).alias("value"))
    span = means.groupBy(key).agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b")).alias("slot")).join(means, [key, "slot"], "left")


def interpolate(frames: DataFrame, key: str, slot: str = "slot", value: str = "value", one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """Linear over gaps; before the first value it, after the last value that; 0 where a key has none."""
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(slot).alias("s"), F.col(value).alias("v")))
    out = Scan(frames, [key], [slot], one_task).last("_p", at).first("_n", at).done()
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.try_divide(F.col(slot) - F.col("_p.s"), F.col("_n.s") - F.col("_p.s"))
    return out.withColumn(value, F.coalesce(F.col(value), line, F.col("_p.v"), F.col("_n.v"), F.lit(0.0))).drop("_p", "_n")


def busiest_day(rows: DataFrame, ts: str, value: str, complete: int) -> DataFrame:
    """day, total: of the days with at least `complete` rows the one with the largest total, the first of equals."""
    days = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).where(F.col("n") >= complete)
    return days.orderBy(F.desc_nulls_last("total"), "day").limit(1).select("day", "total")


def frame_stats(rows: DataFrame, frame: str, value: str) -> DataFrame:
    active = F.when(F.col(value) > 0, F.col(value))
    out = rows.groupBy(frame).agg(F.avg(value).alias("mean"), F.count(active).alias("active"), F.avg(active).alias("active_mean"), F.max(value).alias("max"))
    return out.join(quantiles(rows, [frame], value, (0.95,)).select(frame, F.col("q")[0].alias("p95")), frame, "left")


def congestion_frames(rows: DataFrame, key: str, frame: str, speed: str, volume: str) -> DataFrame:
    """key, frame, congestion: the slowdown against a key's free-flow speed (0.9 of its speeds but 0), weighted by volume
    against 0.95 of all volumes."""
    n = rows.count()
    most = n if n <= ONE_TASK_ROWS else None
    free = quantiles(rows.where(F.col(speed) != 0), [key], speed, (0.9,), most=most).select(F.col(key).alias("_k"), F.col("q")[0].alias("_free"))
    top = quantiles(rows, [], volume, (0.95,), most=most).select(F.col("q")[0].alias("_top"))  # one row
    out = rows.join(free, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("_free", F.coalesce("_free", F.lit(0.0))).crossJoin(F.broadcast(top))
    return out.select(key, frame, congestion(speed, "_free", volume, "_top").alias("congestion"))


def congestion_runs(rows: DataFrame, key: str, time: str, value: str, threshold: float, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """key, time, streak of congested rows: how many bins in a row, counting only bins that any row has.

    Bins are ranked on their distinct values, which is one row a bin; a run starts where the bin before is missing, and a
    streak is a bin's distance from its run's start.
    """
    n = rows.count()
    most = n if n <= one_task else None  # of few rows no key or bin has many
    ranked = Scan(rows.select(time).distinct(), [], [time], one_task, most).number("_rank").done()
    hot = rows.where(F.col(value) >= threshold).join(ranked, time).select(key, time, "_rank")
    scan = Scan(hot, [key], ["_rank"], one_task, most).lag("_before", F.col("_rank"))
    start = F.when(F.col("_before").isNull() | (F.col("_before") < F.col("_rank") - 1), F.col("_rank"))
    return scan.last("_start", start).done().select(key, time, (F.col("_rank") - F.col("_start") + 1).alias("streak"))


def deltas(rows: DataFrame, key: str, time: str, value: str, least: float = 1e-4, digits: int = 4) -> DataFrame:
    """time, key, delta against the bin present before; a key missing on one side counts as 0 there.

    A full outer join on (rank, key) and (rank + 1, key); `lag` would miss keys that vanish.
    """
    bins = rows.select(time).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(time)))
    now = rows.join(bins, time).select("_rank", key, F.col(value).alias("_now"))
    before = now.select((F.col("_rank") + 1).alias("_rank"), key, F.col("_now").alias("_before"))
    both = now.join(before, ["_rank", key], "full").join(bins, "_rank")
    both = both.where(F.col("_rank") > 1).withColumn("delta", F.coalesce("_now", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)))
    return both.where(F.abs("delta") >= least).select(time, key, F.bround("delta", digits).alias("delta"))


def delta_summary(d: DataFrame, time: str, worse: float = 0.05) -> DataFrame:
    return d.groupBy(time).agg(F.count_if(F.col("delta") >= worse).alias("worsened"), F.count_if(F.col("delta") <= -worse).alias("improved"), F.max("delta").alias("max_rise"), F.min("delta").alias("max_drop"))


def hot_spots(rows: DataFrame, frame: str, key: str, value: str, k: int = 10, positive: bool = True) -> DataFrame:
    """The k largest of each frame, ties to the least key; row_number below a bound prunes before the shuffle."""
    rows = rows.where(F.col(value) > 0) if positive else rows.where(F.col(value) != 0)
    w = Window.partitionBy(frame).orderBy(F.desc(value), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(frame, key, value, "rank")


def thin(rows: DataFrame, x: str, y: str, value: str, key: str, nx: int = 34, ny: int = 22, total: int = 720) -> DataFrame:
    """key, cx, cy, value, first: the best row of each grid cell, then the next best ones, `total` in all."""
    bound = rows.agg(*(f(c).alias(f"{n}{c}") for c in (x, y) for n, f in (("lo_", F.min), ("hi_", F.max))))
    place = lambda c, n: F.least(F.greatest(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) * n), F.lit(0)), F.lit(n - 1)).cast("int")
    cells = rows.crossJoin(F.broadcast(bound)).select(key, value, place(x, nx).alias("cx"), place(y, ny).alias("cy"))  # one row is broadcast
    best = cells.groupBy("cx", "cy").agg(F.min(F.struct((-F.col(value)).alias("_v"), F.col(key).alias("k"))).alias("m")).select("cx", "cy", F.col("m.k").alias("best"))
    out = cells.join(best, ["cx", "cy"]).withColumn("first", F.col(key) == F.col("best"))
    return out.orderBy(F.desc("first"), F.desc(value), key).limit(total).select(key, "cx", "cy", value, "first")


def every_nth(rows: DataFrame, time: str, step: int, most: int) -> DataFrame:
    """Rows of every step-th distinct time, the first `most` of them."""
    picked = rows.select(time).distinct().withColumn("_n", F.row_number().over(Window.orderBy(time)) - 1).where(F.col("_n") % step == 0).orderBy("_n").limit(most)
    return rows.join(picked, time, "left_semi")


def nearest_rank(rows: DataFrame, key: str, value: str, quantiles) -> DataFrame:
    """key, breaks: sorted[floor(q n)], capped at the last value, from per-value counts rather than collected rows."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(value)
    counts = counts.withColumn("hi", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    at = lambda q: F.least(F.floor(F.col("total") * q), F.col("total") - 1)
    return counts.groupBy(key).agg(F.array(*(F.min(F.when(F.col("hi") > at(q), F.col(value))) for q in quantiles)).alias("breaks"))


def sensor_links(sensors: DataFrame, key: str, group: list[str], order: str, distance, limit: float, value: str | None = None, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """key, next_key, dist of consecutive sensors of a group no farther apart than `limit`; `distance` takes (row, next).

    With `value`, also link_value: the mean of both sensors' values, or the one that is there.
    """
    out = Scan(sensors, group, [order, key], one_task).lead("_next", F.struct(*sensors.columns)).done().where(F.col("_next").isNotNull())
    out = out.withColumn("dist", distance(lambda c: F.col(c), lambda c: F.col(f"_next.{c}")))
    mean = []
    if value:
        a, b = F.col(value), F.col(f"_next.{value}")
        mean = [F.coalesce((a + b) / 2, a, b).alias("link_value")]
    return out.where(F.col("dist") <= limit).select(*group, key, F.col(f"_next.{key}").alias("next_key"), "dist", *mean)


def peaks(rows: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    """First frame with each key's largest value."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(frame).alias("f")))
    return rows.groupBy(key).agg(best.alias("m")).select(key, F.col("m.f").alias("peak_frame"), (-F.col("m.v")).alias("peak"))


def color_breaks(rows: DataFrame, value: str, at=(0.15, 0.30, 0.45, 0.60, 0.75, 0.90), digits: int = 1) -> DataFrame:
    """breaks: quantiles of all finite cells, rounded half to even."""
    return quantiles(rows, [], value, at).select(F.transform("q", lambda x: F.bround(x, digits)).alias("breaks"))


def in_view(rows: DataFrame, kinds=None, group: tuple[str, object] | None = None, contains: tuple[str, str] | None = None, kind: str = "kind") -> DataFrame:
    """Rows of the chosen kinds, of one group, and whose id contains a text (case matters)."""
    out = rows.where(F.col(kind).isin(*kinds)) if kinds is not None else rows
    out = out.where(F.col(group[0]) == group[1]) if group else out
    return out.where(F.col(contains[0]).contains(contains[1])) if contains else out


def view_mean(rows: DataFrame, value: str) -> DataFrame:
    ok = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    return rows.agg(F.count("*").alias("shown"), F.count(ok).alias("with_value"), F.avg(ok).alias("mean"))


def congestion_payload(rows: DataFrame, frame: str, key: str, value: str, threshold: float, digits: int = 4) -> DataFrame:
    """frame, payload: each frame's statistics, its hottest segment (the least key of equals), and how long segments have
    been at or above the threshold, as JSON."""
    runs = congestion_runs(rows, key, frame, value, threshold)
    lasting = runs.groupBy(frame).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.col("streak").alias("frames")))), lambda s: F.array(s["id"].cast("long"), s["frames"].cast("long"))).alias("duration"))
    hot = rows.groupBy(frame).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("_m"), F.bround(F.avg(value), digits).alias("mean"), F.bround(F.max(value), digits).alias("max"), F.count_if(F.col(value) >= threshold).alias("congested"))
    out = hot.join(lasting, frame, "left").withColumn("hottest", F.col("_m.k"))
    return out.select(frame, F.to_json(F.struct("mean", "max", "congested", "hottest", F.coalesce("duration", F.array().cast("array<array<bigint>>")).alias("duration"))).alias("payload"))


def frames_payload(segments: DataFrame, frames: DataFrame, key: str, frame: str, value: str, digits: int = 3) -> DataFrame:
    """key, payload: a segment's record with its values by frame as JSON, for maps; absent frames are null."""
    span = frames.agg(F.min(frame).alias("a"), F.max(frame).alias("b"))  # one row
    of = frames.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(frame), F.bround(value, digits)))).alias("_m"))
    out = segments.join(of, key, "left").crossJoin(F.broadcast(span))
    values = F.transform(F.sequence("a", "b"), lambda f: F.try_element_at("_m", f))
    return out.select(key, F.to_json(F.struct(*segments.columns, values.alias("values")), {"ignoreNullFields": "false"}).alias("payload"))
