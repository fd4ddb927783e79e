"""Synthetic counts from known parameters, for recovery tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.operators.topology import grid, lag_sources, pair_table, with_truth

#: Log profile of each cluster, base, morning, evening, weekend.
PROFILES = ((2.0, 1.5, 1.3, 0.7), (5.0, 2.5, 2.0, 0.6), (10.0, 3.5, 3.0, 0.5))


def time_index(spark: SparkSession, days: int = 28, steps_day: int = 48) -> DataFrame:
    """The flags of all steps of so many days."""
    return flagged(spark.range(days * steps_day), steps_day)


def flagged(steps: DataFrame, steps_day: int = 48) -> DataFrame:
    """t from 1, day, hour, dow from 1, morning, evening, weekend of steps (id, from 0)."""
    k = F.col("id")
    hour = F.floor((k % steps_day) * 24 / steps_day).cast("int")
    dow = (F.floor(k / steps_day) % 7 + 1).cast("int")
    out = steps.select((k + 1).cast("int").alias("t"), (F.floor(k / steps_day) + 1).cast("int").alias("day"), hour.alias("hour"), dow.alias("dow"))
    return out.withColumns({"morning": F.col("hour").isin(7, 8, 9), "evening": F.col("hour").isin(17, 18, 19), "weekend": F.col("dow").isin(6, 7)})


def design(index: DataFrame) -> DataFrame:
    """t, f: intercept and flags as numbers."""
    return index.select("t", F.array(F.lit(1.0), *(F.col(c).cast("double") for c in ("morning", "evening", "weekend"))).alias("f"))


def cluster_counts(index: DataFrame, edges: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """counts (edge, t, y) and truth (edge, z): Poisson counts of equal clusters around the fixed profiles."""
    spark, rows = index.sparkSession, index.orderBy("t").collect()  # the index alone, one row a step
    t = np.array([r.t for r in rows])
    drift = 0.1 * np.sin(2 * math.pi * t / len(t))
    flags = np.array([[r.morning, r.evening, r.weekend] for r in rows], float)
    rate = np.stack([np.exp(math.log(b) + drift + flags @ np.log([m, e, w])) for b, m, e, w in PROFILES])
    # Clusters of equal size, dealt by the order of a hash; an edge's draws come from a generator of its own.
    place = F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    truth = spark.range(1, edges + 1).select(F.col("id").alias("edge"), (place % len(PROFILES) + 1).cast("int").alias("z"))

    def draw(batches):
        for p in batches:
            for e, z in zip(p["edge"], p["z"], strict=True):
                yield pd.DataFrame({"edge": e, "t": t.astype("int32"), "y": np.random.default_rng([seed, int(e)]).poisson(rate[z - 1]).astype(float)})

    return truth.mapInPandas(draw, "edge long, t int, y double"), truth


def neighbourhood_counts(spark: SparkSession, nx: int = 4, ny: int = 4, steps_day: int = 48, days: int = 14, train_days: int = 10, seed: int = 1) -> dict[str, DataFrame]:
    """nodes, edges, the pair tables of both rules (origin, pairs: the broad one) and the broad one with truth (marked), the
    active pairs (truth), train and test counts of the adaptive neighbourhood process.

    Every step feeds the next of all edges, so one process makes them; its size is that of the parameters, not of data.
    """
    nodes, edges = grid(spark, ny, nx)
    broad = pair_table(edges, nodes, "two_endpoint", "broad")
    true = {(r.target, r.source) for r in lag_sources(edges, "origin").collect()}
    distance = {(r.target, r.source): r.distance for r in broad.collect()}
    n, steps, rng = edges.count(), days * steps_day, np.random.default_rng(seed)
    c = np.zeros((n, n))
    for t, s in true:
        c[t - 1, s - 1] = rng.normal(0.48, 0.05) if t == s else rng.normal(0.20, 0.04) * math.exp(-0.15 * max(0.0, distance[t, s] - 1))
        c[t - 1, s - 1] *= 1 if t == s else 0.5
    base = math.log(6.5) + 0.05 * rng.standard_normal(n)
    wave = np.array([-0.26, -0.30, -0.18, -0.28])
    y, out = rng.poisson(np.exp(base)).astype(float), []
    for t in range(1, steps + 1):
        phase = 2 * math.pi * ((t - 1) % steps_day) / steps_day
        season = np.array([math.sin(phase), math.cos(phase), math.sin(2 * phase), math.cos(2 * phase)]) @ wave
        base += 0.0015 * rng.standard_normal(n)
        eta = np.clip(base + season + c @ ((np.log1p(y) - math.log(8)) / 1.5), -8, 8)
        y = rng.poisson(np.exp(eta)).astype(float)
        out += [(e + 1, t, float(v), float(r)) for e, (v, r) in enumerate(zip(y, np.exp(eta), strict=True))]
    counts = spark.createDataFrame(out, "edge long, t int, y double, rate double")
    truth = spark.createDataFrame([(t, s, True) for t, s in sorted(true)], "target long, source long, true_active boolean")
    split = train_days * steps_day
    return {"nodes": nodes, "edges": edges, "pairs": broad, "origin": pair_table(edges, nodes, "origin", "origin"), "marked": with_truth(broad, truth), "truth": truth, "train": counts.where(F.col("t") <= split), "test": counts.where(F.col("t") > split)}
