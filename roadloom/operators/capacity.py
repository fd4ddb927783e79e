"""Edge capacity: quantile boosting of observed maxima, floored by what was observed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators.kernels import QuantileBooster
from roadloom.operators.quantiles import quantiles
from roadloom.sources.lineage import cut


def features(links: DataFrame, stats: DataFrame) -> DataFrame:
    """links (edge, length, lanes, speed, lane_capacity, jam, kind) and stats (edge, max, active) as model inputs.

    Lengths are clipped to [0.005, their 99.5 % quantile]; the quantile is one row, so the join copies one row.
    """
    top = quantiles(links, [], "length", (0.995,)).select(F.col("q")[0].alias("_top"))
    out = links.join(stats, "edge", "left").crossJoin(F.broadcast(top))
    out = out.withColumn("length", F.least(F.greatest("length", F.lit(0.005)), "_top")).withColumn("storage", F.col("length") * F.col("lanes") * F.col("jam"))
    return out.select(
        "edge", "kind", "lanes", "speed", "jam", F.log1p("length").alias("log_length"), F.log1p(F.greatest("lane_capacity", F.lit(1.0))).alias("log_lane_capacity"),
        F.log1p(F.greatest("storage", F.lit(1e-6))).alias("log_storage"), F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("max", F.lit(0.0)).alias("observed_max"),
    )


NUMERIC = ("lanes", "speed", "jam", "log_length", "log_lane_capacity", "log_storage")


#: Most rows that the model is fitted on.
TRAINING_ROWS = 200_000


def fit_capacity(rows: DataFrame, least_active: int = 12, least_rows: int = 100, alpha: float = 0.9, most_rows: int = TRAINING_ROWS, **options) -> DataFrame:
    """rows with model_capacity, capacity and basis: trained on active edges outside the fold of a hash.

    The model is fitted on the driver, on at most `most_rows` training rows (all of them in most networks, else about that
    many by a hash threshold and the first of those), and applied to all rows in parallel.
    """
    rows = cut(rows)  # counted, sampled and predicted from
    usable = rows.where((F.col("active") >= least_active) & (F.pmod(F.xxhash64("edge"), F.lit(5)) != 0))
    n = usable.count()
    if n > most_rows:
        spread = (F.xxhash64("edge", F.lit(1)).cast("double") + 2.0**63) / 2.0**64
        usable = usable.where(spread <= min(1.0, 1.2 * most_rows / n)).orderBy(spread, "edge").limit(most_rows)
    train = usable.toPandas()
    if len(train) < least_rows:
        raise ValueError(f"{len(train)} active edges; at least {least_rows} are needed")
    kinds = sorted(train["kind"].dropna().unique())
    matrix = lambda p: np.c_[p[list(NUMERIC)].fillna(0).to_numpy(float), np.stack([(p["kind"] == k).to_numpy(float) for k in kinds], 1)]
    model = QuantileBooster(alpha, **options).fit(matrix(train.sort_values("edge")), np.log1p(train.sort_values("edge")["observed_max"].to_numpy(float)))
    shared = rows.sparkSession.sparkContext.broadcast((model, kinds))

    def run(batches):
        booster, names = shared.value
        for p in batches:
            x = np.c_[p[list(NUMERIC)].fillna(0).to_numpy(float), np.stack([(p["kind"] == k).to_numpy(float) for k in names], 1)]
            raw = np.expm1(booster.predict(x))
            cap = np.maximum(np.maximum(raw, p["observed_max"]), 1.0)
            yield pd.DataFrame({"edge": p["edge"], "observed_max": p["observed_max"], "model_capacity": raw, "capacity": cap, "basis": np.where(p["observed_max"] >= raw, "observed_max_floor", "model")})

    return rows.mapInPandas(run, "edge long, observed_max double, model_capacity double, capacity double, basis string")
