"""The models as Spark jobs: one group a chain, an edge or a forecast draw; draws come back as rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.scalars import dot, lag_input, season
from roadloom.operators.evaluate import kept
from roadloom.operators.kernels import cluster_chain, edge_chain
from roadloom.operators.quantiles import quantiles


def seed_of(*parts: int) -> int:
    """A seed by logical group, never by partition, so retries and repartitioning change nothing."""
    return int(np.random.SeedSequence([abs(int(p)) for p in parts]).generate_state(1)[0])


def cluster_draws(counts: DataFrame, design: DataFrame, k: int, chains: int = 1, iters: int = 600, burn: int = 300, seed: int = 0, truth: DataFrame | None = None, labels: bool = True, **options) -> DataFrame:
    """Long draws of independent chains: chain, iter, quantity, k, t, edge, value.

    counts is (edge, t, y), design (t, f array). A chain needs all counts at once: the matrix goes to its task, one
    group a chain, and sweeps stay in NumPy. quantities: pi, size, mean_lambda (k), z (edge), ari and acc. Without
    `labels`, z is left out: a row an edge and iteration.
    """
    spark = counts.sparkSession
    rows = counts.groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda s: s["y"]).alias("ys"))
    if truth is not None:
        rows = rows.join(truth.select("edge", F.col("z").alias("true_z")), "edge")
    f = np.array([list(r.f) for r in design.orderBy("t").select("f").collect()], float)
    shared = spark.sparkContext.broadcast(f)
    rows = rows.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(chains))))
    known = truth is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("edge")
        chain, edges, out = int(pdf["chain"].iloc[0]), pdf["edge"].to_numpy(), []
        true = pdf["true_z"].to_numpy().astype(int) - 1 if known else None
        for d in cluster_chain(np.stack(pdf["ys"].map(np.asarray)), shared.value, k, iters, burn, truth=true, seed=seed_of(seed, chain), **options):
            at = (chain, d["iter"])
            out += [(*at, "pi", c + 1, None, None, float(v)) for c, v in enumerate(d["pi"])]
            out += [(*at, "size", c + 1, None, None, float(v)) for c, v in enumerate(d["size"])]
            out += [(*at, "mean_lambda", c + 1, None, None, float(v)) for c, v in enumerate(np.exp(d["eta"]).mean(1))]
            if known:
                out += [(*at, q, None, None, None, float(d[q])) for q in ("ari", "acc")]
            if labels and d["iter"] > burn:
                out += [(*at, "z", None, None, int(e), float(c + 1)) for e, c in zip(edges, d["z"], strict=True)]
        return pd.DataFrame(out, columns=["chain", "iter", "quantity", "k", "t", "edge", "value"]).astype({"k": "Int32", "t": "Int32", "edge": "Int64"})

    return rows.groupBy("chain").applyInPandas(run, "chain int, iter int, quantity string, k int, t int, edge long, value double")


def chain_summary(draws: DataFrame, burn: int) -> DataFrame:
    """quantity, k, mean after burn-in; ari and acc, which only chains with a truth have, are listed where any ari is positive."""
    rows = kept(draws.where(F.col("quantity") != "z"), burn).groupBy("quantity", "k").agg(F.avg("value").alias("mean"), F.max("value").alias("_top"))
    known = rows.where("quantity = 'ari' and _top > 0").select(F.lit(True).alias("_known")).limit(1)
    out = rows.join(known, F.lit(True), "left")  # one row at most
    return out.where(~F.col("quantity").isin("ari", "acc") | F.col("_known")).drop("_top", "_known")


def trace(draws: DataFrame, kind: str = "trace") -> DataFrame:
    """The rows behind a plot: trace (pi), intensity (mean_lambda), size, ari, or all."""
    wanted = {"trace": ["pi"], "intensity": ["mean_lambda"], "size": ["size"], "ari": ["ari", "acc"], "all": ["pi", "mean_lambda", "size", "ari", "acc"]}[kind]
    return draws.where(F.col("quantity").isin(wanted)).select("chain", "iter", "quantity", "k", "value")


def design_blocks(counts: DataFrame, pairs: DataFrame, t_start: int = 1, steps_day: int = 48, harmonics: int = 2, center: float = math.log(8), scale: float = 2.0, y0: float = 0.0) -> DataFrame:
    """target, t, y, x: the design row of each target, 1, the season, and lagged inputs of its sources in order."""
    past = counts.select(F.col("edge").alias("source"), (F.col("t") + 1).alias("t"), lag_input("y", center, scale).alias("v"))
    first = counts.select(F.col("edge").alias("source")).distinct().select("source", F.lit(1).cast("int").alias("t"), lag_input(F.lit(y0), center, scale).alias("v"))
    inputs = pairs.select("target", "source").join(past.unionByName(first), "source")
    lagged = inputs.groupBy("target", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "v"))), lambda s: s["v"]).alias("lags"))
    rows = counts.select(F.col("edge").alias("target"), "t", "y").join(lagged, ["target", "t"])
    return rows.select("target", "t", "y", F.concat(F.array(F.lit(1.0)), season(F.col("t") + (t_start - 1), steps_day, harmonics), "lags").alias("x"))


def fit_edges(blocks: DataFrame, pairs: DataFrame, harmonics: int = 2, iters: int = 500, burn: int = 250, thin: int = 2, shrink: bool = False, sigma: float = 0.8, phi: float = 0.55, seed: int = 0, **options) -> DataFrame:
    """Draws of every edge's model: target, draw, state array, lambda array, log_lik, accepted; edges are independent groups."""
    base = 1 + 2 * harmonics
    far = pairs.select("target", "source", F.when(F.col("target") == F.col("source"), F.lit(sigma)).otherwise(sigma * F.exp(-phi * F.col("distance"))).alias("s"))
    scales = far.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "s"))), lambda s: s["s"]).alias("scales"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        target = int(pdf["target"].iloc[0])
        fit = edge_chain(pdf["y"].to_numpy(), np.stack(pdf["x"].map(np.asarray)), base, iters, burn, thin, shrink=np.asarray(pdf["scales"].iloc[0]) if shrink else None, seed=seed_of(seed, target), **options)
        n = len(fit["states"])
        return pd.DataFrame({"target": target, "draw": np.arange(1, n + 1, dtype="int32"), "state": list(fit["states"]), "lambda": list(fit["lambdas"]), "log_lik": fit["log_lik"][thin - 1 :: thin][:n], "accepted": fit["accepted"]})

    return blocks.join(scales, "target").groupBy("target").applyInPandas(run, "target long, draw int, state array<double>, lambda array<double>, log_lik double, accepted double")


def pair_draws(fits: DataFrame, pairs: DataFrame, harmonics: int = 2) -> DataFrame:
    """target, source, draw, lambda, theta of every pair."""
    base = 1 + 2 * harmonics
    order = pairs.groupBy("target").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    each = fits.join(order, "target").select("target", "draw", F.posexplode("sources").alias("j", "source"), "state", "lambda")
    lam = F.get("lambda", F.col("j"))
    return each.select("target", "source", "draw", lam.alias("lambda"), (lam * F.get("state", F.col("j") + base)).alias("theta"))


def scaled_eta(x, beta, lam, base: int) -> Column:
    """The predictor of a design row: its base entries by beta, the others by beta and lambda."""
    x, beta, lam = (F.col(c) if isinstance(c, str) else c for c in (x, beta, lam))
    scale = F.concat(F.array_repeat(F.lit(1.0), base), lam)
    return dot(F.zip_with(x, beta, lambda a, b: a * b), scale)


def picked_draws(saved: int, most: int = 80) -> list[int]:
    """Evenly spaced draws, halves rounded to even, each once."""
    n = min(most, saved)
    return list(dict.fromkeys(round(1 + i * (saved - 1) / max(1, n - 1)) for i in range(n)))


def forecast(fits: DataFrame, pairs: DataFrame, last: DataFrame, horizon: int, t_next: int, steps_day: int = 48, harmonics: int = 2, center: float = math.log(8), scale: float = 2.0, most: int = 80, saved: int | None = None, sd: Sequence[float] = (0.0020, 0.0008, 0.0015), clip: float = 8.0, counts: bool = True, seed: int = 0) -> DataFrame:
    """draw, h, edge, rate, y: each draw is a group in which all edges step together, as they feed each other.

    last is (edge, y), the counts before the first forecast step t_next.
    """
    saved = saved or fits.agg(F.max("draw")).first()[0]
    picked = fits.where(F.col("draw").isin(picked_draws(saved, most)))
    order = pairs.groupBy("target").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    rows = picked.join(order, "target").join(last.select(F.col("edge").alias("target"), F.col("y").alias("y_last")), "target")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("target").reset_index(drop=True)
        draw, edges = int(pdf["draw"].iloc[0]), pdf["target"].to_numpy()
        rng, place = np.random.default_rng(seed_of(seed, draw)), {int(e): i for i, e in enumerate(edges)}
        states, lams = [np.array(s) for s in pdf["state"]], [np.array(v) for v in pdf["lambda"]]
        sources = [[place[int(s)] for s in v] for v in pdf["sources"]]
        y, out, base = pdf["y_last"].to_numpy(float), [], 1 + 2 * harmonics
        noise = np.r_[sd[0], np.full(base - 1, sd[1])]
        for h in range(1, horizon + 1):
            phase = 2 * math.pi * ((t_next + h - 2) % steps_day) / steps_day
            front = np.r_[1.0, [g(phase * j) for j in range(1, harmonics + 1) for g in (math.sin, math.cos)]]
            lag = (np.log1p(y) - center) / scale
            rate = np.empty(len(edges))
            for e in range(len(edges)):
                states[e] = states[e] + rng.standard_normal(len(states[e])) * np.r_[noise, np.full(len(states[e]) - base, sd[2])]
                eta = front @ states[e][:base] + (lag[sources[e]] * states[e][base:] * lams[e]).sum()
                rate[e] = math.exp(min(clip, max(-clip, eta)))
            y = rng.poisson(rate).astype(float) if counts else rate
            out += [(draw, h, int(e), float(a), float(b)) for e, a, b in zip(edges, rate, y, strict=True)]
        return pd.DataFrame(out, columns=["draw", "h", "edge", "rate", "y"])

    return rows.groupBy("draw").applyInPandas(run, "draw int, h int, edge long, rate double, y double")


def forecast_bands(draws: DataFrame) -> DataFrame:
    means = draws.groupBy("h", "edge").agg(F.avg("rate").alias("mean"))
    return means.join(quantiles(draws, ["h", "edge"], "rate", (0.025, 0.975)), ["h", "edge"]).select("h", "edge", "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def forecast_total(draws: DataFrame) -> DataFrame:
    """h, mean, sums of the edges' bounds, and the joint interval from each draw's own total."""
    sums = forecast_bands(draws).groupBy("h").agg(F.sum("mean").alias("mean"), F.sum("lower").alias("sum_lower"), F.sum("upper").alias("sum_upper"))
    joint = quantiles(draws.groupBy("draw", "h").agg(F.sum("rate").alias("r")), ["h"], "r", (0.025, 0.975))
    return sums.join(joint, "h").select("h", "mean", "sum_lower", "sum_upper", F.col("q")[0].alias("joint_lower"), F.col("q")[1].alias("joint_upper"))
