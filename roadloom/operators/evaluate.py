"""Clustering agreement, posterior summaries, scores and chain diagnostics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import poisson_logpmf
from roadloom.operators.quantiles import quantiles
from roadloom.operators.scans import BLOCK_ROWS, ONE_TASK_ROWS, Scan, leads


def confusion(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))


def adjusted_rand(rows: DataFrame, x: str, y: str) -> DataFrame:
    """ari: 0 where the largest and the expected index agree, null for fewer than two rows."""
    table = confusion(rows, x, y)
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = table.agg(two("n").alias("ij"), F.sum("n").alias("total"))
    a = table.groupBy(x).agg(F.sum("n").alias("n")).agg(two("n").alias("a"))
    b = table.groupBy(y).agg(F.sum("n").alias("n")).agg(two("n").alias("b"))
    one = both.crossJoin(a).crossJoin(b)  # one row each
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col("a") + F.col("b")) / 2
    return one.select(F.when(F.col("total") < 2, None).when(most == expected, 0.0).otherwise(F.try_divide(F.col("ij") - expected, most - expected)).alias("ari"))


def best_label_accuracy(rows: DataFrame, true: str, found: str, k: int) -> DataFrame:
    """accuracy under the best map of labels 1..k; the k x k table is assigned on the driver by a bitmask recurrence."""
    spark, cells, total = rows.sparkSession, {}, 0
    for r in confusion(rows, true, found).collect():
        cells[int(r[0]), int(r[1])] = r.n
        total += r.n
    best = {0: 0}
    for f in range(1, k + 1):
        new: dict[int, int] = {}
        for used, s in best.items():
            for t in range(k):
                if not used >> t & 1:
                    new[used | 1 << t] = max(new.get(used | 1 << t, 0), s + cells.get((t + 1, f), 0))
        best = new
    return spark.createDataFrame([(max(best.values()) / total if total else None,)], "accuracy double")


def cluster_stats(counts: DataFrame, assigned: DataFrame, k: int, steps: int) -> DataFrame:
    """cluster, t, size, total of counts (edge, t, y) under assigned (edge, z); an empty cluster has zero rows.

    Counts are added by (z, t); the spine of k x steps is made by two generators.
    """
    sums = counts.join(assigned, "edge").groupBy(F.col("z").alias("cluster"), "t").agg(F.sum("y").alias("total"))
    sizes = assigned.groupBy(F.col("z").alias("cluster")).agg(F.count("*").alias("size"))
    spine = counts.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("cluster"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("t"))
    out = spine.join(sizes, "cluster", "left").join(sums, ["cluster", "t"], "left")
    return out.select("cluster", "t", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("total", F.lit(0.0)).alias("total"))


def allocation(counts: DataFrame, rates: DataFrame, weights: DataFrame) -> DataFrame:
    """edge, cluster, prob of counts (edge, t, y), rates (cluster, t, eta) and weights (cluster, pi).

    ln p = ln(pi + 1e-16) + sum_t (y eta - exp(eta)), normalised by its largest value.
    """
    score = counts.join(rates, "t").groupBy("edge", "cluster").agg(F.sum(F.col("y") * F.col("eta") - F.exp("eta")).alias("s"))
    score = score.join(weights, "cluster").withColumn("s", F.col("s") + F.ln(F.col("pi") + 1e-16))
    w = Window.partitionBy("edge")
    e = F.exp(F.col("s") - F.max("s").over(w))
    return score.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(w)).select("edge", "cluster", "prob")


def log_sum_exp(rows: DataFrame, keys: list[str], x: str, name: str = "lse") -> DataFrame:
    """Shifted by the largest value of each group, in two aggregates."""
    top = rows.groupBy(*keys).agg(F.max(x).alias("_top"))
    return rows.join(top, keys).groupBy(*keys, "_top").agg(F.sum(F.exp(F.col(x) - F.col("_top"))).alias("_s")).select(*keys, (F.col("_top") + F.ln("_s")).alias(name))


def log_harmonic_mean(rows: DataFrame, keys: list[str], x: str, name: str = "log_marginal") -> DataFrame:
    """Logarithm of the harmonic mean of exp(x)."""
    n = rows.groupBy(*keys).agg(F.count(x).alias("_n"))
    return log_sum_exp(rows.withColumn("_m", -F.col(x)), keys, "_m", "_l").join(n, keys).select(*keys, (F.ln(F.col("_n").cast("double")) - F.col("_l")).alias(name))


def posterior_mode(draws: DataFrame, key: str, z: str) -> DataFrame:
    """The most frequent label, the smallest of equals."""
    n = draws.groupBy(key, z).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max(F.struct("n", (-F.col(z)).alias("neg"))).alias("m")).select(key, (-F.col("m.neg")).alias("mode"), F.col("m.n").alias("votes"))


def kept(draws: DataFrame, burn: int, thin: int = 1, it: str = "iter") -> DataFrame:
    """Draws after burn-in, every thin-th."""
    if burn < 0 or thin < 1:
        raise ValueError("burn >= 0 and thin >= 1")
    return draws.where((F.col(it) > burn) & ((F.col(it) - burn) % thin == 0))


def draw_summary(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, sd, and lower, median, upper: the quantiles 0.025, 0.5 and 0.975 of each group's finite values."""
    found = quantiles(draws, keys, value, (0.025, 0.5, 0.975)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("q").alias("_q"))
    out = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out.join(found, same, "left").select(*keys, "mean", "sd", *(F.col("_q")[i].alias(n) for i, n in enumerate(("lower", "median", "upper"))))


def fit_scores(rows: DataFrame, t: str, y: str, rate: str, truth: str | None = None) -> DataFrame:
    """log_score, rmse, mae (against `truth`, or the counts), count_mae and total_mae (absolute error of sums over t)."""
    against = F.col(truth or y)
    means = (F.avg(poisson_logpmf(y, rate)).alias("log_score"), F.sqrt(F.avg(F.pow(F.col(rate) - against, 2))).alias("rmse"), F.avg(F.abs(F.col(rate) - against)).alias("mae"), F.avg(F.abs(F.col(rate) - F.col(y))).alias("count_mae"))
    totals = rows.groupBy(t).agg((F.sum(rate) - F.sum(y)).alias("d")).agg(F.avg(F.abs("d")).alias("total_mae"))
    return rows.agg(*means).crossJoin(totals)  # one row each


def coverage(rows: DataFrame, value: str, lower: str, upper: str) -> Column:
    return F.avg(F.col(value).between(F.col(lower), F.col(upper)).cast("double"))


def lag_correlation(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """target, source, n, correlation of y[t - 1, source] and y[t, target]; null for a constant side."""
    past = series.select(F.col("edge").alias("source"), (F.col("t") + 1).alias("t"), F.col("y").alias("x"))
    now = series.select(F.col("edge").alias("target"), "t", "y")
    both = pairs.select("target", "source").join(past, "source").join(now, ["target", "t"])
    s = {k: F.sum(v).alias(k) for k, v in {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}.items()}
    sums = both.groupBy("target", "source").agg(F.count("*").alias("n"), *(v.alias(f"s{k}") for k, v in s.items()))
    n = F.col("n")
    spread = lambda a: n * F.col(f"s{a}{a}") - F.col(f"s{a}") * F.col(f"s{a}")
    ok = (spread("x") > 1e-9) & (spread("y") > 1e-9)
    r = F.when(ok, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("x") * spread("y")))
    return sums.select("target", "source", "n", r.alias("correlation"))


def chain_diagnostics(draws: DataFrame, name: str, it: str, value: str, lags=(1, 10, 30), one_task: int = ONE_TASK_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """n, mean, sd, autocorrelations, ess (by initial positive pairs of the listed lags' geometric decay) and mcse.

    Chains of fewer than ten finite draws have nulls. Draws are numbered by a segmented scan and lags are read inside
    blocks of a chain, so a long chain spans many tasks; sums of lagged products are taken about the chain's mean.
    """
    rows = draws.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    rows = Scan(rows.select(name, it, value), [name], [it], one_task).number("_i").done()
    mean = rows.groupBy(name).agg(F.avg(value).alias("_m"))
    rows = rows.join(mean, name).withColumn("_d", F.col(value) - F.col("_m"))
    rows = leads(rows, [name], "_i", {f"_n{lag}": (F.col("_d"), lag) for lag in lags}, block)
    out = rows.groupBy(name).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.var_pop(value).alias("_v"), *(F.sum(F.col("_d") * F.col(f"_n{lag}")).alias(f"_c{lag}") for lag in lags))
    out = out.withColumns({f"acf_{lag}": F.try_divide(f"_c{lag}", F.col("n") * F.col("_v")) for lag in lags})
    r = F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.coalesce(f"acf_{lags[0]}", F.lit(0.0))))
    out = out.withColumn("ess", F.col("n") * (1 - r) / (1 + r)).withColumn("mcse", F.try_divide("sd", F.sqrt("ess")))
    few = F.col("n") < 10
    return out.select(name, "n", *(F.when(~few, F.col(c)).alias(c) for c in ("mean", "sd", *(f"acf_{k}" for k in lags), "ess", "mcse")))


def shrinkage_summary(draws: DataFrame, truth: DataFrame, threshold: float = 0.03) -> DataFrame:
    """Per pair (target, source) of draws (lambda, theta): quantiles of lambda, mean of |theta|, selected, and the outcome."""
    s = draw_summary(draws, ["target", "source"], "lambda").join(draws.groupBy("target", "source").agg(F.avg(F.abs("theta")).alias("abs_theta")), ["target", "source"])
    s = s.withColumn("selected", F.col("mean") > threshold).join(truth.select("target", "source", "true_active"), ["target", "source"], "left")
    active = F.coalesce("true_active", F.lit(False))
    outcome = F.when(F.col("selected") & active, "TP").when(F.col("selected"), "FP").when(active, "FN").otherwise("TN")
    return s.withColumn("true_active", active).withColumn("outcome", outcome)


def regression_metrics(rows: DataFrame, y: str, pred: str, keys=()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"), (1 - F.try_divide(F.sum(F.pow(F.col(y) - F.col(pred), 2)), F.var_pop(y) * F.count(y))).alias("r2"))




def relabel(draws: DataFrame, group: list[str], k: str, intensity: str) -> DataFrame:
    """Adds label: the rank of a cluster's mean intensity inside its group, ties to the smaller cluster."""
    w = Window.partitionBy(*group).orderBy(intensity, k)
    return draws.withColumn("label", F.row_number().over(w))


def total_flow(counts: DataFrame, t: str, y: str, rate: str | None = None) -> DataFrame:
    return counts.groupBy(t).agg(F.sum(y).alias("total"), *([F.sum(rate).alias("rate")] if rate else []))


def split_profile(counts: DataFrame, t: str, y: str, train: int, steps_day: int) -> DataFrame:
    """split, hour, mean, p10, p90 of counts before and after the last training step."""
    rows = counts.withColumn("split", F.when(F.col(t) <= train, "train").otherwise("test")).withColumn("hour", F.floor(F.pmod(F.col(t) - 1, F.lit(steps_day)) * 24 / steps_day).cast("int"))
    means = rows.groupBy("split", "hour").agg(F.avg(y).alias("mean"))
    return means.join(quantiles(rows, ["split", "hour"], y, (0.1, 0.9)), ["split", "hour"]).select("split", "hour", "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))


def forecast_error(bands: DataFrame, truth: DataFrame) -> DataFrame:
    """h, edge, error: |mean - rate| of bands (h, edge, mean) and truth (h, edge, rate)."""
    return bands.join(truth.select("h", "edge", "rate"), ["h", "edge"]).select("h", "edge", F.abs(F.col("mean") - F.col("rate")).alias("error"))
