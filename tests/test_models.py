"""Kernels against closed forms, recovery from simulated counts, and models as Spark jobs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators import chains, evaluate, kernels, simulate, topology


def test_polya_gamma_mean():
    rng = np.random.default_rng(0)
    for b, z in ((1.0, 0.0), (5.0, 2.0), (300.0, -3.0)):
        draws = kernels.polya_gamma(np.full(4000, b), z, rng)
        assert abs(draws.mean() / kernels.polya_gamma_mean(b, z) - 1) < 0.03


def test_filter_against_dense_gaussian():
    rng = np.random.default_rng(1)
    steps, p = 6, 2
    f, y, v = rng.normal(size=(steps, p)), rng.normal(size=steps), rng.uniform(0.5, 2, steps)
    m0, c0, w = np.array([0.3, -0.2]), np.diag([2.0, 1.0]), np.diag([0.3, 0.1])
    m, c, _, _, log_lik = kernels.filter_path(y, v, f, m0, c0, w)
    cov = np.zeros((steps * p, steps * p))
    for s, t in itertools.product(range(steps), repeat=2):
        cov[s * p : s * p + p, t * p : t * p + p] = c0 + (min(s, t) + 1) * w
    big = np.zeros((steps, steps * p))
    for t in range(steps):
        big[t, t * p : t * p + p] = f[t]
    s = big @ cov @ big.T + np.diag(v)
    e = y - big @ np.tile(m0, steps)
    gain = cov @ big.T @ np.linalg.inv(s)
    assert np.allclose(m[-1], (np.tile(m0, steps) + gain @ e)[-p:]) and np.allclose(c[-1], (cov - gain @ big @ cov)[-p:, -p:])
    assert abs(log_lik + 0.5 * (e @ np.linalg.solve(s, e) + np.linalg.slogdet(s)[1] + steps * math.log(2 * math.pi))) < 1e-9


def test_backward_draws_have_the_smoothed_mean():
    rng = np.random.default_rng(2)
    y, f, v = rng.normal(size=5), np.ones((5, 1)), np.full(5, 1.0)
    out = kernels.filter_path(y, v, f, np.zeros(1), np.eye(1), np.eye(1) * 0.5)
    draws = np.mean([kernels.sample_path(*out[:4], rng)[:, 0] for _ in range(6000)], axis=0)
    cov = np.array([[1 + 0.5 * (min(s, t) + 1) for t in range(5)] for s in range(5)])
    assert np.abs(draws - cov @ np.linalg.solve(cov + np.eye(5), y)).max() < 0.04


def test_rand_index_and_accuracy():
    x = np.array([0, 0, 1, 1, 2, 2])
    assert kernels.rand_index(x, x) == 1 and kernels.rand_index(np.zeros(5, int), np.zeros(5, int)) == 0
    assert math.isnan(kernels.rand_index(np.zeros(1), np.zeros(1)))
    assert kernels.permutation_accuracy(x, (x + 1) % 3, 3) == 1


def test_cluster_recovery(spark):
    index = simulate.time_index(spark, days=3, steps_day=24)
    counts, truth = simulate.cluster_counts(index, 18)
    draws = chains.cluster_draws(counts, simulate.design(index), 3, chains=2, iters=60, burn=30, truth=truth).cache()
    summary = {(r.quantity, r.k): r["mean"] for r in chains.chain_summary(draws, 30).collect()}
    assert summary["ari", None] > 0.5 and summary["mean_lambda", 1] < summary["mean_lambda", 3]
    assert draws.where("quantity = 'z'").count() == 2 * 30 * 18
    assert chains.trace(draws, "ari").count() == 2 * 60 * 2
    modes = evaluate.posterior_mode(draws.where("quantity = 'z' and chain = 1").withColumn("value", F.col("value").cast("int")), "edge", "value")
    assert modes.count() == 18
    draws.unpersist()


def test_neighbourhood_model(spark):
    sim = simulate.neighbourhood_counts(spark, 2, 2, steps_day=24, days=6, train_days=5)
    pairs = sim["pairs"]
    blocks = chains.design_blocks(sim["train"], pairs, steps_day=24, scale=1.5).cache()
    assert blocks.count() == 8 * 120
    for shrink in (False, True):
        fits = chains.fit_edges(blocks, pairs, iters=40, burn=20, shrink=shrink).cache()
        assert fits.count() == 8 * 10
        each = chains.pair_draws(fits, pairs)
        assert each.count() == 10 * pairs.count() and each.where("lambda <= 0").count() == 0
        last = sim["train"].where("t = 120").select("edge", "y")
        draws = chains.forecast(fits, pairs, last, 24, 121, steps_day=24, scale=1.5, saved=10).cache()
        assert draws.count() == 10 * 24 * 8
        bands = chains.forecast_bands(draws).withColumn("t", F.col("h") + 120).join(sim["test"].withColumnRenamed("rate", "truth"), ["t", "edge"])
        score = evaluate.fit_scores(bands, "t", "y", "mean", "truth").first()
        assert score.mae < bands.agg(F.avg("truth")).first()[0] and chains.forecast_total(draws).count() == 24
        again = chains.forecast(fits, pairs, last, 24, 121, steps_day=24, scale=1.5, saved=10)
        assert draws.exceptAll(again).isEmpty()
        if shrink:
            assert evaluate.shrinkage_summary(each, sim["truth"]).where("outcome is null").isEmpty()


def test_picked_draws():
    assert chains.picked_draws(5, 80) == [1, 2, 3, 4, 5] and len(chains.picked_draws(200, 80)) == 80 and chains.picked_draws(200, 80)[-1] == 200


def test_chain_arguments():
    with pytest.raises(ValueError):
        next(kernels.cluster_chain(np.ones((2, 3)), np.ones((3, 1)), 1, 5, 5))
    with pytest.raises(ValueError):
        kernels.edge_chain(np.ones(3), np.ones((3, 5)), 5, 5, 5)


def test_one_column_design():
    y = np.random.default_rng(0).poisson(4, (5, 10))
    assert len(list(kernels.cluster_chain(y, np.ones((10, 1)), 2, 4, 1))) == 4


def test_booster_reaches_its_quantile():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (1500, 2))
    y = 3 * x[:, 0] + rng.exponential(1, 1500)
    model = kernels.QuantileBooster(0.9, trees=120, rate=0.1).fit(x, y)
    assert abs((y <= model.predict(x)).mean() - 0.9) < 0.04 and np.corrcoef(model.predict(x), x[:, 0])[0, 1] > 0.8


def test_pair_tables(spark):
    nodes, edges = topology.grid(spark, 4, 4)
    assert edges.count() == 48
    for rule, n in (("origin", 304), ("two_endpoint", 512)):
        t = topology.pair_table(edges, nodes, rule, "m")
        assert t.count() == n and t.where("distance <> 0 or relation = 'nearby'").count() == 0
    with pytest.raises(ValueError):
        topology.lag_sources(edges, "other")


def test_paths_against_floyd_warshall(spark):
    nodes, edges = topology.grid(spark, 5, 5)
    edges = edges.withColumn("length", 1 + (F.col("edge") * 7) % 5 + 0.0)
    rows, big = edges.collect(), float("inf")
    d = np.full((26, 26), big)
    np.fill_diagonal(d, 0)
    for r in rows:
        d[r["from"], r.to] = r.length
    for k in range(26):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    got = topology.k_nearest(nodes, edges, 6).collect()
    for r in got:
        assert abs(r.distance - d[r.node, r.neighbor]) < 1e-9
        assert r.distance == sorted(d[r.node, [j for j in range(1, 26) if j != r.node]])[r.rank - 1]
    asked = spark.createDataFrame([(1, 25, 1e9), (1, 1, 1.0), (1, 25, 0.5)], "source long, target long, budget double")
    got = {(r.target, r.budget): (list(r.path), r.cost) for r in topology.routes(asked, edges).collect()}
    path, cost = got[(25, 1e9)]
    assert cost == d[1, 25] and path[0] == 1 and path[-1] == 25 and got[(1, 1.0)] == ([1], 0) and got[(25, 0.5)] == ([], None)
    relaxed = {(r.source, r.node): r.distance for r in topology.relax_distances(nodes, edges, 8, cut=lambda x: x).where("source = 1").collect()}
    assert all(abs(relaxed[1, j] - d[1, j]) < 1e-9 for j in range(1, 26))


def test_factors():
    a = np.array([[4.0, 1.0], [1.0, 3.0]])
    assert np.allclose(kernels.inverse(a) @ a, np.eye(2), atol=1e-6)
    low = kernels.safe_cholesky(np.array([[1.0, 1.0], [1.0, 1.0 - 1e-7]]))  # needs more than the first jitter
    assert np.isfinite(low).all() and low[1, 1] > 0
    rng = np.random.default_rng(0)
    draws = np.stack([kernels.normal_by_factor(np.array([1.0, 2.0]), kernels.cholesky(a), rng) for _ in range(4000)])
    assert np.allclose(draws.mean(0), [1, 2], atol=0.1) and np.allclose(np.cov(draws.T), a, atol=0.3)


def test_scaled_eta(spark):
    row = spark.createDataFrame([([1.0, 0.5, 2.0, 3.0], [0.1, 0.2, 0.3, 0.4], [0.5, 2.0])], "x array<double>, b array<double>, l array<double>")
    assert abs(row.select(chains.scaled_eta("x", "b", "l", 2).alias("e")).first().e - (0.1 + 0.1 + 0.3 + 2.4)) < 1e-12


def test_simulated_clusters(spark):
    counts, truth = simulate.cluster_counts(simulate.time_index(spark, days=2), 12)
    again, _ = simulate.cluster_counts(simulate.time_index(spark, days=2), 12)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(counts) == rows(again) and counts.count() == 12 * 96
    assert [r.n for r in truth.groupBy("z").agg(F.count("*").alias("n")).orderBy("z").collect()] == [4, 4, 4]
    means = {r.z: r.m for r in counts.join(truth, "edge").groupBy("z").agg(F.avg("y").alias("m")).collect()}
    assert means[1] < means[2] < means[3]


def test_pages_and_progress():
    from roadloom.sources import sinks

    assert sinks.progress_line("sweep", 3, 10, 4.0) == "sweep 3/10 (30 %), about 16 s left" and sinks.progress_line("sweep", 1, 10, 0) == "sweep 1/10 (10 %)"
    page = sinks.html_page("a <b>", ['window.NETWORK = {"features":[]};', 'window.X = "</script>";'])
    assert "a &lt;b>" in page and page.count("</script>") == 3
