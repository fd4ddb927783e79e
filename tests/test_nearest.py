"""Nearest searches where many are within the radius, against all distances."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadloom.operators import spatial
from roadloom.sources.lineage import cut


def _dense(spark, copies, others):
    """Points at one place and others close by, all within the radius of each other, and what a search of some of them finds."""
    r = np.random.default_rng(5)
    at = np.vstack([np.full((copies, 2), 10.0), r.uniform(0, 50, (others, 2))])
    end = at + r.uniform(-8, 8, at.shape) * (np.arange(len(at)) >= copies)[:, None]
    rows = pd.DataFrame({"id": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1], "ex": end[:, 0], "ey": end[:, 1]})
    return cut(spark.createDataFrame(rows)), at, end


def _some(found, at, end, value, usable=lambda i, w: w >= 0):
    way = np.arange(len(at))
    for i in (0, 1, 7, len(at) // 2, *range(len(at) - 25, len(at))):
        d = end - at
        size = (d**2).sum(1)
        t = np.clip(((at[i] - at) * d).sum(1) / np.where(size > 1e-12, size, 1), 0, 1) * (size > 1e-12)
        dist = np.where((way != i) & usable(i, way), np.hypot(*(at[i] - at - t[:, None] * d).T), np.inf)
        w = int(np.lexsort((way, dist))[0])
        assert found[i] == (w, pytest.approx(dist[w], abs=1e-9)), (i, w, value)


@pytest.fixture
def within_minutes(spark):
    """Jobs that go on for three minutes are ended, which fails the test: pairs of all points would take longer."""
    timer = threading.Timer(180, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def test_nearest_segments_meet_few_where_all_are_within_the_radius(spark, within_minutes):
    p, at, end = _dense(spark, 40_000, 20_000)
    s = p.select(F.col("id").alias("way"), F.lit(0).alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ex").alias("bx"), F.col("ey").alias("by"))
    got = {r.id: (r.way, r.dist) for r in spatial.nearest_segments(p.select("id", "x", "y"), s, 60.0, others=True).collect()}
    assert len(got) == len(at)
    _some(got, at, end, "segment")


def test_stations_meet_few_segments_of_their_routes(spark, within_minutes):
    p, at, end = _dense(spark, 30_000, 15_000)
    ends = (F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ex").alias("bx"), F.col("ey").alias("by"))
    s = p.select(F.col("id").alias("way"), F.lit(0).alias("seg"), *ends, F.array(F.col("id") % 2).alias("routes"))
    got = {r.id: (r.way, r.dist) for r in spatial.stations_on_roads(p.select("id", "x", "y", (F.col("id") % 3).alias("route")), s, 60.0, others=True).collect()}
    assert len(got) == len(at)
    _some(got, at, end, "route", lambda i, way: (i % 3 == 2) | (way % 2 == i % 3))


def test_routes_that_are_null_or_nowhere(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 0.0, ["a", "a"]), (2, 0, 0.0, 1.0, 9.0, 1.0, None), (3, 0, 0.0, 2.0, 9.0, 2.0, ["b", None])], "way int, seg int, ax double, ay double, bx double, by double, routes array<string>")
    q = spark.createDataFrame([(1, 4.0, 1.0, "a"), (2, 4.0, 1.0, None), (3, 4.0, 1.0, "c"), (4, 4.0, 1.0, "b"), (5, 400.0, 1.0, "a"), (6, None, 1.0, "a")], "id int, x double, y double, route string")
    assert sorted((r.id, r.way) for r in spatial.stations_on_roads(q, s, 50.0).collect()) == [(1, 1), (2, 2), (3, 2), (4, 3)]


def test_nearest_points_meet_few_where_all_are_within_the_radius(spark, within_minutes):
    p, at, _ = _dense(spark, 30_000, 15_000)
    got = {r.id: (r.nearest, r.dist) for r in spatial.nearest_points(p.select("id", "x", "y"), p.select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py")), 60.0, others=True).collect()}
    assert len(got) == len(at)
    _some(got, at, at, "point")
