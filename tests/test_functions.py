"""Hand-written cases of the scalar functions and cleaning operators."""

import math

import pytest
from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import clean, panel, stations


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


@pytest.mark.parametrize(
    ("enter", "leave", "width", "bins"),
    [
        (1.8, 2.2, 1.0, [1, 2]), (1.8, 2.0, 1.0, [1]), (2.0, 2.2, 1.0, [2]), (7.0, 7.0, 5.0, [1]), (1440.0, 1440.0, 5.0, []), (-3.0, 2.0, 5.0, [0]),
        (1438.0, 1450.0, 5.0, [287]), (-5.0, -1.0, 5.0, []), (9.0, 8.0, 5.0, []), (float("nan"), 8.0, 5.0, []), (3.0, float("inf"), 5.0, []), (1500.0, 1600.0, 5.0, []),
    ],
)
def test_occupancy(spark, enter, leave, width, bins):
    assert one(spark, S.occupancy_bins(F.lit(enter), F.lit(leave), width))[0] == bins


def test_parsing(spark):
    r = one(spark, S.split_numbers(F.lit("1;x;3")), S.split_numbers(F.lit("1;x;3"), strict=True), S.to_int(F.lit("12.7")), S.to_num(F.lit(" nan ")), S.to_num(F.lit("x")), S.split_numbers(F.lit(' "4; ;5" '), whole=True))
    assert (r[0], r[1], r[2], r[3], r[4], r[5]) == ([1, 3], None, 12, None, None, [4, 5])


def test_metadata_rows(spark):
    fields = [str(i) for i in range(20)]
    f = lambda v: F.array(*map(F.lit, v))
    r = one(spark, S.fold_fields(f(fields)), S.fold_fields(f(fields[:3])), S.fold_fields(f(fields[:18])))
    assert len(r[0]) == 18 and r[0][13] == "13 14 15" and r[0][14:] == ["16", "17", "18", "19"]
    assert len(r[1]) == 18 and r[1][3] == "" and r[2] == fields[:18]


def test_routes_lists_slugs(spark):
    r = one(spark, S.route_numbers(F.lit("I 15;SR 163"), F.lit(None).cast("string"), F.lit("1234 x8")), S.parse_list(F.lit("a, b，c,,")), S.slug(F.lit(" a b/c ")), S.slug(F.lit("//")), S.slot_of(F.lit("07:35")), S.bin_label(F.lit(3), 5))
    assert (r[0], r[1], r[2], r[3], r[4], r[5]) == (["15", "163", "8"], ["a", "b", "c"], "a_b_c", "run", 91, "00:15-00:20")


def test_geometry(spark):
    v = [F.lit(float(x)) for x in (1, 1, 0, 0, 2, 0)]
    r = one(spark, S.on_segment(*v), S.on_segment(v[0], v[1], v[2], v[2], v[2], v[2]), *S.wgs84_to_gcj02(F.lit(10.0), F.lit(10.0)), S.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert r[0]["dist"] == 1 and r[0]["t"] == 0.5 and abs(r[1]["dist"] - math.sqrt(2)) < 1e-12 and (r[2], r[3]) == (10, 10)
    assert abs(r[4] - 6371000 * math.pi / 180) < 1e-6


def test_densities(spark):
    r = one(spark, *(S.ln_factorial(F.lit(float(k))) for k in (0, 5, 15, 16, 170, 5000)), S.poisson_logpmf(F.lit(3.0), F.lit(2.0)), S.gaussian_logpdf(F.lit(1.0), F.lit(0.0), F.lit(2.0)), S.half_cauchy_logpdf(F.lit(-1.0), F.lit(1.0)), S.half_cauchy_logpdf(F.lit(1.0), F.lit(1.0)))
    assert all(abs(a - math.lgamma(k + 1)) < 1e-9 * max(1, a) for a, k in zip(r[:6], (0, 5, 15, 16, 170, 5000), strict=True))
    assert abs(r[6] - (3 * math.log(2) - 2 - math.log(6))) < 1e-12 and abs(r[7] + 0.125 + math.log(2 * math.sqrt(2 * math.pi))) < 1e-12
    assert r[8] == float("-inf") and abs(r[9] + math.log(math.pi)) < 1e-12


def test_season_starts_at_zero(spark):
    assert one(spark, S.season(F.lit(1)))[0] == [0, 1, 0, 1]


def test_directions(spark):
    links = spark.createDataFrame([(1, 10, 20, -1, 5.0), (2, 10, 20, 0, 0.0), (3, 10, 20, 2, None), (4, 10, 20, 1, 7.0), (5, 10, 20, None, 7.0)], "id int, from_node_id long, to_node_id long, direction int, length double")
    nodes = spark.createDataFrame([(10, 0.0, 0.0), (20, 3000.0, 4000.0)], "node_id long, x double, y double")
    got = sorted((r.id, r.from_node_id, r.length) for r in clean.direct(links, nodes).collect())
    assert got == [(1, 20, 5.0), (2, 10, 5.0), (2, 20, 5.0), (3, 10, 5.0), (3, 20, 5.0), (4, 10, 7.0), (5, 10, 7.0)]


def test_latest_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([("a", "2020-01-02", 2, "x"), ("a", "2020-01-02", 1, "y"), ("a", "2020-01-01", 0, "z")], "k string, d string, n int, v string")
    assert [r.v for r in clean.latest(rows, "k", "d", "n").collect()] == ["y"]


def test_dense_index(spark):
    got = clean.dense_index(spark.range(1000).repartition(7).withColumn("k", 999 - F.col("id")), ["k"], "i").collect()
    assert all(r.i == r.k for r in got) and len(got) == 1000


def test_required_and_optional(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="b"):
        clean.require(df, ["a", "b"])
    assert clean.optional(df, {"a": "long", "b": "double"}).first() == (1, None)


def test_short_paths_have_no_segments(spark):
    p = spark.createDataFrame([(1, [5], [0.0]), (2, [], []), (3, [1, 2, 3], [0.0, 1.0, 2.0])], "id int, nodes array<long>, times array<double>")
    assert sorted((r.id, r.step, r["from"], r.to) for r in panel.path_segments(p).collect()) == [(3, 0, 1, 2), (3, 1, 2, 3)]


def test_weighted_mean_of_nothing(spark):
    rows = spark.createDataFrame([("s", 0.0, 5.0), ("s", 0.0, 6.0)], "station string, samples double, flow double")
    for policy in ("strict", "reference"):
        assert rows.groupBy("station").agg(stations.weighted("flow", "samples", policy).alias("m")).first().m is None
    with pytest.raises(ValueError):
        stations.weighted("a", "b", "other")


def test_weighted_mean_that_ends_in_five_is_rounded_exactly(spark):
    rows = [(85619.57, 3.0), (45437.13, 33.0), (16548.38, 48.0), (99093.31, 28.0)]  # 47546.5975; a running sum of doubles falls short of it
    mean = lambda r: spark.createDataFrame(r, "flow double, samples double").coalesce(1).agg(stations.weighted_rounded("flow", "samples", 100, 3).alias("m")).first().m
    assert mean(rows) == mean(rows[::-1]) == 47546.598 and mean([(-f, s) for f, s in rows]) == -47546.598
    assert mean([(1.005, 1.0), (2.0, 1.0)]) == 1.503 and mean([(1.0, 0.5), (2.0, 0.5)]) == 1.5 and mean([(1.0, 0.0), (None, 2.0)]) is None
    assert mean([(float("inf"), 1.0)]) == float("inf") and mean([(1e300, 2.0), (1e300, 1.0)]) == 1e300
