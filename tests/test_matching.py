"""Map matching by adaptive squares against brute force, and its growth."""

import math
import random

from pyspark.sql import functions as F

from roadloom.operators import spatial


def on_segment(px, py, ax, ay, bx, by):
    d2 = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0.0 if d2 <= 1e-12 else max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d2))
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)), t


def brute(edges, segments, others):
    ways, out = {}, {}
    for way, _, *ends, at in segments:
        ways.setdefault(way, []).append((ends, at))
    for edge, ax, ay, bx, by, length in edges:
        best = None
        for way, own in ways.items():
            if others and way == edge:
                continue
            spots = []
            for x, y in ((ax, ay), ((ax + bx) / 2, (ay + by) / 2), (bx, by)):
                spots.append(min((d, at + t * math.hypot(e[2] - e[0], e[3] - e[1])) for e, at in own for d, t in [on_segment(x, y, *e)]))
            (ds, s0), (dm, _), (de, s1) = spots
            if ds <= 90 and de <= 90 and dm <= 160:
                score = max(ds, de) + 0.45 * dm + 18 * min(abs(abs(s1 - s0) - length) / max(length, 1.0), 4.0)
                best = min(best or (math.inf, 0), (score, way))
        if best:
            out[edge] = best
    return out


def town(r, ways, size, dense=0.0):
    """Ways of 1 to 30 segments, and edges beside them; a share of both in one small square."""
    segments, edges = [], []
    for w in range(ways):
        small = r.random() < dense
        x, y = (r.uniform(0, 3), r.uniform(0, 3)) if small else (r.uniform(0, size), r.uniform(0, size))
        a, at = r.uniform(0, 6.3), 0.0
        for k in range(r.choice([1, 1, 2, 5, 9, 30])):
            a += r.uniform(-0.7, 0.7)
            step = r.uniform(0.1, 0.5) if small else r.uniform(0, 40)
            u, v = x + step * math.cos(a), y + step * math.sin(a)
            segments.append((w, k, x, y, u, v, at))
            at, x, y = at + math.hypot(u - x, v - y), u, v
        first, last = segments[-1 - k], segments[-1]
        noise = [r.gauss(0, 0.3 if small else 15) for _ in range(4)]
        edges.append((w, first[2] + noise[0], first[3] + noise[1], last[4] + noise[2], last[5] + noise[3], at))
    return edges, segments


def frames(spark, edges, segments):
    e = spark.createDataFrame(edges, "edge long, ax double, ay double, bx double, by double, length double")
    return e, spark.createDataFrame(segments, "way long, seg int, ax double, ay double, bx double, by double, at double")


def test_against_brute_force(spark):
    for seed, dense in ((1, 0.0), (2, 0.7)):
        edges, segments = town(random.Random(seed), 150, 900, dense)
        for others in (False, True):
            got = {m.edge: (m.score, m.way) for m in spatial.match_edges(*frames(spark, edges, segments), others=others).collect()}
            want = brute(edges, segments, others)
            assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and all(abs(v[0] - want[k][0]) < 1e-9 for k, v in got.items())


def test_no_rows(spark):
    edges, segments = frames(spark, town(random.Random(0), 3, 50)[0], town(random.Random(0), 3, 50)[1])
    assert spatial.match_edges(edges.limit(0), segments).count() == 0 and spatial.match_edges(edges, segments.limit(0)).count() == 0


def test_levels_follow_density(spark):
    """Where segments are dense a search starts in small squares, elsewhere in the whole reach."""
    r = random.Random(4)
    middles = [(r.uniform(0, 5), r.uniform(0, 5)) for _ in range(5000)] + [(r.uniform(1000, 9000), r.uniform(1000, 9000)) for _ in range(100)]
    points = spark.createDataFrame([(1, 2.5, 2.5), (2, 5000.0, 5000.0)], "id int, x double, y double")
    got = {p.id: p.level for p in spatial.start_levels(points, spark.createDataFrame(middles, "x double, y double"), 180.0, 8).collect()}
    assert got[2] == 0 and got[1] >= 6


def shuffled(spark) -> int:
    """Bytes that all stages so far wrote for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_shuffle_grows_with_the_rows(spark):
    """As many times more ways on the same ground: what is shuffled grows with the rows to the power 1.2 at most."""
    took, sizes = [], (500, 2000, 8000)
    for n in sizes:
        r = random.Random(n)
        ends = [(r.gauss(0, 120), r.gauss(0, 120), r.gauss(0, 30), r.gauss(0, 30)) for _ in range(n)]
        segments = [(k, 0, x, y, x + u, y + v, 0.0) for k, (x, y, u, v) in enumerate(ends)]
        edges = [(k, x, y, x + u, y + v, math.hypot(u, v)) for k, (x, y, u, v) in enumerate(ends)]
        before = shuffled(spark)
        spatial.match_edges(*frames(spark, edges, segments), others=True).write.format("noop").mode("overwrite").save()
        took.append(shuffled(spark) - before)
    print(took)
    for k in (1, 2):
        assert took[k] <= took[0] * (sizes[k] / sizes[0]) ** 1.2


def test_chainage_of_a_long_way(spark):
    rows = spark.range(2000).select(F.lit(1).alias("way"), F.col("id").alias("pos"), (F.col("id") * 3.0).alias("x"), (F.col("id") * 4.0).alias("y"))
    assert {r.pos: r.at for r in spatial.chainage(rows).collect()} == {k: 5.0 * k for k in range(2000)}
