"""Spatial matching by cells: every range or nearest join is an equi-join on grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import on_segment
from roadloom.operators.scans import ONE_TASK_ROWS, Scan
from roadloom.sources.lineage import cut


def cell(x, y, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def around(x, y, size: float, radius: float) -> Column:
    """All cells that the square of `radius` around a point touches."""
    at = lambda v, s: F.floor((v + s * radius) / size)
    return F.flatten(F.transform(F.sequence(at(x, -1), at(x, 1)), lambda i: F.transform(F.sequence(at(y, -1), at(y, 1)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def covered(ax, ay, bx, by, size: float) -> Column:
    """All cells that a segment passes, column by column: as many as it is long, not as many as its bounding box holds.

    A column's part of the segment is widened by a billionth of a cell, so that rounding loses no cell.
    """
    f = lambda v: F.floor(v / size)
    lx, hx, ly, hy = F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by)
    slope = F.coalesce(F.try_divide(by - ay, bx - ax), F.lit(0.0))
    flat = hx - lx <= 1e-12 * size  # straight up, all within one column
    eps = 1e-9 * size

    def column(i):
        at = lambda x: F.when(flat, None).otherwise(ay + (F.least(F.greatest(x, lx), hx) - ax) * slope)
        a, b = at(i * size), at((i + 1) * size)
        lo, hi = F.greatest(F.coalesce(F.least(a, b) - eps, ly), ly), F.least(F.coalesce(F.greatest(a, b) + eps, hy), hy)
        return F.transform(F.sequence(f(F.least(lo, hi)), f(F.greatest(lo, hi))), lambda j: F.struct(i.alias("cx"), j.alias("cy")))

    return F.flatten(F.transform(F.sequence(f(lx), f(hx)), column))


#: A nearest search starts at the coarsest squares of which those around a point hold at most this many middles: points,
#: or segments, which are wider and so are given to fewer squares.
NEAR, NEAR_SEGMENTS = 16, 64
#: Its squares are halved this often at most, and not below a 64th of the segments' mean length.
NEAR_LEVELS = 12


def _nearest(queries: DataFrame, segments: DataFrame, radius: float, spread: float, few: int, others: bool) -> DataFrame:
    """id, way, seg, dist, t: the nearest segment (way, seg, ax, ay, bx, by, group) of each query (id, x, y, group) among
    those of its group within radius; ties to the least way, then seg.

    At level k, the reach is radius / 2 ** k and squares are `spread` times as wide. A query starts at the level that fits
    the density around it (counts of segments' middles by squares) and goes up a level while nothing is within reach, so a
    query meets few segments however many are within the radius. Of segments at one place only the least way counts, or
    the two least where a query's own is left out.
    """
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    ax, ay, bx, by = ends
    reach = lambda k: F.lit(float(radius)) / F.pow(F.lit(2.0), k)
    size = lambda k: F.lit(float(spread * radius)) / F.pow(F.lit(2.0), k)
    probes = lambda k: F.explode(around(F.col("x"), F.col("y"), size(k), reach(k) * (1 + 1e-9))).alias("cell")
    same = Window.partitionBy("group", "ax", "ay", "bx", "by").orderBy("way")
    s = segments.groupBy("group", "ax", "ay", "bx", "by", "way").agg(F.min("seg").alias("seg"))
    tasks = queries.sparkSession.sparkContext.defaultParallelism  # few rows become many, so small tables are dealt to all cores too
    s = cut(s.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= (2 if others else 1)).drop("_n").repartition(tasks, "way"))
    middle = s.select("group", ((ax + bx) / 2).alias("x"), ((ay + by) / 2).alias("y"), F.hypot(bx - ax, by - ay).alias("l"))
    squares = middle.groupBy("group", cell(F.col("x"), F.col("y"), spread * radius).alias("cell")).agg(F.count("*").alias("n"), F.sum("l").alias("l"))
    top, mean = squares.agg(F.max("n"), F.sum("l") / F.sum("n")).first()
    deepest = 0
    while deepest < NEAR_LEVELS and (top or 0) > few * 2**deepest and 64 * spread * radius / 2 ** (deepest + 1) >= mean:
        deepest += 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level")
    counts = middle.select("group", "x", "y", levels).groupBy("group", "level", cell(F.col("x"), F.col("y"), size(F.col("level"))).alias("cell")).agg(F.count("*").alias("n"))
    left = cut(queries.select(F.monotonically_increasing_id().alias("_q"), "id", "x", "y", "group"))
    asked = left.select("_q", "x", "y", "group", levels).select("_q", "group", "level", probes(F.col("level")))
    near = asked.join(counts, ["group", "level", "cell"], "left").groupBy("_q", "level").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    start = near.groupBy("_q").agg(F.coalesce(F.min(F.when(F.col("n") <= few, F.col("level"))), F.lit(deepest)).alias("level"))
    left, found = cut(left.join(start, "_q").repartition(tasks, "_q")), []
    while used := sorted(r.level for r in left.select("level").distinct().collect()):  # a row a level
        at = s.withColumn("level", F.explode(F.array(*map(F.lit, used))))
        at = at.withColumn("cell", F.explode(covered(*ends, size(F.col("level")))))
        asked = left.select("_q", "id", "x", "y", "group", "level", probes(F.col("level")))
        hit = asked.hint("shuffle_hash").join(at, ["group", "level", "cell"])  # the many squares of segments stream by unsorted
        hit = hit.where(F.col("id") != F.col("way")) if others else hit
        hit = hit.withColumn("p", on_segment("x", "y", *ends)).where(F.col("p.dist") <= reach(F.col("level")))
        found.append(cut(hit.groupBy("_q", "id").agg(F.min(F.struct(F.col("p.dist").alias("dist"), "way", "seg", F.col("p.t").alias("t"))).alias("m"))))
        left = cut(left.join(found[-1].select("_q"), "_q", "left_anti").where("level > 0").withColumn("level", F.col("level") - 1))
    if not found:
        return s.select(F.col("way").alias("id"), "way", "seg", F.lit(0.0).alias("dist"), F.lit(0.0).alias("t")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.way", "m.seg", "m.dist", "m.t")


def nearest_points(queries: DataFrame, points: DataFrame, radius: float, others: bool = False) -> DataFrame:
    """id, nearest, dist of queries (id, x, y) whose nearest point (pid, px, py) is within radius; ties to the least pid.

    With `others`, both are one set, and a point is not its own nearest; likewise below.
    """
    one = F.lit("").alias("group")
    at = (F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("px").alias("bx"), F.col("py").alias("by"))  # segments of no length
    out = _nearest(queries.select("id", "x", "y", one), points.select(F.col("pid").alias("way"), F.lit(0).alias("seg"), *at, one), radius, 4.0, NEAR, others)
    return out.select("id", F.col("way").alias("nearest"), "dist")


def nearest_segments(queries: DataFrame, segments: DataFrame, radius: float, others: bool = False) -> DataFrame:
    """id, way, seg, dist, t of queries (id, x, y) and segments (way, seg, ax, ay, bx, by) within radius."""
    one = F.lit("").alias("group")
    return _nearest(queries.select("id", "x", "y", one), segments.select("way", "seg", "ax", "ay", "bx", "by", one), radius, 8.0, NEAR_SEGMENTS, others)


def stations_on_roads(stations: DataFrame, segments: DataFrame, radius: float = 250.0, others: bool = False) -> DataFrame:
    """Nearest segment of each station (id, x, y, route); segments (way, seg, ax, ay, bx, by, routes).

    A segment that carries the station's route comes first; any other counts only where no segment anywhere has
    that route. Segments are searched by their routes, and once more without for stations whose route has none.
    """
    any_route, named = F.lit("*"), lambda r: F.concat(F.lit("="), r.cast("string"))
    known = segments.select(F.explode("routes").alias("_known")).distinct()
    asked = stations.join(known, F.col("route") == F.col("_known"), "left")
    q = asked.select("id", "x", "y", F.coalesce(named(F.col("_known")), any_route).alias("group"))
    groups = F.array_union(F.coalesce(F.transform("routes", named), F.array().cast("array<string>")), F.array(any_route))
    s = segments.select("way", "seg", "ax", "ay", "bx", "by", F.explode(groups).alias("group")).join(q.select("group").distinct(), "group", "left_semi")
    return _nearest(q, s, radius, 8.0, NEAR_SEGMENTS, others).drop("t")


#: A search starts in the largest square of a point that holds at most this many segments' middles.
FEW = 64
#: Squares are halved this often at most, and not below a quarter of the segments' mean length.
LEVELS = 8
#: A way's sketch: its segments where it has so many at most, else the bounds of so many stretches.
SKETCH = 8


def _box(x, y, b, reach: float) -> Column:
    """Whether a box (lx, ly, hx, hy) has a point within reach."""
    away = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    return F.hypot(away(x, b("lx"), b("hx")), away(y, b("ly"), b("hy"))) <= reach


def _beside(x, y, reach: float) -> Column:
    """Whether a spot is within reach of the way's box on both axes."""
    return (x >= F.col("lx") - reach) & (x <= F.col("hx") + reach) & (y >= F.col("ly") - reach) & (y <= F.col("hy") + reach)


def _in_line(x, y, reach: float) -> Column:
    """Whether a spot is within reach of the line through a segment, a billionth more allowed for rounding."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    side = (x - F.col("ax")) * dy - (y - F.col("ay")) * dx
    return side * side <= (dx * dx + dy * dy) * (reach * reach * (1 + 1e-9)) + 1e-9


def _place(x, y, of) -> Column:
    """struct(dist, along) of the point of a segment that is nearest to a spot; `of` gives the segment's columns."""
    p = on_segment(x, y, *map(of, ("ax", "ay", "bx", "by")))
    return F.struct(p["dist"].alias("dist"), (of("at") + p["t"] * F.hypot(of("bx") - of("ax"), of("by") - of("ay"))).alias("along"))


def _least(x, y) -> Column:
    """The nearest place of a spot on the segments of a sketch."""
    return F.array_min(F.transform("sketch", lambda b: _place(x, y, lambda k: b[k])))


def sketches(segments: DataFrame) -> dict[str, DataFrame]:
    """Segments by the kind of their way, each with the way's box: of one segment ("one"), of SKETCH at most with all of
    them as `sketch` ("few"), of more with boxes around SKETCH stretches of it as `sketch` ("many")."""
    both = lambda f, c: f(F.col(f"a{c}"), F.col(f"b{c}"))
    rows = segments.withColumns({"lx": both(F.least, "x"), "ly": both(F.least, "y"), "hx": both(F.greatest, "x"), "hy": both(F.greatest, "y")})
    bounds = [*(F.min(c).alias(c) for c in ("lx", "ly")), *(F.max(c).alias(c) for c in ("hx", "hy"))]
    ways = segments.join(rows.groupBy("way").agg(F.count("*").alias("_n"), *bounds), "way")
    few, many = ways.where((F.col("_n") > 1) & (F.col("_n") <= SKETCH)), rows.join(ways.where(F.col("_n") > SKETCH).select("way").distinct(), "way", "left_semi")
    whole = few.groupBy("way").agg(F.collect_list(F.struct("ax", "ay", "bx", "by", "at")).alias("sketch"))
    place = F.floor(F.percent_rank().over(Window.partitionBy("way").orderBy("seg")) * (SKETCH - 1e-9)).alias("_k")
    boxes = many.select("way", place, "lx", "ly", "hx", "hy").groupBy("way", "_k").agg(*bounds).groupBy("way").agg(F.collect_list(F.struct("lx", "ly", "hx", "hy")).alias("sketch"))
    return {"one": ways.where("_n = 1").drop("_n"), "few": few.drop("_n").join(whole, "way"), "many": ways.drop("_n").join(boxes, "way")}


def start_levels(points: DataFrame, middles: DataFrame, size: float, deepest: int) -> DataFrame:
    """points (id, x, y) with level: the least k at which the square of side size / 2 ** k around the point's place holds
    at most FEW of `middles` (x, y), or `deepest`. Counts of coarser squares are sums of finer ones: a quadtree by counts."""
    side = size / 2**deepest
    counts = middles.groupBy(cell(F.col("x"), F.col("y"), side).alias("cell")).agg(F.count("*").alias("n"))
    at = points.withColumn("_cell", cell(F.col("x"), F.col("y"), side)).withColumn("level", F.lit(deepest))
    for k in range(deepest - 1, -1, -1):
        up = F.struct(*(F.floor(F.col(f"cell.{c}") / 2).alias(c) for c in ("cx", "cy")))
        counts = counts.select(up.alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))
        at = at.withColumn("_cell", F.struct(*(F.floor(F.col(f"_cell.{c}") / 2).alias(c) for c in ("cx", "cy"))))
        at = at.join(counts.select(F.col("cell").alias("_cell"), "n"), "_cell", "left")
        at = at.withColumn("level", F.when((F.coalesce("n", F.lit(0)) <= FEW) & (F.col("level") == k + 1), F.lit(k)).otherwise(F.col("level"))).drop("n")
    return at.drop("_cell")


def match_edges(edges: DataFrame, segments: DataFrame, end_limit: float = 90.0, mid_limit: float = 160.0, others: bool = False) -> DataFrame:
    """Best way of each edge (edge, ax, ay, bx, by, length) among segments (way, seg, ax, ay, bx, by, at), `at` the chainage.

    With `others`, edges and ways are one set, and an edge is not matched to the way of its own number.

    score = max(start, end) + 0.45 mid + 18 min(length penalty, 4); the least score wins, then the least way.

    Squares are searched by increasing distance: an edge starts with a reach that fits the density at its start (an
    adaptive quadtree over segments) and doubles it until its best score is within the reach, as no way farther from an
    end, or whose score is less, can then be missing. In a round, an edge meets the segments in the squares around its
    start. A way of few segments travels with them, so its score is known there and only each edge's best is shuffled. A
    longer one stays a candidate if boxes around its stretches are near enough to the edge's other two spots, and its
    distances come from its segments in the spots' squares.
    """
    c = {k: F.col(k) for k in ("ax", "ay", "bx", "by")}
    middle = segments.select(((c["ax"] + c["bx"]) / 2).alias("x"), ((c["ay"] + c["by"]) / 2).alias("y"), F.hypot(c["bx"] - c["ax"], c["by"] - c["ay"]).alias("l"))
    mean = middle.agg(F.avg("l")).first()[0] or 0.0
    deepest = 0
    while deepest < LEVELS and 2 * end_limit / 2 ** (deepest + 1) >= mean / 4:
        deepest += 1
    left = cut(start_levels(edges.withColumns({"x": c["ax"], "y": c["ay"]}), middle, 2 * end_limit, deepest).drop("x", "y"))
    ways = {k: cut(w) for k, w in sketches(segments).items()}
    ways = {k: w for k, w in ways.items() if k == "one" or not w.isEmpty()}
    found = []
    for k in range(deepest, -1, -1):
        now = left.where(F.col("level") >= k)
        if now.isEmpty():
            continue
        last, reach = k == 0, end_limit / 2**k
        best = cut(_within(now.drop("level"), ways, reach, mid_limit if last else min(mid_limit, reach / 0.45), others))
        done = best if last else best.where(F.col("score") <= reach)
        found.append(done)
        if last:
            break
        left = left.join(done.select("edge"), "edge", "left_anti")
        left = cut(left) if k % 2 else left
    out = found[0] if found else _within(left.drop("level"), ways, end_limit, mid_limit, others)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _within(edges: DataFrame, ways: dict[str, DataFrame], reach: float, mid_reach: float, others: bool) -> DataFrame:
    """edge, score, way, from_at, to_at: the best way that has both ends of an edge within `reach` and the middle within `mid_reach`."""
    size = 2 * reach
    c = {k: F.col(k) for k in ("ax", "ay", "bx", "by")}
    spots = {"start": (c["ax"], c["ay"], reach), "end": (c["bx"], c["by"], reach), "mid": ((c["ax"] + c["bx"]) / 2, (c["ay"] + c["by"]) / 2, mid_reach)}
    at = lambda name: (F.col(f"{name}_x"), F.col(f"{name}_y"))
    q = edges.select("edge", "length", *(v.alias(f"{name}_{a}") for name, (x, y, _) in spots.items() for a, v in (("x", x), ("y", y))))
    probe = q.withColumn("cell", F.explode(around(*at("start"), size, reach)))
    out = None
    for kind, w in ways.items():
        s = w.withColumn("cell", F.explode(covered(*c.values(), size)))
        near = probe.join(s, "cell")
        near = near.where("edge <> way") if others else near
        for name in spots:  # the join's condition is kept to a few comparisons and products: it is asked for each pair of a square
            near = near.where(_beside(*at(name), spots[name][2]))
            near = near.where(_in_line(*at(name), spots[name][2])) if kind == "one" or name == "start" else near
        if kind == "many":
            for name in ("end", "mid"):
                x, y, r = *at(name), spots[name][2]
                near = near.where(_any_box(x, y, r))
            ask = near.select("way", *q.columns).distinct()
            where = F.array(*(F.struct(F.lit(name).alias("spot"), *(v.alias(k) for k, v in zip("xy", at(name), strict=True)), F.lit(float(r)).alias("within")) for name, (_, _, r) in spots.items()))
            ask = ask.select("edge", "length", "way", F.explode(where).alias("p")).select("edge", "length", "way", "p.*")
            ask = ask.withColumn("cell", F.explode(around(F.col("x"), F.col("y"), size, F.col("within"))))
            hit = ask.join(s.select("way", "cell", *c, "at"), ["way", "cell"]).withColumn("p", _place(F.col("x"), F.col("y"), F.col)).where(F.col("p.dist") <= F.col("within"))
            spot = lambda name: F.min(F.when(F.col("spot") == name, F.col("p"))).alias(name)
            each = hit.groupBy("edge", "length", "way").agg(*map(spot, spots))
        else:
            place = (lambda name: _place(*at(name), F.col)) if kind == "one" else (lambda name: _least(*at(name)))
            each = near.select("edge", "length", "way", *(place(name).alias(name) for name in spots))
        penalty = F.abs(F.abs(F.col("end.along") - F.col("start.along")) - F.col("length")) / F.greatest("length", F.lit(1.0))
        score = F.greatest("start.dist", "end.dist") + 0.45 * F.col("mid.dist") + 18 * F.least(penalty, F.lit(4.0))
        ok = (F.col("start.dist") <= reach) & (F.col("end.dist") <= reach) & (F.col("mid.dist") <= mid_reach)
        scored = each.select("edge", F.when(ok, F.struct(score.alias("score"), "way", F.col("start.along").alias("from_at"), F.col("end.along").alias("to_at"))).alias("m"))
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy("edge").agg(F.min("m").alias("m")).where(F.col("m").isNotNull()).select("edge", "m.*")


def _any_box(x, y, reach: float) -> Column:
    return F.exists("sketch", lambda b: _box(x, y, lambda k: b[k], reach))


def chainage(points: DataFrame, one_task: int = ONE_TASK_ROWS, order: Sequence[str] = ("pos",), number: str | None = None) -> DataFrame:
    """Adds `at`, the length along each way up to a point; points are way, x, y and what they are ordered by. With
    `number`, points are numbered too, in the same sort."""
    scan = Scan(points, ["way"], order, one_task)
    scan = (scan.number(number) if number else scan).lag("_last", F.struct("x", "y"))
    return scan.sum("at", F.coalesce(F.hypot(F.col("x") - F.col("_last.x"), F.col("y") - F.col("_last.y")), F.lit(0.0))).done().drop("_last")


def subline(points: str, start: Column, end: Column) -> Column:
    """Points (array of x, y, at in order) between two chainages, the ends interpolated; reversed where end < start."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    n = F.size(points)

    def at(d: Column) -> Column:
        k = F.least(F.greatest(F.size(F.filter(points, lambda p: p["at"] <= d)), F.lit(1)), n - 1)
        a, b = F.get(points, k - 1), F.get(points, k)
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(d - a["at"], b["at"] - a["at"]))), F.lit(0.0))
        return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))

    inner = F.transform(F.filter(points, lambda p: (p["at"] > lo + 1e-9) & (p["at"] < hi - 1e-9)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    line = F.concat(F.array(at(lo)), inner, F.array(at(hi)))
    return F.when(end < start, F.reverse(line)).otherwise(line)


def around_match(points: str, at: Column, half: float = 260.0) -> Column:
    """The part of a way within `half` metres of chainage on either side of a match, cut off at the way's ends."""
    last = F.element_at(F.transform(points, lambda p: p["at"]), -1)
    return subline(points, F.greatest(at - half, F.lit(0.0)), F.least(at + half, last))
