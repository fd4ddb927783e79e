"""Networks, neighbours, spatial matching, coordinates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import spatial, topology
from roadloom.plans.catalogue import register
from roadloom.plans.roles import EDGES_SQL, TRIPS_SQL, nation_edges, table
from roadloom.sources import sinks, tables

RELATIONS = (("upstream", "a.\"from\" = b.\"to\"", "from"), ("downstream", "a.\"to\" = b.\"from\"", "to"), ("share_from", "a.\"from\" = b.\"from\"", "from"), ("share_to", "a.\"to\" = b.\"to\"", "to"))


NEIGHBORS_SQL = f"WITH {TRIPS_SQL}, {EDGES_SQL} " + " UNION ALL ".join(
    f"""SELECT a.edge, b.edge AS neighbor, '{r}' AS relation, a."{s}" AS shared, a.length / 2 + b.length / 2 AS distance, a."from" = b."to" AND a."to" = b."from" AS is_reverse FROM edges a JOIN edges b ON {c} AND a.edge <> b.edge"""
    for r, c, s in RELATIONS)


@register(NEIGHBORS_SQL)
def edge_neighbors(spark, sf):
    return topology.edge_neighbors(nation_edges(spark, sf))


GRID = """n AS (SELECT (s_suppkey + 1)::BIGINT AS node, (s_suppkey % 10 + 1)::INT AS x, (s_suppkey // 10 + 1)::INT AS y FROM supplier WHERE s_suppkey < (SELECT count(*) // 10 * 10 FROM supplier)),
p AS (SELECT a.node AS f, b.node AS t FROM n a JOIN n b ON (b.x = a.x AND (b.y = a.y + 1 OR b.y = a.y - 1)) OR (b.y = a.y AND (b.x = a.x + 1 OR b.x = a.x - 1))),
e AS (SELECT row_number() OVER (ORDER BY f, t) AS edge, f, t FROM p)"""


def _supplier_grid(spark, sf):
    """Suppliers as the nodes of a grid, ten a row; a row that isn't full is left out, as a grid is a rectangle."""
    return topology.grid(spark, table(spark, sf, "supplier").count() // 10, 10)


@register(f"""WITH {GRID} SELECT edge, f AS "from", t AS "to" FROM e""")
def grid_network(spark, sf):
    return _supplier_grid(spark, sf)[1].select("edge", "from", "to")


def _pairs_sql(rule):
    on = "s.f = a.f OR s.t = a.f" + (" OR s.f = a.t OR s.t = a.t" if rule == "two_endpoint" else "")
    return f"""WITH {GRID} SELECT a.edge AS target, s.edge AS source, CASE WHEN a.edge = s.edge THEN 'self' WHEN s.f = a.f OR s.t = a.f THEN 'origin' WHEN s.f = a.t OR s.t = a.t THEN 'destination' ELSE 'nearby' END AS relation,
0::DOUBLE AS distance, '{rule}_e' || a.edge || '_lag' || s.edge AS pair_name FROM e a JOIN e s ON {on} OR a.edge = s.edge"""


def _pairs(rule):
    def run(spark, sf):
        nodes, edges = _supplier_grid(spark, sf)
        return topology.pair_table(edges, nodes, rule, rule)

    return run


for _r in ("origin", "two_endpoint"):
    register(_pairs_sql(_r), f"pair_table_{_r}")(_pairs(_r))


@register(f"WITH {GRID} SELECT a.edge AS target, s.edge AS source, a.edge = s.edge OR s.f = a.f OR s.t = a.f AS true_active FROM e a JOIN e s ON s.f = a.f OR s.t = a.f OR s.f = a.t OR s.t = a.t")
def true_pairs(spark, sf):
    nodes, edges = _supplier_grid(spark, sf)
    truth = topology.lag_sources(edges, "origin").withColumn("true_active", F.lit(True))
    return topology.with_truth(topology.pair_table(edges, nodes, "two_endpoint", "b"), truth).select("target", "source", "true_active")


RECURSE = """, d AS (SELECT n_nationkey::BIGINT AS source, n_nationkey::BIGINT AS node, 0::DOUBLE AS distance FROM nation),
d1 AS (SELECT source, node, min(distance) AS distance FROM (FROM d UNION ALL SELECT source, "to", distance + length FROM d JOIN edges ON node = "from") GROUP BY 1, 2),
d2 AS (SELECT source, node, min(distance) AS distance FROM (FROM d1 UNION ALL SELECT source, "to", distance + length FROM d1 JOIN edges ON node = "from") GROUP BY 1, 2),
d3 AS (SELECT source, node, min(distance) AS distance FROM (FROM d2 UNION ALL SELECT source, "to", distance + length FROM d2 JOIN edges ON node = "from") GROUP BY 1, 2),
d4 AS (SELECT source, node, min(distance) AS distance FROM (FROM d3 UNION ALL SELECT source, "to", distance + length FROM d3 JOIN edges ON node = "from") GROUP BY 1, 2),
d5 AS (SELECT source, node, min(distance) AS distance FROM (FROM d4 UNION ALL SELECT source, "to", distance + length FROM d4 JOIN edges ON node = "from") GROUP BY 1, 2),
d6 AS (SELECT source, node, min(distance) AS distance FROM (FROM d5 UNION ALL SELECT source, "to", distance + length FROM d5 JOIN edges ON node = "from") GROUP BY 1, 2),
d7 AS (SELECT source, node, min(distance) AS distance FROM (FROM d6 UNION ALL SELECT source, "to", distance + length FROM d6 JOIN edges ON node = "from") GROUP BY 1, 2),
d8 AS (SELECT source, node, min(distance) AS distance FROM (FROM d7 UNION ALL SELECT source, "to", distance + length FROM d7 JOIN edges ON node = "from") GROUP BY 1, 2)"""
NEAREST_SQL = f"""WITH {TRIPS_SQL}, {EDGES_SQL}{RECURSE}
SELECT source AS node, node AS neighbor, distance, row_number() OVER (PARTITION BY source ORDER BY distance, node)::INT AS rank FROM d8 WHERE source <> node QUALIFY rank <= 5"""


def _nations(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))


@register(NEAREST_SQL)
def k_nearest_nodes(spark, sf):
    return topology.k_nearest(_nations(spark, sf), nation_edges(spark, sf), 5)


@register(f"WITH {TRIPS_SQL}, {EDGES_SQL}{RECURSE.split(', d3 AS')[0].rsplit('d3 AS', 1)[0].rstrip().rstrip(',')} SELECT * FROM d2")
def relaxed_distances(spark, sf):
    edges = nation_edges(spark, sf)
    return topology.relax_distances(_nations(spark, sf), edges, 2, cut=lambda df: df)


@register(f"""WITH {TRIPS_SQL}, {EDGES_SQL}, k AS ({NEAREST_SQL.split(RECURSE)[1].strip()})
SELECT "from" AS node, "to" AS neighbor, 'direct_out' AS kind, 1::INT AS hops, length AS distance, NULL::INT AS rank FROM edges UNION ALL SELECT node, neighbor, 'network_nearest', NULL, distance, rank FROM k""".replace(f"{EDGES_SQL}, k", f"{EDGES_SQL}{RECURSE}, k"))
def node_neighbors(spark, sf):
    return topology.neighbors(_nations(spark, sf), nation_edges(spark, sf), 5)


@register(f"""WITH {TRIPS_SQL}, {EDGES_SQL}{RECURSE}, q AS (SELECT a.n_nationkey::BIGINT AS source, b.n_nationkey::BIGINT AS target, 40::DOUBLE AS budget FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 4) % 25)
SELECT q.source, target, budget, CASE WHEN distance <= budget THEN distance END AS cost FROM q LEFT JOIN d8 ON d8.source = q.source AND d8.node = target""")
def route_costs(spark, sf):
    n = _nations(spark, sf)
    asked = n.select(F.col("node").alias("source"), ((F.col("node") * 7 + 4) % 25).alias("target"), F.lit(40.0).alias("budget"))
    return topology.routes(asked, nation_edges(spark, sf)).drop("path")


VIA = """, q AS (SELECT a.n_nationkey::BIGINT AS source, (a.n_nationkey * 7 + 4) % 25 AS target FROM nation a),
v AS (SELECT t.source, t.node, arg_min(e."from", (s.distance, e."from")) AS p FROM d8 t JOIN edges e ON e."to" = t.node JOIN d8 s ON s.source = t.source AND s.node = e."from" AND s.distance + e.length = t.distance WHERE t.node <> t.source GROUP BY 1, 2),
w0 AS (SELECT source, target, target AS here, target::VARCHAR AS path FROM q)"""
STEP = "SELECT w.source, w.target, coalesce(p, here) AS here, CASE WHEN p IS NULL THEN path ELSE p || '>' || path END AS path"


@register(f"WITH {TRIPS_SQL}, {EDGES_SQL}{RECURSE}{VIA}, " + ", ".join(f"w{k + 1} AS ({STEP} FROM w{k} w LEFT JOIN v ON v.source = w.source AND v.node = w.here AND w.here <> w.source)" for k in range(8)) + " SELECT source, target, CASE WHEN here = source THEN path ELSE '' END AS path FROM w8")
def route_paths(spark, sf):
    """GR6: the nodes of each route, every node keeping the predecessor settled first."""
    n = _nations(spark, sf)
    asked = n.select(F.col("node").alias("source"), ((F.col("node") * 7 + 4) % 25).alias("target"), F.lit(1e9).alias("budget"))
    return topology.routes(asked, nation_edges(spark, sf)).select("source", "target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@register("""SELECT o_orderkey, CASE WHEN greatest(a, b) > 90 OR r > 4.5 THEN 'low' WHEN p <= 2 THEN 'medium' ELSE 'high' END AS confidence, least(18000, greatest(8 * l + 900, 700))::DOUBLE AS budget
FROM (SELECT o_orderkey, o_orderkey % 100 AS a, o_custkey % 95 AS b, (o_orderkey % 50) / 10 AS r, o_custkey % 5 AS p, o_totalprice - 1000 AS l FROM orders)""")
def route_confidence(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", topology.route_confidence(k % 100, c % 95, (k % 50) / 10, c % 5).alias("confidence"), topology.route_budget(F.col("o_totalprice") - 1000).alias("budget"))


def _points(spark, sf):
    e = table(spark, sf, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 1000
    return e.select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("x2"), at(3).alias("y2"))


@register("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings), q AS (FROM p), s AS (FROM p)
SELECT q.vec_id AS id, s.vec_id AS nearest, round(sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2)), 6) AS dist FROM q JOIN s ON q.vec_id <> s.vec_id AND sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2)) <= 20
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2)), s.vec_id) = 1""")
def cell_join_nearest(spark, sf):
    p = _points(spark, sf)
    out = spatial.nearest_points(p.select(F.col("vec_id").alias("id"), "x", "y"), p.select(F.col("vec_id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py")), 20.0, others=True)
    return out.withColumn("dist", F.round("dist", 6))


SEGMENTS = """p AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS x2, embedding[4]::DOUBLE * 1000 AS y2 FROM embeddings),
q AS (SELECT vec_id AS id, x, y, vec_id % 7 AS route FROM p), s AS (SELECT vec_id AS way, x AS ax, y AS ay, x + x2 / 4 AS bx, y + y2 / 4 AS byy, vec_id % 5 AS r FROM p),
c AS (SELECT *, CASE WHEN pow(bx - ax, 2) + pow(byy - ay, 2) <= 1e-12 THEN 0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (byy - ay)) / (pow(bx - ax, 2) + pow(byy - ay, 2)))) END AS t FROM q JOIN s ON id <> way AND abs(x - ax) < 400 AND abs(y - ay) < 400),
d AS (SELECT *, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (byy - ay), 2)) AS dist FROM c)"""


def _segments(spark, sf):
    p = _points(spark, sf)
    return p.select(F.col("vec_id").alias("way"), F.lit(0).alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("x2") / 4).alias("bx"), (F.col("y") + F.col("y2") / 4).alias("by"), F.array(F.col("vec_id") % 5).alias("routes"))


@register(f"WITH {SEGMENTS} SELECT id, way, round(dist, 6) AS dist, round(t, 6) AS t FROM d WHERE dist <= 60 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, way) = 1")
def nearest_segments(spark, sf):
    q = _points(spark, sf).select(F.col("vec_id").alias("id"), "x", "y")
    return spatial.nearest_segments(q, _segments(spark, sf), 60.0, others=True).select("id", "way", F.round("dist", 6).alias("dist"), F.round("t", 6).alias("t"))


@register(f"WITH {SEGMENTS} SELECT id, way, round(dist, 6) AS dist FROM d WHERE dist <= 60 AND (r = route OR route NOT IN (SELECT r FROM s)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, way) = 1")
def stations_on_roads(spark, sf):
    q = _points(spark, sf).select(F.col("vec_id").alias("id"), "x", "y", (F.col("vec_id") % 7).alias("route"))
    return spatial.stations_on_roads(q, _segments(spark, sf), 60.0, others=True).select("id", "way", F.round("dist", 6).alias("dist"))


@register("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS ax, embedding[2]::DOUBLE * 1000 AS ay, embedding[1]::DOUBLE * 1000 + embedding[3]::DOUBLE * 1000 / 4 AS bx, embedding[2]::DOUBLE * 1000 + embedding[4]::DOUBLE * 1000 / 4 AS byy FROM embeddings),
e AS (SELECT vec_id AS edge, sqrt(pow(bx - ax, 2) + pow(byy - ay, 2)) AS length, unnest(['start', 'mid', 'end']) AS spot, unnest([ax, (ax + bx) / 2, bx]) AS x, unnest([ay, (ay + byy) / 2, byy]) AS y FROM p),
c AS (SELECT edge, length, spot, vec_id AS way, x, y, ax, ay, bx, byy, CASE WHEN pow(bx - ax, 2) + pow(byy - ay, 2) <= 1e-12 THEN 0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (byy - ay)) / (pow(bx - ax, 2) + pow(byy - ay, 2)))) END AS t FROM e JOIN p ON vec_id <> edge),
d AS (SELECT edge, length, way, spot, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (byy - ay), 2)) AS dist, t * sqrt(pow(bx - ax, 2) + pow(byy - ay, 2)) AS along FROM c),
s AS (SELECT edge, length, way, max(dist) FILTER (spot = 'start') AS ds, max(dist) FILTER (spot = 'mid') AS dm, max(dist) FILTER (spot = 'end') AS de, max(along) FILTER (spot = 'start') AS s0, max(along) FILTER (spot = 'end') AS s1 FROM d GROUP BY 1, 2, 3 HAVING ds <= 90 AND de <= 90 AND dm <= 160)
SELECT edge, round(greatest(ds, de) + 0.45 * dm + 18 * least(abs(abs(s1 - s0) - length) / greatest(length, 1), 4), 5) AS score, way, round(s0, 5) AS from_at, round(s1, 5) AS to_at FROM s
QUALIFY row_number() OVER (PARTITION BY edge ORDER BY greatest(ds, de) + 0.45 * dm + 18 * least(abs(abs(s1 - s0) - length) / greatest(length, 1), 4), way) = 1""")
def match_edges(spark, sf):
    """Every point's segment as an edge, against the segments of all other points."""
    p = _points(spark, sf)
    edges = p.select(F.col("vec_id").alias("edge"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("x2") / 4).alias("bx"), (F.col("y") + F.col("y2") / 4).alias("by"))
    return spatial.match_edges(edges.withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), _segments(spark, sf).withColumn("at", F.lit(0.0)), others=True).withColumns({c: F.round(c, 5) for c in ("score", "from_at", "to_at")})


@register("""WITH p AS (SELECT l_orderkey AS way, l_quantity AS x, l_discount * 100 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount) AS pos FROM lineitem)
SELECT way, pos, round(sum(s) OVER (PARTITION BY way ORDER BY pos), 6) AS at FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS s FROM p WINDOW w AS (PARTITION BY way ORDER BY pos))""")
def way_chainage(spark, sf):
    """Every line of an order as a point of a way: numbered by line, then by its values, as a line may stand there twice."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("way"), "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return spatial.chainage(line, order=("l_linenumber", "x", "y"), number="pos").select("way", "pos", F.round("at", 6).alias("at"))


PLACES = "SELECT vec_id AS id, 116.4 + embedding[1]::DOUBLE * 90 AS lon, 39.9 + embedding[2]::DOUBLE * 45 AS lat FROM embeddings"


def _places(spark, sf):
    """Vectors as places, most within the rectangle of the shift and some outside."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (116.4 + at(0) * 90).alias("lon"), (39.9 + at(1) * 45).alias("lat"))


@register(f"""SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(112.0 + x, 6) AS half, round(hav, 4) AS hav FROM (SELECT id, radians(lon - 116.4) * cos(radians(39.9)) * 6371008.8 / 1e5 AS x, radians(lat - 39.9) * 6371008.8 / 1e5 AS y,
2 * 6371000.0 * asin(sqrt(pow(sin(radians(39.9 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(39.9)) * pow(sin(radians(116.4 - lon) / 2), 2))) AS hav FROM ({PLACES}))""")
def coord_transforms(spark, sf):
    x, y = S.project("lon", "lat", 116.4, 39.9)
    return _places(spark, sf).select("id", F.round(x / 1e5, 6).alias("x"), F.round(y / 1e5, 6).alias("y"), F.round(112.0 + x / 1e5, 6).alias("half"), F.round(S.haversine("lon", "lat", F.lit(116.4), F.lit(39.9)), 4).alias("hav"))


def _poly(k):
    return f"({k[0]!r} + {k[1]!r} * u + {k[2]!r} * v + {k[3]!r} * u * u + {k[4]!r} * u * v + {k[5]!r} * v * v)"


@register(f"""SELECT id, round({_poly(S.LON_COEFFICIENTS)}, 6) AS lon, round({_poly(S.LAT_COEFFICIENTS)}, 6) AS lat FROM (SELECT vec_id AS id, (514000 + embedding[1]::DOUBLE * 30000 - {S.LOCAL_ORIGIN[0]!r}) / {S.LOCAL_SCALE!r} AS u, (294000 + embedding[2]::DOUBLE * 30000 - {S.LOCAL_ORIGIN[1]!r}) / {S.LOCAL_SCALE!r} AS v FROM embeddings)""")
def local_to_wgs84(spark, sf):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 30000
    lon, lat = S.local_to_wgs84(514000 + at(0), 294000 + at(1))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_PI = repr(math.pi)
_RIP = f"(20 * sin(6 * x * {_PI}) + 20 * sin(2 * x * {_PI})) * 2 / 3"


@register(f"""WITH g AS (SELECT *, lon - 105 AS x, lat - 35 AS y FROM ({PLACES})),
d AS (SELECT *, -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + {_RIP} + (20 * sin(y * {_PI}) + 40 * sin(y / 3 * {_PI})) * 2 / 3 + (160 * sin(y / 12 * {_PI}) + 320 * sin(y / 30 * {_PI})) * 2 / 3 AS a,
300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + {_RIP} + (20 * sin(x * {_PI}) + 40 * sin(x / 3 * {_PI})) * 2 / 3 + (150 * sin(x / 12 * {_PI}) + 300 * sin(x / 30 * {_PI})) * 2 / 3 AS b, 1 - {S.GCJ_EE!r} * pow(sin(radians(lat)), 2) AS m,
lon BETWEEN {S.GCJ_LON[0]!r} AND {S.GCJ_LON[1]!r} AND lat BETWEEN {S.GCJ_LAT[0]!r} AND {S.GCJ_LAT[1]!r} AS inside FROM g)
SELECT id, round(CASE WHEN inside THEN lon + b * 180 / ({S.GCJ_A} / sqrt(m) * cos(radians(lat)) * {_PI}) ELSE lon END, 6) AS lon, round(CASE WHEN inside THEN lat + a * 180 / (({S.GCJ_A} * (1 - {S.GCJ_EE!r})) / (m * sqrt(m)) * {_PI}) ELSE lat END, 6) AS lat FROM d""")
def shifted_coordinates(spark, sf):
    lon, lat = S.wgs84_to_gcj02("lon", "lat")
    return _places(spark, sf).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@register("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, '[[' || (event_id % 90) || '.5,' || (event_id % 45) || '.25]]' AS geometry FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_geometry(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k int")).where(F.col("p.k").isNotNull())
    point = F.array(F.array(F.col("event_id") % 90 + 0.5, F.col("event_id") % 45 + 0.25))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(point).alias("geometry"))


@register("""SELECT n_nationkey AS id, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || n_nationkey || '.0,' || n_regionkey || '.5],[' || (n_nationkey + 1) || '.0,0.25]]},"properties":{"n_name":"' || n_name || '"}}' AS feature FROM nation""")
def geojson_features(spark, sf):
    n = table(spark, sf, "nation")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    line = F.array(at(F.col("n_nationkey"), F.col("n_regionkey") + 0.5), at(F.col("n_nationkey") + 1, F.lit(0.25)))
    return n.select(F.col("n_nationkey").alias("id"), sinks.feature(line, ["n_name"]).alias("feature"))


@register("""SELECT n_nationkey AS id, round(CASE WHEN d = 0 THEN 0 ELSE -r / d * 0.06 END, 6) + 0 AS ox, round(CASE WHEN d = 0 THEN 0 ELSE 3 / d * 0.06 END, 6) + 0 AS oy FROM (SELECT n_nationkey, n_regionkey AS r, sqrt(9 + n_regionkey * n_regionkey) AS d FROM nation)""")
def edge_offsets(spark, sf):
    n = table(spark, sf, "nation")
    x, y = S.aside(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.col("n_regionkey").cast("double"))
    return n.select(F.col("n_nationkey").alias("id"), (F.round(x, 6) + 0.0).alias("ox"), (F.round(y, 6) + 0.0).alias("oy"))


@register(f"""WITH {TRIPS_SQL}, {EDGES_SQL} SELECT edge, "from", "to" FROM edges WHERE "from" = 7 OR "to" = 7""")
def incident_edges(spark, sf):
    return topology.incident(nation_edges(spark, sf), 7).select("edge", "from", "to")


@register("""SELECT user_id AS edge, (max(event_id) % 90 + 0.5)::DOUBLE AS x FROM events WHERE event_id % 3 <> 0 GROUP BY 1""")
def matched_geometry(spark, sf):
    point = lambda k: F.array(F.col("event_id") % 90 + F.lit(k).cast("double"), F.lit(1.0))
    line = F.when(F.col("event_id") % 3 == 0, F.array(point(0.5))).otherwise(F.array(point(0.5), point(1.5)))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("edge"), "event_id", F.to_json(line).alias("geometry"))
    return tables.matched_geometry(rows, "edge", "geometry", "event_id").select("edge", F.get("points", F.lit(0))["x"].alias("x"))


@register()
def routed_edges(spark, sf):
    """Suppliers as model edges, routed over the nations' network: from beside their nation to another one."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("pid"), (F.col("n_nationkey") * 100.0).alias("px"), (F.col("n_regionkey") * 100.0).alias("py"))
    graph = nation_edges(spark, sf).select("from", "to", (F.col("length") * 100).alias("length"), F.col("edge").alias("way"), F.when(F.col("edge") % 3 == 0, "primary").otherwise("service").alias("highway"))
    ends = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("edge"), F.col("s_nationkey").cast("long").alias("a"), ((F.col("s_nationkey") + F.col("s_suppkey")) % 25).cast("long").alias("b"))
    at = lambda k: n.select(F.col("pid").alias(k), F.col("px").alias(f"{k}x"), F.col("py").alias(f"{k}y"))
    asked = ends.join(at("a"), "a").join(at("b"), "b").withColumn("ax", F.col("ax") + 9.0).withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    out = topology.route_edges(asked.select("edge", "ax", "ay", "bx", "by", "length"), n, graph)
    return out.join(topology.path_ways(out, graph, "highway"), "edge", "left")
