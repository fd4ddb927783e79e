"""Performance features, network metrics, selections, payloads and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import clean, evaluate, frames, panel, simulate, spatial, topology
from roadloom.operators import selection as L
from roadloom.operators.scans import Scan
from roadloom.plans.catalogue import register
from roadloom.plans.roles import EDGES_SQL, STEPS_SQL, TRIPS_SQL, event_moves, nation_edges, paths, table, trips

MOE_SQL = f"""{TRIPS_SQL}, m AS (SELECT "from", "to", floor(l_quantity * 20 / 5)::INT AS time_bin, l_quantity AS vol, l_extendedprice AS cum, CASE WHEN l_quantity <> 7 THEN l_extendedprice / l_quantity END AS speed, day(l_shipdate) AS day_no, l_shipdate FROM trips WHERE "from" <> 3),
g AS (SELECT time_bin, "from"::BIGINT AS from_node_id, "to"::BIGINT AS to_node_id, sum(vol) AS vol, round(avg(speed) + 1e-7, 4) AS speed, max(cum) AS cum, arg_min(day_no, l_shipdate)::DOUBLE AS day_no FROM m GROUP BY 1, 2, 3)"""


def _moe(spark, sf):
    t = trips(spark, sf)
    rows = t.select(
        F.when(F.col("from") != 3, F.col("from").cast("string")).alias("from_node_id"), F.col("to").alias("to_node_id"), (F.col("l_quantity") * 20).cast("string").alias("timestamp_in_min"), F.col("l_quantity").alias("link_in_volume_number_of_veh"),
        F.when(F.col("l_quantity") != 7, F.col("l_extendedprice") / F.col("l_quantity")).alias("speed"), F.col("l_extendedprice").alias("cumulative_arrival_count"), F.dayofmonth("l_shipdate").alias("day_no"), "l_shipdate",
    )
    return panel.moe_features(rows, F.col("l_shipdate"))


@register(f"""WITH {MOE_SQL} SELECT time_bin, time_bin * 5 AS start_min, time_bin * 5 + 5 AS end_min, from_node_id, to_node_id, from_node_id || '->' || to_node_id AS edge_id, vol AS link_in_volume_number_of_veh, speed, cum AS cumulative_arrival_count, day_no FROM g""")
def moe_features(spark, sf):
    return _moe(spark, sf).withColumn("speed", F.round(F.col("speed") + 1e-7, 4))


@register(f"""WITH {MOE_SQL}, f AS (SELECT floor(l_quantity * 4)::INT AS time_bin, "from", "to", count(*)::DOUBLE AS x FROM trips WHERE l_quantity <> 9 GROUP BY 1, 2, 3)
SELECT g.time_bin, from_node_id, to_node_id, from_node_id || '->' || to_node_id AS edge_id, vol AS link_in_volume_number_of_veh, coalesce(x, 0) AS x, coalesce(x, 0) - vol AS difference, abs(coalesce(x, 0) - vol) AS abs_difference
FROM g LEFT JOIN f ON f.time_bin = g.time_bin AND f."from" = from_node_id AND f."to" = to_node_id""")
def moe_check(spark, sf):
    flow = panel.edge_flow(trips(spark, sf).where("l_quantity <> 9").withColumn("time_bin", F.floor(F.col("l_quantity") * 4).cast("int")))
    return panel.moe_check(_moe(spark, sf), flow)


METRICS_SQL = f"""{TRIPS_SQL}, {EDGES_SQL}, f AS (SELECT time_bin, "from", "to", count(*)::DOUBLE AS x FROM trips GROUP BY 1, 2, 3),
e AS (SELECT f.*, edge, length, CASE WHEN edge % 3 <> 0 THEN edge % 7 + 1 END AS capacity, x / length AS density FROM f JOIN edges ON edges."from" = f."from" AND edges."to" = f."to")"""


def _enriched(spark, sf):
    edges = nation_edges(spark, sf)
    links = edges.select(F.col("edge").alias("edge_index"), F.col("from").alias("from_node_id"), F.col("to").alias("to_node_id"), "length")
    capacity = edges.where("edge % 3 <> 0").select(F.col("edge").alias("edge_index"), (F.col("edge") % 7 + 1).alias("capacity"))
    return panel.enriched(panel.edge_flow(trips(spark, sf)), links, capacity).withColumn("density", F.col("x") / F.col("length"))


@register(f"WITH {METRICS_SQL} SELECT time_bin, edge AS edge_index, x, length, capacity, round(density, 6) AS density FROM e")
def enriched_flow(spark, sf):
    return _enriched(spark, sf).select("time_bin", "edge_index", "x", "length", "capacity", F.round("density", 6).alias("density"))


@register(f"""WITH {METRICS_SQL} SELECT time_bin, count(*) AS active_edges, round_even(count(*) / 900, 4) AS active_share, count(*) FILTER (density >= 1.5) AS congested_edges, round_even(count(*) FILTER (density >= 1.5) / 900, 4) AS congested_share,
sum(x) AS total, round(avg(density), 6) AS mean, round(quantile_cont(density, 0.95), 6) AS p95, round(max(density), 6) AS max FROM e GROUP BY 1""")
def network_metrics(spark, sf):
    out = panel.network_metrics(_enriched(spark, sf), "density", 1.5, 900)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p95", "max")})


@register(f"""WITH {TRIPS_SQL}, s AS (SELECT time_bin, "from" AS node, 0 AS i, 1 AS o FROM trips UNION ALL SELECT time_bin, "to", 1, 0 FROM trips), g AS (SELECT time_bin, node, sum(i)::DOUBLE AS i, sum(o)::DOUBLE AS o FROM s GROUP BY 1, 2)
SELECT b.t::INT AS time_bin, (b.t * 5)::INT AS start_min, (b.t * 5 + 5)::INT AS end_min, n_nationkey AS node, coalesce(i, 0) AS in_flow, coalesce(o, 0) AS out_flow, coalesce(o, 0) - coalesce(i, 0) AS net_flow
FROM nation CROSS JOIN range(15) b(t) LEFT JOIN g ON g.time_bin = b.t AND g.node = n_nationkey""")
def node_panel(spark, sf):
    return panel.dense_nodes(panel.node_moves(trips(spark, sf)), table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), 15)


@register(f"""WITH {STEPS_SQL}, k AS (SELECT *, ("from" + "to") % 4 = 0 AS known, CASE WHEN step <> 4 THEN leave END AS l2 FROM segments),
b AS (SELECT *, CASE WHEN known AND l2 IS NOT NULL THEN CASE WHEN enter > 1440 OR l2 < enter THEN 0 WHEN least(l2, 1440) - enter <= 1e-9 THEN CASE WHEN enter >= 1440 THEN 0 ELSE 1 END ELSE floor((least(l2, 1440) - 1e-9) / 5) - floor(enter / 5) + 1 END END AS bins FROM k),
p AS (SELECT path, count(*) AS n FROM ordered GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS total_agents, (SELECT count(*) FROM p WHERE n >= 2) AS used_agents, (SELECT count(*) FROM p WHERE n < 2) AS bad_agents, count(*) AS total_traversals, count(*) FILTER (known) AS used_traversals, count(*) FILTER (NOT known) AS missing_traversals,
count(*) FILTER (bins > 0) AS counted_segments, count(*) FILTER (bins = 0) AS skipped_segments, count(*) FILTER (known AND l2 IS NULL) AS bad_segments, sum(bins)::BIGINT AS bin_updates, max(l2) AS max_time FROM b""")
def run_totals(spark, sf):
    p = paths(spark, sf)
    n = spark.range(25).select(F.col("id").alias("from"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("to")).where((F.col("from") + F.col("to")) % 4 == 0)
    segments = panel.path_segments(p).withColumn("leave", F.when(F.col("step") != 4, F.col("leave")))
    return panel.run_summary(p, segments, n)


@register("""SELECT o_orderkey, o_custkey FROM orders WHERE lower(trim(o_orderstatus)) = 'f' AND o_custkey % 5 <> 0 AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def completed_agents(spark, sf):
    o = table(spark, sf, "orders").withColumn("complete_flag", F.when(F.col("o_orderstatus") == "F", F.lit(" C ")).otherwise(F.col("o_orderstatus"))).withColumn("k", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    return clean.without(clean.completed(clean.drop_null_keys(o, ["k"])), "o_orderpriority", ["1-URGENT", "5-LOW"]).select("o_orderkey", "o_custkey")


@register("""SELECT id, (row_number() OVER (ORDER BY n IS NULL, n, id) - 1)::BIGINT AS place FROM (SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE '' END || (s_suppkey * 13 % 1009) || '_' || s_suppkey AS raw, CASE WHEN s_suppkey % 7 = 0 THEN 'x' || s_suppkey ELSE s_suppkey::VARCHAR END AS id, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey END AS n FROM supplier)""")
def numeric_order(spark, sf):
    k = F.col("s_suppkey")
    return L.in_number_order(table(spark, sf, "supplier").select(F.when(k % 7 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("id")), "id")


@register("""SELECT p_partkey, p_retailprice, p_size = 7 AS chosen FROM part ORDER BY p_size = 7 DESC, p_retailprice DESC, p_partkey LIMIT 120""")
def background_segments(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return L.background(p, p.where("p_size = 7"), "p_partkey", "p_retailprice", 120).drop("p_size")


@register("""SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1 ORDER BY top DESC, l_partkey LIMIT 8""")
def top_segments(spark, sf):
    return L.largest(table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("top")), "top", "l_partkey")


@register("""WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS position FROM supplier WHERE s_nationkey < 12) SELECT position, count(*) AS n, sum(l_quantity) AS total FROM lineitem JOIN p ON s_suppkey = l_suppkey GROUP BY 1""")
def positioned_flow(spark, sf):
    members = table(spark, sf, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    rows = L.at_position(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), members, "l_suppkey", ["s_acctbal", "l_suppkey"])
    return rows.groupBy("position").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@register("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)""")
def visible_roads(spark, sf):
    stations = table(spark, sf, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("n_nationkey"))
    return L.visible(table(spark, sf, "nation"), stations, "n_nationkey").select("n_nationkey", "n_name")


@register("""SELECT n_nationkey, n_nationkey % 3 = 0 AS matched, CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 2 END AS points, CASE WHEN n_nationkey % 3 = 0 THEN 50 ELSE n_nationkey END::DOUBLE AS x FROM nation""")
def links_geometry(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").alias("ax"), F.lit(1).alias("ay"), F.lit(2).alias("bx"), F.lit(3).alias("by"))
    at = lambda x: F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"))
    out = L.with_geometry(n, n.where("n_nationkey % 3 = 0").select("n_nationkey", F.array(at(50), at(51), at(52)).alias("points")), "n_nationkey")
    return out.select("n_nationkey", "matched", F.size("points").alias("points"), F.get("points", F.lit(0))["x"].alias("x"))


@register("""SELECT ts::DATE AS day, count(*) AS n, round(sum(CASE WHEN day(ts) % 4 <> 0 THEN value END), 4) AS total FROM events GROUP BY 1""")
def day_totals(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.when(F.dayofmonth("ts") % 4 != 0, F.col("value")))
    return L.day_totals(e, "ts", "v").withColumn("total", F.round("total", 4))


@register("""SELECT p_partkey, CASE p_size WHEN 0 THEN 'unknown' WHEN 1 THEN '5 km/h' ELSE CASE WHEN p_size <= 11 THEN (p_size * 10) || ' km/h' ELSE p_size::VARCHAR END END AS label, CASE left(p_type, 1) WHEN 'E' THEN 1 WHEN 'S' THEN -1 ELSE 0 END AS side FROM part""")
def labels_and_sides(spark, sf):
    return table(spark, sf, "part").select("p_partkey", L.speed_label("p_size").alias("label"), L.side("p_type").alias("side"))


@register("""WITH n AS (SELECT n_nationkey::BIGINT AS id, n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation), m AS (FROM n) SELECT n.id AS a, m.id AS b, abs(n.x - m.x) + abs(n.y - m.y) AS distance FROM n, m""")
def grid_distances(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    return L.node_distance(n)


@register("""SELECT event_id, round(coalesce(CASE WHEN event_id % 2 = 0 THEN value END, exp(greatest(-8, least(8, value / 10 - 4)))), 6) AS intensity FROM events""")
def model_intensity(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 10 - 4).alias("eta"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("kept"))
    return L.mean_intensity(e, "eta", "kept").select("event_id", F.round("intensity", 6).alias("intensity"))


@register("""WITH f AS (SELECT day(ts)::INT AS h, user_id AS edge, avg(value) AS mean, min(value) AS lower, max(value) AS upper, count(*) AS y FROM events GROUP BY 1, 2), m AS (SELECT unnest(['wide', 'narrow']) AS method, unnest([1.0, 0.5]) AS s)
SELECT h, h / 24.0::DOUBLE AS forecast_day, method, y AS observed, round(y / 2, 6) AS truth, round(mean, 6) AS mean, round(lower * s, 6) AS lower, round(upper * s, 6) AS upper FROM f, m WHERE edge = 7""")
def edge_forecast(spark, sf):
    f = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("h"), F.col("user_id").alias("edge")).agg(F.avg("value").alias("mean"), F.min("value").alias("lower"), F.max("value").alias("upper"), F.count("*").alias("y"))
    truth = f.select("h", "edge", "y", (F.col("y") / 2).alias("rate"))
    half = f.withColumns({"lower": F.col("lower") * 0.5, "upper": F.col("upper") * 0.5})
    out = L.bound({k: L.one_edge(x, truth, 7, 24, k).drop("method") for k, x in (("wide", f), ("narrow", half))})
    return out.withColumns({c: F.round(c, 6) for c in ("truth", "mean", "lower", "upper")})


@register("""WITH f AS (SELECT hour(ts)::INT AS time_bin, user_id, count(*) AS x FROM events GROUP BY 1, 2) SELECT time_bin, '[' || string_agg('[' || user_id || ',' || CASE WHEN user_id % 2 = 0 THEN x::VARCHAR ELSE x || '.5' END || ']', ',' ORDER BY user_id) || ']' AS flows FROM f GROUP BY 1""")
def flow_payload(spark, sf):
    f = table(spark, sf, "events").groupBy(F.hour("ts").alias("time_bin"), "user_id").agg((F.count("*") + F.when(F.col("user_id") % 2 == 0, 0.0).otherwise(0.5)).alias("x"))
    return L.flow_payload(f, "user_id", "x")


@register("""WITH h AS (SELECT day(ts)::INT AS f, user_id AS id, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2), b AS (SELECT f, row_number() OVER (ORDER BY f) AS r FROM (SELECT DISTINCT f FROM h)),
c AS (SELECT id, h.f, r, r - row_number() OVER (PARTITION BY id ORDER BY r) AS g FROM h JOIN b ON b.f = h.f WHERE v >= 3), s AS (SELECT f, id, row_number() OVER (PARTITION BY id, g ORDER BY r) AS n FROM c), d AS (SELECT f, string_agg('[' || id || ',' || n || ']', ',' ORDER BY id) AS d FROM s GROUP BY 1)
SELECT h.f AS frame, '{"mean":' || round_even(avg(v), 4)::DOUBLE || ',"max":' || max(v) || ',"congested":' || count(*) FILTER (v >= 3) || ',"hottest":' || arg_min(id, (-v, id)) || ',"duration":[' || coalesce(any_value(d.d), '') || ']}' AS payload FROM h LEFT JOIN d ON d.f = h.f GROUP BY h.f""")
def congestion_payload(spark, sf):
    h = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("frame"), F.col("user_id").alias("id")).agg(F.count("*").cast("double").alias("v"))
    return frames.congestion_payload(h, "frame", "id", "v", 3.0)


@register("""SELECT count(l_quantity) AS count, round(avg(l_extendedprice) + 1e-7, 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, max(l_extendedprice) AS max FROM lineitem""")
def describe_report(spark, sf):
    out = L.describe(table(spark, sf, "lineitem"), "l_extendedprice")
    return out.withColumns({"mean": F.round(F.col("mean") + 1e-7, 4), **{c: F.round(c, 4) for c in ("std", "p50", "p75", "p90", "p95", "p99")}})


@register("""SELECT unnest([0, 1, 2, 3])::INT AS pos, unnest(['run', 'metric', 'edges', 'output map']) AS name, unnest(['economy anodized_2', 'density', n::VARCHAR, 'map.html']) AS value FROM (SELECT count(*) AS n FROM part)""")
def run_manifest(spark, sf):
    """SK10: the manifest of a run over the parts, whose name some part has already."""
    p = table(spark, sf, "part")
    taken = [r.name for r in p.select(F.lower(F.regexp_extract("p_type", r"^\\S+ \\S+", 0)).alias("name")).distinct().collect()]  # kinds alone
    return L.manifest(spark, L.next_name("economy anodized", [*taken, "economy anodized"]), {"map": "map.html", "film": None}, {"metric": "density", "edges": p.count()})


@register("""SELECT event_id, round(lon * cos(radians(40.0)) * 111320, 4) AS x, round(lat * 110540, 4) AS y, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE round_even(v, 3)::DOUBLE::VARCHAR END AS text, CASE WHEN v > 0 THEN round(ln(2 / pi()) - ln(2.5) - ln(1 + pow(v / 2.5, 2)), 6) ELSE '-inf'::DOUBLE END AS prior, (hour(ts) * 12 + minute(ts) // 5)::INT AS slot
FROM (SELECT *, event_id % 90 + 0.5 AS lon, event_id % 45 + 0.25 AS lat, CASE WHEN event_id % 3 = 0 THEN event_id % 50 ELSE (event_id % 50) / 8 END AS v FROM events)""")
def small_functions(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").withColumns({"lon": k % 90 + 0.5, "lat": k % 45 + 0.25, "v": F.when(k % 3 == 0, (k % 50).cast("double")).otherwise((k % 50) / 8)})
    x, y = S.planar("lon", "lat", 40.0)
    return e.select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), S.compact("v").alias("text"), F.round(S.half_cauchy_logpdf("v", F.lit(2.5)), 6).alias("prior"), S.slot_of(F.date_format("ts", "HH:mm")).alias("slot"))


@register("""WITH p AS (SELECT l_orderkey AS id, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING)::DOUBLE AS d FROM lineitem), w AS (SELECT id, max(d) AS z, list(d) AS ats FROM p GROUP BY 1)
SELECT id, greatest(z / 2 - 20, 0) AS first_x, least(z / 2 + 20, z) AS last_x, (2 + len(list_filter(ats, lambda x: x > greatest(z / 2 - 20, 0) + 1e-9 AND x < least(z / 2 + 20, z) - 1e-9)))::INT AS points, z * 0.75 AS back_x FROM w""")
def sublines(spark, sf):
    """orders as straight ways with a point a line; the part around their middle, and a part backwards."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity")
    pts = Scan(line, ["id"], ["l_linenumber", "l_quantity"]).sum("at", F.col("l_quantity").cast("double")).done()
    at = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"), x.alias("at"))
    ways = pts.groupBy("id").agg(F.array_sort(F.collect_list(at(F.col("at")))).alias("p"), F.max("at").alias("z"))
    rows = ways.withColumn("p", F.concat(F.array(at(F.lit(0.0))), "p"))
    part, back = spatial.around_match("p", F.col("z") / 2, 20.0), spatial.subline("p", F.col("z") * 0.75, F.col("z") * 0.25)
    return rows.select("id", part[0]["x"].alias("first_x"), F.element_at(part, -1)["x"].alias("last_x"), F.size(part).alias("points"), back[0]["x"].alias("back_x"))


@register("""SELECT i // 48 + 1 AS day, count(*) AS n, count(*) FILTER ((i % 48) // 2 IN (7, 8, 9)) AS morning, count(*) FILTER ((i % 48) // 2 IN (17, 18, 19)) AS evening, bool_or((i // 48) % 7 + 1 IN (6, 7)) AS weekend, sum(1 + ((i % 48) // 2 IN (7, 8, 9))::INT)::DOUBLE AS design
FROM (SELECT DISTINCT floor((epoch(ts) - 1704067200) / 1800)::BIGINT AS i FROM events) GROUP BY 1""")
def time_flags(spark, sf):
    """F32, R7, G2: the half hours that have events, counted from the first of 2024, with their flags."""
    slots = table(spark, sf, "events").select(F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 1800).alias("id")).distinct()
    index = simulate.flagged(slots)
    f = simulate.design(index).select("t", (F.get("f", F.lit(0)) + F.get("f", F.lit(1))).alias("d"))
    out = index.join(f, "t").groupBy("day").agg(F.count("*").alias("n"), F.count_if("morning").alias("morning"), F.count_if("evening").alias("evening"), F.bool_or("weekend").alias("weekend"), F.sum("d").alias("design"))
    return out.withColumn("day", F.col("day").cast("bigint"))


@register("""WITH p AS (SELECT n_regionkey AS way, n_nationkey AS pos, (n_nationkey * 7 % 11)::DOUBLE AS lon, n_regionkey::DOUBLE AS lat FROM nation), s AS (SELECT way, lon AS a, lat, lead(lon) OVER (PARTITION BY way ORDER BY pos) AS b FROM p),
e AS (SELECT way, abs(a - b) AS length FROM s WHERE b IS NOT NULL AND a <> b) SELECT way, 2 * count(*) AS edges, 2 * sum(length) AS length FROM e GROUP BY 1""")
def way_network(spark, sf):
    n = table(spark, sf, "nation")
    lon = (F.col("n_nationkey") * 7 % 11).cast("double")
    p = n.select(F.col("n_regionkey").alias("way"), F.col("n_nationkey").alias("pos"), lon.alias("lon"), F.col("n_regionkey").cast("double").alias("lat"), lon.alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    return topology.way_graph(p).groupBy("way").agg(F.count("*").alias("edges"), F.sum("length").alias("length"))


@register("""SELECT user_id, count(*) AS n, max(iter) AS last FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS iter FROM events) WHERE iter > 5 AND (iter - 5) % 3 = 0 GROUP BY 1""")
def thinned_draws(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "events").withColumn("iter", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return evaluate.kept(rows, 5, 3).groupBy("user_id").agg(F.count("*").alias("n"), F.max("iter").alias("last"))


@register()
def sampled_edges(spark, sf):
    """Six users for plots, by a seeded hash."""
    return L.sample_keys(event_moves(spark, sf), "from")
