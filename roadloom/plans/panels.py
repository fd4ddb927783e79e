"""Panels, paths, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import clean, panel
from roadloom.plans.catalogue import register
from roadloom.plans.roles import EDGES_SQL, STEPS_SQL, TRIPS_SQL, event_moves, nation_edges, paths, table, trips
from roadloom.sources import sinks

FLOW = """f AS (SELECT ((extract(hour FROM ts) * 60 + extract(minute FROM ts)) // 30)::INT AS time_bin, user_id AS "from", event_type AS "to", count(*)::DOUBLE AS x FROM events GROUP BY ALL)"""


@register(f"""WITH {FLOW}, e AS (SELECT DISTINCT user_id AS "from", event_type AS "to" FROM events)
SELECT b.time_bin::INT AS time_bin, e."from", e."to", coalesce(f.x, 0)::DOUBLE AS x FROM e CROSS JOIN range(48) b(time_bin)
LEFT JOIN f ON f.time_bin = b.time_bin AND f."from" = e."from" AND f."to" = e."to" """)
def edge_time_panel(spark, sf):
    moves = event_moves(spark, sf)
    return panel.dense(panel.edge_flow(moves), moves.select("from", "to"), 48)


@register("""SELECT ((extract(hour FROM ts) * 60 + extract(minute FROM ts)) // 30)::INT AS time_bin, user_id AS "from", event_type AS "to",
round(sum(CASE WHEN value > 100 THEN value ELSE 1 END), 4) AS x FROM events GROUP BY ALL""")
def weighted_edge_flow(spark, sf):
    moves = event_moves(spark, sf).withColumn("w", F.when(F.col("value") > 100, F.col("value")))
    return panel.edge_flow(moves, weight="w").withColumn("x", F.round("x", 4))


@register(f"""WITH {TRIPS_SQL}, f AS (SELECT time_bin, "from", "to", count(*)::DOUBLE AS x FROM trips GROUP BY ALL),
s AS (SELECT time_bin, "from" AS node, 0::DOUBLE AS i, x AS o FROM f UNION ALL SELECT time_bin, "to", x, 0 FROM f)
SELECT time_bin, node, sum(i) AS in_flow, sum(o) AS out_flow, sum(o) - sum(i) AS net_flow FROM s GROUP BY ALL""")
def node_flow(spark, sf):
    return panel.node_moves(trips(spark, sf))


@register(f"""WITH {FLOW} SELECT time_bin, {', '.join(f"coalesce(sum(x) FILTER (\"to\" = '{k}'), 0)::DOUBLE AS {k}" for k in ("click", "error", "purchase", "signup", "view"))}
FROM f GROUP BY time_bin""")
def edge_panel_wide(spark, sf):
    flow = panel.edge_flow(event_moves(spark, sf))
    return panel.wide(flow, "time_bin", "to", "x", ["click", "error", "purchase", "signup", "view"])


@register(f"""WITH {FLOW} SELECT b.time_bin::INT AS time_bin, k.name, coalesce(sum(f.x), 0)::DOUBLE AS value
FROM (SELECT DISTINCT time_bin FROM f) b CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) k(name)
LEFT JOIN f ON f.time_bin = b.time_bin AND f."to" = k.name GROUP BY ALL""")
def panel_unpivot(spark, sf):
    return panel.long(edge_panel_wide(spark, sf), ["time_bin"], ["click", "error", "purchase", "signup", "view"])


@register(f"WITH {STEPS_SQL} SELECT path, step, \"from\", \"to\", enter, leave FROM segments")
def path_segments(spark, sf):
    return panel.path_segments(paths(spark, sf))


def _segments(spark, sf):
    return panel.segment_status(panel.path_segments(paths(spark, sf)).withColumn("leave", F.when(F.col("step") == 4, None).otherwise(F.col("leave"))), nation_edges(spark, sf))


@register(f"""WITH {TRIPS_SQL}, {EDGES_SQL}, {STEPS_SQL},
s AS (SELECT *, CASE WHEN step = 4 THEN 'bad' WHEN leave < enter THEN 'skipped' WHEN NOT EXISTS (FROM edges e WHERE e."from" = segments."from" AND e."to" = segments."to") THEN 'missing' ELSE 'ok' END AS status FROM segments)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def segment_status_counts(spark, sf):
    return _segments(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@register(f"""WITH {TRIPS_SQL}, {EDGES_SQL}, {STEPS_SQL},
s AS (SELECT *, CASE WHEN step = 4 THEN 'bad' WHEN NOT EXISTS (FROM edges e WHERE e."from" = segments."from" AND e."to" = segments."to") THEN 'missing' ELSE 'ok' END AS status FROM segments)
SELECT count(*) AS segments, count(*) FILTER (status = 'ok') AS used, count(*) FILTER (status = 'bad') AS bad, 0::BIGINT AS skipped, count(*) FILTER (status = 'missing') AS missing,
max(leave) FILTER (step <> 4) AS max_time FROM s""")
def run_counters(spark, sf):
    return panel.counters(_segments(spark, sf))


@register(f"""WITH {TRIPS_SQL}, {EDGES_SQL}, {STEPS_SQL}
SELECT "from", "to", count(*) AS count FROM segments WHERE NOT EXISTS (FROM edges e WHERE e."from" = segments."from" AND e."to" = segments."to") GROUP BY ALL""")
def missing_edges(spark, sf):
    return panel.missing_edges(panel.path_segments(paths(spark, sf)), nation_edges(spark, sf))


@register(f"""WITH {TRIPS_SQL}, {EDGES_SQL}, {STEPS_SQL}, m AS (SELECT "from", "to", count(*) AS count FROM segments WHERE NOT EXISTS (FROM edges e WHERE e."from" = segments."from" AND e."to" = segments."to") GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY count DESC, "from", "to") AS rank FROM m""")
def missing_edges_ranked(spark, sf):
    """L1, L2: missing edges by how often they are passed, as ranks, which a table keeps and an order doesn't."""
    return panel.ranked(missing_edges(spark, sf), "count", ["from", "to"])


@register(f"""WITH {STEPS_SQL}, c AS (SELECT "from", "to", enter AS a, least(leave, 1440) AS b FROM segments WHERE leave >= enter AND enter <= 1440),
d AS (SELECT "from", "to", unnest(CASE WHEN b - a <= 1e-9 THEN CASE WHEN a >= 1440 THEN [] ELSE [floor(a / 5)::BIGINT] END ELSE range(floor(a / 5)::BIGINT, floor((b - 1e-9) / 5)::BIGINT + 1) END) AS k FROM c)
SELECT k::INT AS time_bin, "from", "to", count(*)::DOUBLE AS x FROM d GROUP BY ALL""")
def occupancy_bins(spark, sf):
    return panel.occupancy(panel.path_segments(paths(spark, sf)))


@register(f"""WITH {TRIPS_SQL} SELECT (CASE WHEN l_quantity * 40 >= 0 AND l_quantity * 40 < 1440 THEN floor(l_quantity * 8) END)::INT AS time_bin, count(*) AS n FROM trips GROUP BY ALL""")
def entry_bins(spark, sf):
    return trips(spark, sf).groupBy(S.entry_bin(F.col("l_quantity") * 40).alias("time_bin")).agg(F.count("*").alias("n"))


@register("""SELECT l_orderkey, list_sum(v) AS total, len(v)::INT AS n FROM (SELECT l_orderkey, [try_cast(trim(x) AS DOUBLE) FOR x IN string_split(s, ';') IF try_cast(trim(x) AS DOUBLE) IS NOT NULL] AS v
FROM (SELECT l_orderkey, string_agg(CASE WHEN l_linenumber = 3 THEN 'x' ELSE l_suppkey || '.0' END, '; ' ORDER BY l_linenumber, l_suppkey) AS s FROM lineitem GROUP BY 1))""")
def semicolon_parse(spark, sf):
    token = F.when(F.col("l_linenumber") == 3, "x").otherwise(F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", token.alias("v")))), lambda s: s["v"]), "; ")
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(text.alias("s")).withColumn("v", S.split_numbers("s"))
    return rows.select("l_orderkey", F.when(F.size("v") > 0, F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("v").alias("n"))


def _links(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    direction = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return o.select(F.col("o_orderkey").alias("link_id"), F.col("c_nationkey").cast("bigint").alias("from_node_id"), (F.col("o_orderkey") % 25).alias("to_node_id"), direction.alias("direction"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("length"), F.lit(1.0).alias("lanes"), F.col("o_totalprice").alias("capacity"), F.col("o_totalprice").alias("speed"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("name"),
                    F.when(F.col("o_orderkey") % 4 != 1, F.col("o_totalprice") / 2).alias("jam_density"), (F.col("o_orderkey") % 40).alias("wave_speed"), F.when(F.col("o_orderkey") % 5 > 1, F.col("o_orderkey") % 9).alias("link_type"),
                    F.when(F.col("o_orderkey") % 5 > 2, F.col("o_orderstatus")).alias("link_type_name"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("L"), F.col("o_orderkey"))).alias("geometry"), F.when(F.col("o_orderkey") % 8 < 3, F.concat(F.lit("O"), F.col("o_orderkey"))).alias("original_geometry"),
                    F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("k"), F.col("o_orderkey"))).alias("link_key"))


def _nodes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("node_id"), (F.col("n_nationkey") * 3000.0).alias("x"), (F.col("n_regionkey") * 4000.0).alias("y"))


LINKS_SQL = """l AS (SELECT o_orderkey AS link_id, c_nationkey::BIGINT AS u, o_orderkey % 25 AS v, CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'P' THEN 2 ELSE 1 END AS d,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS length, o_totalprice AS capacity, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS name,
    CASE WHEN o_orderkey % 4 <> 1 THEN o_totalprice / 2 END AS jam, o_orderkey % 40 AS wave, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey % 9 END AS kind, CASE WHEN o_orderkey % 5 > 2 THEN o_orderstatus END AS kind_name,
    CASE WHEN o_orderkey % 2 = 0 THEN 'L' || o_orderkey END AS geom, CASE WHEN o_orderkey % 8 < 3 THEN 'O' || o_orderkey END AS ogeom, CASE WHEN o_orderkey % 6 <> 0 THEN 'k' || o_orderkey END AS key FROM orders JOIN customer ON c_custkey = o_custkey),
ways AS (SELECT u AS f, v AS t, 'forward' AS flag, l.* FROM l WHERE d <> -1 UNION ALL SELECT v, u, 'reverse', l.* FROM l WHERE d IN (-1, 0, 2)),
dir AS (SELECT w.*, CASE WHEN w.length > 0 THEN w.length ELSE sqrt(pow((a.n_nationkey - b.n_nationkey) * 3000.0, 2) + pow((a.n_regionkey - b.n_regionkey) * 4000.0, 2)) / 1000 END AS len
  FROM ways w LEFT JOIN nation a ON a.n_nationkey = f LEFT JOIN nation b ON b.n_nationkey = t)"""


@register(f"WITH {LINKS_SQL} SELECT link_id, f AS from_node_id, t AS to_node_id, flag AS direction_flag, round(len, 6) AS length FROM dir")
def directed_expansion(spark, sf):
    return clean.direct(_links(spark, sf), _nodes(spark, sf)).select("link_id", "from_node_id", "to_node_id", "direction_flag", F.round("length", 6).alias("length"))


@register(f"""WITH {LINKS_SQL}, g AS (SELECT f AS from_node_id, t AS to_node_id, round(min(len), 6) AS length, count(*)::DOUBLE AS lanes, round(sum(capacity), 2) AS capacity, round(avg(capacity) + 1e-7, 4) AS speed,
  round(avg(jam) + 1e-7, 4) AS jam_density, round(avg(wave) + 1e-9, 6) AS wave_speed, arg_min(kind, link_id) FILTER (kind IS NOT NULL) AS link_type, arg_min(kind_name, link_id) FILTER (kind_name IS NOT NULL) AS link_type_name,
  arg_min(geom, link_id) FILTER (geom IS NOT NULL) AS geometry, arg_min(ogeom, link_id) FILTER (ogeom IS NOT NULL) AS original_geometry, md5(string_agg(coalesce(key, 'nan'), ';' ORDER BY link_id)) AS link_keys,
  arg_min(name, link_id) FILTER (name IS NOT NULL) AS name, string_agg(DISTINCT flag, ';' ORDER BY flag) AS direction_flag, md5(string_agg(link_id::VARCHAR, ';' ORDER BY link_id)) AS link_ids FROM dir GROUP BY 1, 2)
SELECT *, from_node_id || '->' || to_node_id AS edge_id, (row_number() OVER (ORDER BY from_node_id, to_node_id) - 1)::BIGINT AS edge_index FROM g""")
def link_dedup(spark, sf):
    out = clean.merge_links(clean.direct(_links(spark, sf), _nodes(spark, sf)), "link_id")
    return out.withColumns({"length": F.round("length", 6), "capacity": F.round("capacity", 2), "speed": F.round(F.col("speed") + 1e-7, 4), "jam_density": F.round(F.col("jam_density") + 1e-7, 4), "wave_speed": F.round(F.col("wave_speed") + 1e-9, 6)}).withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("link_ids", "link_keys")})


@register("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def latest_by_station(spark, sf):
    return clean.latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")


@register("""SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1""")
def keep_first(spark, sf):
    return clean.keep_first(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@register("""SELECT p_partkey, trunc(try_cast(p_retailprice::VARCHAR AS DOUBLE))::BIGINT AS whole, try_cast(p_name AS DOUBLE) AS bad, lower(trim(p_type)) AS kind FROM part WHERE lower(trim(p_type)) IN ('economy', 'small', 'standard') AND p_size BETWEEN 5 AND 30""")
def parse_and_filter(spark, sf):
    p = table(spark, sf, "part").where(F.lower(F.trim("p_type")).isin("economy", "small", "standard") & F.col("p_size").between(5, 30))
    return p.select("p_partkey", S.to_int(F.col("p_retailprice").cast("string")).alias("whole"), S.to_num("p_name").alias("bad"), F.lower(F.trim("p_type")).alias("kind"))


@register("""SELECT pos, value FROM (SELECT unnest(['orders: ' || count(*), 'customers: ' || count(DISTINCT o_custkey), 'first: ' || min(o_orderkey)]) AS value, unnest([0, 1, 2]) AS pos FROM orders)""")
def run_summary(spark, sf):
    one = table(spark, sf, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first"))
    names = one.columns
    return sinks.summary_lines(one).withColumn("pos", F.array_position(F.array(*(F.lit(n) for n in names)), F.split("value", ":")[0]).cast("int") - 1).select("pos", "value")


@register("""SELECT p_partkey, trim(p_brand) AS last_part, regexp_replace(regexp_replace(trim(p_name || ' / ' || p_brand), '[^0-9A-Za-z._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def names_and_lists(spark, sf):
    p = table(spark, sf, "part")
    parts = S.parse_list(F.concat("p_type", F.lit(","), "p_name", F.lit("， "), "p_brand"))
    return p.select("p_partkey", F.element_at(parts, -1).alias("last_part"), S.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))
