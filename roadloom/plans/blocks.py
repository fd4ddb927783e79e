"""Tiles, payloads in pieces, factorised neighbours, footers and remote columns on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import matrices, payloads, raster, stations, topology
from roadloom.plans.catalogue import register
from roadloom.plans.networks import NEIGHBORS_SQL
from roadloom.plans.roles import nation_edges, table
from roadloom.sources import merging, remote, tables
from roadloom.sources.lineage import cut, scratch

NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register(" UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, count(*) - count({c}) AS nulls, count(*) AS rows FROM lineitem" for c in NUMBERS))
def footer_stats(spark, sf):
    """SC13, P12: minima, maxima and nulls of columns from the file's footers."""
    return tables.footer_stats(spark, f"{sf}/lineitem.parquet", NUMBERS)


SLOTS = "SELECT floor(epoch(ts) / 300)::BIGINT AS slot, user_id, max(value)::DOUBLE AS value FROM events GROUP BY 1, 2"


@register(f"SELECT slot, user_id, value FROM ({SLOTS}) WHERE slot // 288 = epoch(TIMESTAMP '2024-01-05') // 86400")
def day_tiles(spark, sf):
    """SC15: all events as a matrix of five-minute slots x users in tiles; of the tiles one day is read back."""
    e = table(spark, sf, "events").select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 300).alias("slot"), "user_id", "value")
    path = scratch(spark, "tiles")
    matrices.write_tiles(matrices.to_tiles(e, "slot", "user_id", "value"), path)
    day = 19727  # 2024-01-05, days from 1970
    times = e.where(F.floor(F.col("slot") / 288) == day).select("slot").distinct().count()
    return matrices.day_of_tiles(spark.read.parquet(path), day, times).select(F.col("row").alias("slot"), F.col("col").alias("user_id"), "value")


PICKED = (3, 17, 40, 63, 5)


@register("SELECT * FROM (" + " UNION ALL ".join(f"SELECT vec_id, {k}::BIGINT AS k, embedding[{c + 1}]::DOUBLE AS value FROM embeddings" for k, c in enumerate(PICKED)) + ") WHERE value IS NOT NULL")
def matrix_columns(spark, sf):
    """R4: chosen columns of a matrix of all vectors, as a matrix of their own, back as rows."""
    cells = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "value"))
    path = scratch(spark, "matrix")
    matrices.write_tiles(matrices.to_tiles(cells, "vec_id", "k", "value"), path)
    chosen = matrices.columns_of(spark.read.parquet(path), PICKED)
    return matrices.to_long(chosen).select(F.col("row").alias("vec_id"), F.col("col").alias("k"), "value")


@register(NEIGHBORS_SQL)
def neighbor_blocks(spark, sf):
    """J6, GR4: the lists of what starts and ends at each node, cut into blocks, expanded."""
    return topology.expand_neighbors(topology.neighbor_blocks(nation_edges(spark, sf), 8))


FLOW = "f AS (SELECT hour(ts)::INT AS time_bin, user_id AS edge, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)"
CUT = """s AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY time_bin ORDER BY edge) AS z FROM e), p AS (SELECT *, (z - length(t) - 1) // 400 AS piece FROM s)
SELECT time_bin, piece::BIGINT AS piece, min(edge) AS first, max(edge) AS last, count(*) AS entries, (sum(length(t) + 1) + 1)::INT AS bytes, '[' || string_agg(t, ',' ORDER BY edge) || ']' AS body FROM p GROUP BY 1, 2"""


def _flow(spark, sf):
    return table(spark, sf, "events").groupBy(F.hour("ts").alias("time_bin"), F.col("user_id").alias("edge")).agg(F.count("*").cast("double").alias("v"))


@register(f"WITH {FLOW}, e AS (SELECT time_bin, edge, '[' || edge || ',' || v::BIGINT || ']' AS t FROM f), {CUT}")
def payload_pieces(spark, sf):
    """V1, V3: a frame's flows in pieces of 400 bytes."""
    return payloads.pieces(_flow(spark, sf), "time_bin", "edge", payloads.pair("edge", F.col("v").cast("bigint").cast("string")), 400)


@register(f"""WITH {FLOW}, b AS (SELECT time_bin, row_number() OVER (ORDER BY time_bin) AS r FROM (SELECT DISTINCT time_bin FROM f)), c AS (SELECT edge, f.time_bin, r, r - row_number() OVER (PARTITION BY edge ORDER BY r) AS g FROM f JOIN b ON b.time_bin = f.time_bin WHERE v >= 2),
d AS (SELECT time_bin, edge, row_number() OVER (PARTITION BY edge, g ORDER BY r) AS n FROM c), e AS (SELECT time_bin, edge, '[' || edge || ',' || n || ']' AS t FROM d), {CUT}""")
def duration_pieces(spark, sf):
    """V1: for how many frames in a row edges have been congested, in pieces of 400 bytes."""
    return payloads.durations(_flow(spark, sf), "time_bin", "edge", "v", 2.0, 400)


@register(f"""WITH {FLOW}, n AS (SELECT count(DISTINCT edge) AS n FROM f) SELECT time_bin, time_bin * 60 AS start_min, time_bin * 60 + 60 AS end_min, count(*) AS active, round_even(count(*) / any_value(n.n), 4) AS active_share, count(*) FILTER (v >= 2) AS congested,
round_even(count(*) FILTER (v >= 2) / any_value(n.n), 4) AS congested_share, round_even(sum(v), 3) AS total, round_even(avg(v), 3) AS mean, round_even(quantile_cont(v, 0.95), 3) AS p95, round_even(max(v), 3) AS max FROM f, n GROUP BY 1""")
def frame_facts(spark, sf):
    """V1: the facts of each frame."""
    f = _flow(spark, sf)
    return payloads.frame_facts(f, "time_bin", "v", "v", 60, f.select("edge").distinct().count(), 2.0)


@register("SELECT o_orderkey, o_totalprice FROM orders")
def remote_columns(spark, sf):
    """SC14: two columns of a file behind a range server. The server stands on the driver and ends with the query, so the
    rows are fixed before; with a store that answers ranges, readers ask it and nothing passes the driver."""
    files = [r.path for r in tables.listing(spark, f"{sf}/orders.parquet").collect()]
    remote.register(spark)
    out = None
    for f in (x for x in files if x.endswith(".parquet")):
        with remote.Served(spark, f) as s:
            part = cut(spark.read.format("remote_parquet").option("columns", "o_orderkey,o_totalprice").load(s.url))
        out = part if out is None else out.unionByName(part)
    return out


@register("""SELECT year(l_shipdate)::VARCHAR AS year, count(*) FILTER (l_linenumber <> 3 AND l_linenumber <> 5) AS good, count(*) FILTER (l_linenumber = 3) AS bad_fields, count(*) FILTER (l_linenumber = 5) AS bad_flows,
sum(CASE WHEN l_linenumber <> 3 AND l_linenumber <> 5 THEN l_quantity END)::BIGINT AS samples, round(sum(CASE WHEN l_linenumber <> 3 AND l_linenumber <> 5 THEN l_extendedprice END), 2) AS flow FROM lineitem GROUP BY 1""")
def merged_loads(spark, sf):
    """U1, SC9, F4, F5: lines as station files, those of early years by day without a header, later ones by month with one
    and other columns, in one load; a line cut short and one whose flow is no number are put aside."""
    line = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y"), F.col("l_suppkey").cast("string").alias("station"), F.col("l_quantity").cast("int").cast("string").alias("samples"), F.col("l_extendedprice").cast("string").alias("flow"), "l_linenumber")
    flow = F.when(F.col("l_linenumber") == 5, F.lit("n/a")).otherwise(F.col("flow"))
    early, n = F.col("y") < 1995, F.col("l_linenumber")
    text = F.when(early, F.concat_ws(",", "station", F.when(n != 3, F.lit("ML")), "samples", flow)).otherwise(F.concat_ws(",", flow, "samples", F.when(n != 3, F.lit("x")), "station"))
    name = F.concat(F.when(early, F.lit("day_")).otherwise(F.lit("month_")), "y", F.lit("_"), F.pmod(F.xxhash64("station", "flow"), F.lit(8)))
    body = line.select(name.alias("name"), text.alias("value"), F.lit(1).alias("k"))
    years = line.where(~early).select("y").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(7))))  # a file may have a header only
    heads = years.select(F.concat(F.lit("month_"), "y", F.lit("_"), "part").alias("name"), F.lit("Total Flow,Samples,Note,Station ID").alias("value"), F.lit(0).alias("k"))
    path = scratch(spark, "loads")
    body.unionByName(heads).repartition("name").sortWithinPartitions("name", "k").select("name", "value").write.partitionBy("name").text(f"{path}/written")
    _named(spark, f"{path}/written", f"{path}/files")
    layouts = [merging.Layout(r"day_(\d{4})_\d+\.txt$", ("station", "lane", "samples", "flow"), ("year",)), merging.Layout(r"month_(\d{4})_\d+\.txt$", None, ("year",))]
    columns = {"station": ("string", ("station", "Station ID")), "samples": ("int", ("samples", "Samples")), "flow": ("double", ("flow", "Total Flow"))}
    rows = merging.read_merged(spark, f"{path}/files", layouts, columns, ["station"], "*.txt").withColumns({"ok": F.size("problems") == 0, "short": F.exists("problems", lambda p: p.contains("fields of"))})
    return rows.groupBy("year").agg(
        F.count_if("ok").alias("good"), F.count_if("short").alias("bad_fields"), F.count_if(~F.col("ok") & ~F.col("short")).alias("bad_flows"), F.sum(F.when(F.col("ok"), F.col("samples"))).alias("samples"), F.round(stations.whole_sum(F.when(F.col("ok"), F.col("flow")), 100), 2).alias("flow")
    )


def _named(spark, written: str, at: str) -> None:
    """Files of `written`/name=x/ as `at`/x.txt: file systems' renames, a call a file."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(written).getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path(at))
    for r in tables.listing(spark, written).where("path LIKE '%/name=%/part-%'").collect():
        fs.rename(path(r.path), path(f"{at}/{r.path.rsplit('/name=', 1)[1].split('/')[0]}.txt"))


@register("""SELECT p_partkey, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE round_even(x, 3)::DOUBLE::VARCHAR END AS xijt, CASE WHEN d = floor(d) THEN d::BIGINT::VARCHAR ELSE round_even(d, 3)::DOUBLE::VARCHAR END AS density, round_even(x / (len * 300), 4)::DOUBLE::VARCHAR AS congestion
FROM (SELECT p_partkey, p_size::DOUBLE AS x, greatest(p_retailprice / 1000, 1e-6) AS len, p_size / (greatest(p_retailprice / 1000, 1e-6) * 2) AS d FROM part)""")
def metric_values(spark, sf):
    """metrics of parts by their names."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x_ijt"), (F.col("p_retailprice") / 1000).alias("len"), F.lit(2.0).alias("lanes"), F.lit(150.0).alias("jam"), F.lit(1800.0).alias("lc"), F.lit(1.0).alias("cap"))
    m = S.flow_measures("x_ijt", "len", "lanes", "jam", "lc", "cap")
    rows = p.withColumns({"density_veh_per_km_lane": m["density"], "congestion_index": m["congestion"]})
    return rows.select("p_partkey", *(S.metric_text(k).alias(k) for k in ("xijt", "density", "congestion")))


@register("""WITH p AS (SELECT user_id AS px, hour(ts) AS py, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2), l AS (SELECT k AS level, px // (1 << k) AS px, py // (1 << k) AS py, sum(value) AS value FROM p, range(4) r(k) GROUP BY 1, 2, 3)
SELECT level::INT AS level, (px // 64)::BIGINT AS tx, (py // 64)::BIGINT AS ty, count(*) FILTER (value > 0) AS lit, sum(value) AS total FROM l GROUP BY 1, 2, 3""")
def heat_tiles(spark, sf):
    """V7, V8, SK7: edges against hours as a heat map in tiles of four levels; the pictures are drawn and left out."""
    p = raster.point_pixels(table(spark, sf, "events"), F.col("user_id"), F.hour("ts"), F.lit(1))
    return raster.tiles(raster.pyramid(p, 4), 64).where(F.length("png") > 0).drop("png")


@register()
def map_tiles(spark, sf):
    """V2, SK6: vectors as road segments on a map in tiles of three levels, with their pictures."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 1000
    s = table(spark, sf, "embeddings").select(at(0).alias("ax"), at(1).alias("ay"), (at(0) + at(2) / 4).alias("bx"), (at(1) + at(3) / 4).alias("by"))
    return raster.tiles(raster.pyramid(raster.line_pixels(s, 1.0, F.lit(1)), 3))
