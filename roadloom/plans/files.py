"""Sources and sinks: each query writes a file in the shared folder, in the form that a reader is for, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.plans.catalogue import register
from roadloom.plans.roles import table
from roadloom.sources import sinks, tables
from roadloom.sources.lineage import scratch


def _lines(df, path):
    df.select("value").write.text(path)
    return path


@register("""SELECT o_orderkey::VARCHAR AS "order key", CASE WHEN o_orderkey % 4 = 0 THEN 'say "hi", all' ELSE o_orderpriority END AS _code, o_custkey FROM orders""")
def csv_table(spark, sf):
    """SK1, SC2, SC3, SC16: a CSV with a header that has blanks around names, a nameless column, and quotes in fields."""
    path = scratch(spark, "csv")
    o = table(spark, sf, "orders")
    code = F.when(F.col("o_orderkey") % 4 == 0, F.lit('say "hi", all')).otherwise(F.col("o_orderpriority"))
    sinks.write_table(o.select(F.col("o_orderkey").alias(" order key "), code.alias("_code"), F.lit("x").alias(""), F.col("o_custkey").alias("o_custkey")), path, fmt="csv")
    return tables.read_csv(spark, path, {"o_custkey": "bigint"})


@register("""SELECT station, count(*) AS n, sum(samples)::BIGINT AS samples FROM (SELECT l_suppkey::VARCHAR AS station, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS samples FROM lineitem WHERE l_linenumber <> 5) GROUP BY 1""")
def positional_table(spark, sf):
    """SC4, SC5: header-less station files; rows of one field are left out, rows with an empty second field stay."""
    path = scratch(spark, "positional")
    row = F.concat_ws(",", F.lit("07/01/2020 00:00:00"), "l_suppkey", F.lit("11"), F.lit("5"), F.lit("N"), F.lit("ML"), F.lit(""), F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("int").cast("string")).otherwise(F.lit("")), F.lit("90"))
    line = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 5, F.lit("end of block")).otherwise(row).alias("value"))
    df = tables.read_positional(spark, _lines(line, path), tables.STATION_DAY, ["station", "samples"])
    return df.groupBy("station").agg(F.count("*").alias("n"), F.sum(F.col("samples").cast("bigint")).alias("samples"))


@register("""SELECT l_suppkey::VARCHAR AS station, count(*) AS n, sum(l_quantity)::BIGINT AS samples, round(sum(l_extendedprice), 2) AS flow, count(*) FILTER (l_linenumber % 2 = 0) AS speeds FROM lineitem GROUP BY 1""")
def hour_table(spark, sf):
    """SC6, U1: positional hour rows, some of which end before the speed."""
    path = scratch(spark, "hour")
    head = F.concat_ws(",", F.lit("07/01/2020 00:00:00"), "l_suppkey", *[F.lit("")] * 5, F.col("l_quantity").cast("int"), F.lit("90"), F.col("l_extendedprice").cast("string"))
    df = tables.read_hour(spark, _lines(table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, F.concat(head, F.lit(",0.1,65.5"))).otherwise(head).alias("value")), path))
    return df.groupBy("station").agg(F.count("*").alias("n"), F.sum("samples").alias("samples"), F.round(F.sum("total_flow"), 2).alias("flow"), F.count("average_speed").alias("speeds"))


@register("""SELECT s_suppkey::VARCHAR AS station, CASE WHEN s_suppkey % 3 = 0 THEN 'Main St at ' || s_suppkey ELSE 'Main' END AS name, 'u1' AS user_id_1 FROM supplier""")
def metadata_table(spark, sf):
    """SC7, SC8: tab-delimited metadata; names with tabs inside are folded, a header line is left out."""
    path = scratch(spark, "metadata")
    k = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Main St\tat "), k)).otherwise(F.lit("Main"))
    rows = table(spark, sf, "supplier").select(F.concat_ws("\t", k, *[F.lit("f")] * 12, name, F.lit("u1"), F.lit("u2"), F.lit("u3"), F.lit("u4")).alias("value"))
    df = tables.read_metadata(spark, _lines(rows.unionByName(spark.createDataFrame([("ID\tFwy\tDir",)], "value string")), path))
    return df.select("station", "name", "user_id_1")


def _geometry(k):
    point = lambda d: F.struct((k + d + 0.25).cast("double").alias("lat"), (k * 2 + d + 0.5).cast("double").alias("lon"))
    return F.array(point(0), point(1), point(2))


@register("""SELECT n_nationkey AS way, CASE WHEN n_nationkey % 2 = 0 THEN 'primary' ELSE 'service' END AS highway, n_name AS name, (g.i)::INT AS pos, (n_nationkey * 2 + g.i + 0.5)::DOUBLE AS lon, (n_nationkey + g.i + 0.25)::DOUBLE AS lat FROM nation CROSS JOIN range(3) g(i) WHERE n_nationkey % 5 <> 0""")
def way_extract(spark, sf):
    """SC17, SC18: a map extract whose ways hold their points; footways are left out."""
    path = scratch(spark, "ways")
    k = F.col("n_nationkey")
    kind = F.when(k % 5 == 0, "footway").when(k % 2 == 0, "primary").otherwise("service")
    way = F.struct(F.lit("way").alias("type"), k.alias("id"), F.create_map(F.lit("highway"), kind, F.lit("name"), F.col("n_name")).alias("tags"), _geometry(k).alias("geometry"))
    one = table(spark, sf, "nation").agg(F.collect_list(way).alias("elements"))  # an extract is one JSON document
    return tables.read_ways(spark, _lines(one.select(F.to_json(F.struct("elements")).alias("value")), path))


@register("""SELECT n_regionkey AS way, count(*) AS points, round(sum(n_nationkey + 0.5), 6) AS lon FROM nation WHERE n_nationkey <> 4 GROUP BY 1""")
def way_extract_by_node(spark, sf):
    """SC19: a map extract whose ways name nodes; a node that is not there is left out."""
    path = scratch(spark, "nodes")
    n, none = table(spark, sf, "nation"), F.lit(None)
    shape = "struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,nodes:array<bigint>>"
    nodes = n.where("n_nationkey <> 4").select(F.struct(F.lit("node").alias("type"), F.col("n_nationkey").cast("bigint").alias("id"), F.lit(1.0).alias("lat"), (F.col("n_nationkey") + 0.5).cast("double").alias("lon"), none.cast("map<string,string>").alias("tags"), none.cast("array<bigint>").alias("nodes")).cast(shape).alias("e"))
    lists = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("bigint"))).alias("nodes"))
    ways = lists.select(F.struct(F.lit("way").alias("type"), F.col("n_regionkey").cast("bigint").alias("id"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.create_map(F.lit("highway"), F.lit("primary")).alias("tags"), "nodes").cast(shape).alias("e"))
    one = nodes.unionByName(ways).agg(F.collect_list("e").alias("elements"))
    out = tables.read_ways_by_node(spark, _lines(one.select(F.to_json(F.struct("elements")).alias("value")), path))
    return out.groupBy("way").agg(F.count("*").alias("points"), F.round(F.sum("lon"), 6).alias("lon"))


@register("""SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS node_id, n_name FROM nation""")
def indexed_table(spark, sf):
    """SC11, SC12: the row ordinal of a Parquet file as a key, and a projected scan."""
    path = scratch(spark, "index")
    table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey").write.parquet(path)
    return tables.with_row_index(spark, path).select("node_id", "n_name")


@register("""SELECT * FROM (SELECT unnest(['l_quantity', 'l_discount', 'gap']) AS name, unnest([min(l_quantity), min(l_discount), min(CASE WHEN l_linenumber = 3 THEN l_tax END)])::DOUBLE AS min, unnest([max(l_quantity), max(l_discount), max(CASE WHEN l_linenumber = 3 THEN l_tax END)])::DOUBLE AS max, unnest([0, 0, count(*) FILTER (l_linenumber <> 3)])::BIGINT AS nulls FROM lineitem) WHERE max > 0""")
def sensor_stats(spark, sf):
    """SC13, P12: minimum, maximum and nulls of sensor columns with a positive maximum."""
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_discount", F.when(F.col("l_linenumber") == 3, F.col("l_tax")).alias("gap"), F.lit(0.0).alias("dead"))
    return tables.column_stats(rows, rows.columns)


@register("""SELECT count(*) AS lines, 'line ' || min(o_orderkey) AS first, 'line ' || max(o_orderkey) AS last FROM orders""")
def line_facts(spark, sf):
    """SC21: lines, first line and last non-blank line of a file, which is written in parts: their names follow the order."""
    path = scratch(spark, "lines")
    o = table(spark, sf, "orders").select("o_orderkey").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    parts = tables.line_summary(spark, _lines(o.select(F.concat(F.lit("line "), F.col("o_orderkey").cast("string")).alias("value")), path))
    return parts.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.min_by("first", "file").alias("first"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("file"))).alias("last"))


@register("""SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' GROUP BY 1""")
def day_rows(spark, sf):
    """SC15, P7: the rows of one day, as many times as there must be."""
    e = table(spark, sf, "events")
    times = e.where(F.to_date("ts") == "2024-01-05").select("ts").distinct().count()
    return tables.day_slice(e, "ts", "2024-01-05", times).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@register("""SELECT '{"orders":' || count(*) || ',"first":' || min(o_orderkey) || ',"none":null}' AS json, 'window.RUN = {"orders":' || count(*) || ',"first":' || min(o_orderkey) || ',"none":null};' AS js FROM orders""")
def json_payload(spark, sf):
    """SK3, SK5: a summary as JSON and as a script, written and read back."""
    one = table(spark, sf, "orders").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first"), F.lit(None).cast("string").alias("none"))
    a, b = scratch(spark, "json"), scratch(spark, "js")
    body = sinks.summary_json(one)
    body.write.text(a)
    sinks.js_payload(body, "RUN").write.text(b)
    return spark.read.text(a).toDF("json").crossJoin(spark.read.text(b).toDF("js"))  # one row each


@register("""WITH s AS (SELECT l_suppkey, year(l_shipdate) AS slot, sum(CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity END) AS value FROM lineitem GROUP BY 1, 2)
SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_nationkey":' || s_nationkey || ',"flows":{' || coalesce(string_agg('"' || slot || '":' || coalesce(value::BIGINT || '.0', 'null'), ',' ORDER BY slot), '') || '}}' AS payload FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_nationkey""")
def station_payload(spark, sf):
    """V6, J15: stations with their series by slot; slots without a value, as every fourth station's, are null."""
    value = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_quantity"))
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("slot")).agg(F.sum(value).alias("value"))
    return sinks.station_payload(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), s, "s_suppkey")


@register("""SELECT lower(n_name) || '.csv' AS name, n_name = 'NATION_7' AS found FROM nation""")
def found_files(spark, sf):
    """SC1, SC9, SC23: files of a folder, one a nation, by name without regard to case, and the list of what must be there."""
    folder = scratch(spark, "folder")
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(sc._jsc.hadoopConfiguration())
    names = [f"{r.n_name.lower()}.csv" for r in table(spark, sf, "nation").select("n_name").collect()]  # a row a file
    for name in names:
        fs.create(sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")).close()
    tables.require_sources(spark, folder, names)
    at = tables.find_file(spark, folder, ["nation.csv", "NATION_7.CSV"])
    return tables.listing(spark, folder).select("name", (F.col("path") == at).alias("found"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'time_weighted_occupancy' ELSE 'period_count' END AS flow_basis, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS x FROM orders""")
def metric_basis(spark, sf):
    """SC26: density rests on occupancy where there is one, other metrics on counts."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_totalprice") / 2).alias("avg_vehicles"))
    dense, _ = tables.metric_flow("density", o.where("o_orderkey % 2 = 0"), o)
    flow, _ = tables.metric_flow("flow", o, o.where("o_orderkey % 2 <> 0"))
    return dense.select("o_orderkey", "flow_basis", "x").unionByName(flow.select("o_orderkey", "flow_basis", "x"))


@register("""SELECT c_custkey::VARCHAR AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_list(spark, sf):
    """SK4: the plain list of stations without metadata, written and read back."""
    path = scratch(spark, "list")
    sinks.write_list(table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), "c_custkey", path)
    return spark.read.schema("value string").text(path)
