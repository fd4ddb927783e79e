"""Station statistics on suppliers, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import stations as O
from roadloom.plans.catalogue import register
from roadloom.plans.roles import table
from roadloom.sources import tables as T

ROWS = """r AS (SELECT l_suppkey AS station, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_quantity END AS samples, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS flow,
  l_discount AS speed, strftime(l_shipdate, '%m/%d/%Y') AS ts FROM lineitem)"""


def _rows(spark, sf):
    """Months are numbers and times dates until the few groups are formatted."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("station"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("month"), F.when(F.col("l_linenumber") == 4, 0.0).otherwise(F.col("l_quantity")).alias("samples"),
        F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("flow"), F.col("l_discount").alias("speed"), F.to_date("l_shipdate").alias("ts"),
    )


@register(f"""WITH {ROWS} SELECT station, month, count(*) AS records, sum(samples) AS samples_sum, count(flow) AS flow_count, round(avg(flow) + 1e-7, 4) AS flow_mean,
round(sum(flow * samples) FILTER (samples > 0 AND flow IS NOT NULL) / nullif(sum(samples) FILTER (samples > 0 AND flow IS NOT NULL), 0) + 1e-7, 4) AS flow_weighted, count(speed) AS speed_count, round(avg(speed) + 1e-8, 6) AS speed_mean,
round(sum(speed * samples) FILTER (samples > 0) / nullif(sum(samples) FILTER (samples > 0), 0) + 1e-8, 6) AS speed_weighted, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY 1, 2""")
def station_month_stats(spark, sf):
    out = O.month_summary(_rows(spark, sf))
    out = out.withColumns({"month": F.date_format("first_ts", "yyyy-MM"), "first_ts": F.date_format("first_ts", "MM/dd/yyyy"), "last_ts": F.date_format("last_ts", "MM/dd/yyyy")})
    # The nudges, here and in the SQL, keep means that end in a 5 from being rounded apart by the order of addition.
    return out.withColumns({c: F.round(F.col(c) + 10.0 ** (-d - 3 + (d == 6)), d) for c, d in (("flow_mean", 4), ("flow_weighted", 4), ("speed_mean", 6), ("speed_weighted", 6))})


def _profile_sql(policy):
    den = "sum(s)" if policy == "reference" else "sum(s) FILTER (s > 0 AND value > 20)"
    return f"""WITH r AS (SELECT user_id AS station, strftime(ts, '%H') AS time, ts::DATE AS date, user_id % 4 + hour(ts) % 2 AS s, value FROM events)
SELECT station, time, count(*) AS records, count(DISTINCT date) AS days, sum(s)::BIGINT AS samples_sum, count(*) FILTER (value > 20) AS flow_count,
round(sum(value * s) FILTER (s > 0 AND value > 20) / nullif({den}, 0), 6) AS flow_weighted FROM r GROUP BY 1, 2"""


def _profile(policy):
    def run(spark, sf):
        e = table(spark, sf, "events")
        rows = e.select(F.col("user_id").alias("station"), F.date_format("ts", "HH").alias("time"), F.to_date("ts").alias("date"), (F.col("user_id") % 4 + F.hour("ts") % 2).alias("samples"), F.when(F.col("value") > 20, F.col("value")).alias("flow"))
        return O.profile(rows, policy).withColumn("flow_weighted", F.round("flow_weighted", 6))

    return run


for _p in ("reference", "strict"):
    register(_profile_sql(_p), f"time_of_day_profile_{_p}")(_profile(_p))


@register("""WITH y AS (SELECT l_suppkey AS station, year(l_shipdate)::INT AS slot, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) AS value FROM lineitem GROUP BY 1, 2)
SELECT station, string_agg(slot || '=' || printf('%.3f', value), ',' ORDER BY slot) AS flows FROM y GROUP BY station""")
def annual_weighted_mean(spark, sf):
    y = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("slot")).agg(O.weighted_rounded("l_extendedprice", "l_quantity", 100, 3).alias("value"))
    flows = O.flow_map(y, "station", "slot", "value")
    return flows.select("station", F.array_join(F.transform(F.map_entries("flows"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.format_string("%.3f", e["value"]))), ",").alias("flows"))


@register("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT unnest(['left', 'right', 'matched', 'unmatched_left', 'unmatched_right']) AS metric, unnest([count(x), count(y), count(*) FILTER (x IS NOT NULL AND y IS NOT NULL), count(*) FILTER (y IS NULL), count(*) FILTER (x IS NULL)]) AS value FROM j""")
def coverage_sets(spark, sf):
    return O.coverage(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


@register("""SELECT c_custkey, CASE WHEN EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'yes' ELSE 'no' END AS metadata_matched FROM customer""")
def metadata_match(spark, sf):
    return O.with_metadata(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def missing_stations(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select("o_custkey"))


@register("""SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def matched_stations(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").intersect(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@register("""SELECT strftime(o_orderdate, '%Y-%m') AS file, count(*) AS rows, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date, count(DISTINCT o_custkey) AS stations,
arg_min(o_totalprice, o_orderkey) AS first_value, arg_max(o_totalprice, o_orderkey) AS last_value FROM orders GROUP BY 1""")
def file_summary(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("file"), "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_custkey", "o_totalprice")
    return O.file_summary(o, "file", "o_orderkey", "date", "o_custkey", "o_totalprice")


FILES = """f AS (SELECT 'd' || (l_suppkey % 12) || '_text_station_' || CASE l_linenumber % 4 WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN '5min' ELSE 'odd' END || '_' || strftime(l_shipdate, '%Y_%m') || '.txt' AS name, l_quantity::BIGINT % 5 AS length FROM lineitem)"""
PATTERNS = (("hour", r"d\d+_text_station_hour_\d{4}_\d{2}\.txt"), ("day", r"d\d+_text_station_day_\d{4}_\d{2}\.txt"), ("5min", r"d\d+_text_station_5min_\d{4}_\d{2}\.txt"))


def _files(spark, sf):
    kind = F.when(F.col("l_linenumber") % 4 == 0, "hour").when(F.col("l_linenumber") % 4 == 1, "day").when(F.col("l_linenumber") % 4 == 2, "5min").otherwise("odd")
    line = table(spark, sf, "lineitem")
    return line.select(F.concat(F.lit("d"), (F.col("l_suppkey") % 12).cast("string"), F.lit("_text_station_"), kind, F.lit("_"), F.date_format("l_shipdate", "yyyy_MM"), F.lit(".txt")).alias("name"), (F.col("l_quantity").cast("bigint") % 5).alias("length"))


@register(f"""WITH {FILES} SELECT CASE WHEN name LIKE '%hour%' THEN 'hour' WHEN name LIKE '%day%' THEN 'day' WHEN name LIKE '%5min%' THEN '5min' END AS kind, count(*) AS n, sum(length)::BIGINT AS bytes FROM f GROUP BY 1""")
def classify_files(spark, sf):
    return O.classify(_files(spark, sf), "name", PATTERNS).groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@register(f"""WITH {FILES}, n AS (SELECT name, count(*) AS c FROM f GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (name LIKE '%odd%') AS unknown, count(*) FILTER (length = 0) AS empty, (SELECT count(*) FROM n WHERE c > 1) AS repeated,
string_agg(DISTINCT regexp_extract(name, '(\\d{{4}})_(\\d{{2}})', 1), ',' ORDER BY regexp_extract(name, '(\\d{{4}})_(\\d{{2}})', 1)) AS years, array_to_string(list_sort(list_distinct(list(regexp_extract(name, '(\\d{{4}})_(\\d{{2}})', 2)::INT))), ',') AS months, '' AS days, 1 AS code FROM f""")
def file_anomalies(spark, sf):
    return O.anomalies(O.classify(_files(spark, sf), "name", PATTERNS))


@register(f"""WITH {FILES} SELECT regexp_extract(name, '(\\d{{4}})_(\\d{{2}})', 1)::INT AS year, regexp_extract(name, '(\\d{{4}})_(\\d{{2}})', 2)::INT AS month, count(*) AS n FROM f GROUP BY ALL""")
def download_manifest(spark, sf):
    return T.manifest(_files(spark, sf)).groupBy("year", "month").agg(F.count("*").alias("n"))


@register("""SELECT l_partkey AS edge, round(avg(l_extendedprice) + 1e-7, 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, max(l_extendedprice) AS max, count(*) AS n FROM lineitem GROUP BY 1""")
def edge_stats_quantiles(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("edge"), "l_extendedprice")
    out = O.edge_statistics(rows, "edge", "l_extendedprice")
    return out.select("edge", F.round(F.col("mean") + 1e-7, 4).alias("mean"), *(F.round(c, 4).alias(c) for c in ("p50", "p90", "p95", "p99")), "max", "n")


@register("""SELECT c_nationkey AS nation, count(*) AS sensors, count(DISTINCT c_mktsegment) AS segments, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS names, round(least(min(c_acctbal), 0), 2) AS low, round(greatest(max(c_acctbal), 0), 2) AS high FROM customer GROUP BY 1""")
def region_summary(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("sensors"), F.countDistinct("c_mktsegment").alias("segments"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ";").alias("names"),
        F.round(F.least(F.min("c_acctbal"), F.lit(0.0)), 2).alias("low"), F.round(F.greatest(F.max("c_acctbal"), F.lit(0.0)), 2).alias("high"),
    )


@register("""SELECT l_suppkey AS station, round(sum(l_tax) / nullif(sum(l_discount), 0), 6) AS share FROM lineitem GROUP BY 1""")
def observed_share(spark, sf):
    return O.observed_share(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("station"), "l_tax", "l_discount"), "station", "l_tax", "l_discount").withColumn("share", F.round("share", 6))


@register("""SELECT p_partkey, list_min(list_filter([regexp_extract(p_brand, '[0-9]+'), p_partkey::VARCHAR], lambda x: len(x) <= 3)) AS first_route FROM part""")
def route_number_regex(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.get(S.route_numbers("p_brand", "p_name", F.col("p_partkey").cast("string")), F.lit(0)).alias("first_route"))
