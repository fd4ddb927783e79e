"""The driver's tables in the roles of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute_of_day(ts: str):
    return F.hour(ts) * 60 + F.minute(ts)


def event_moves(spark, sf_dir) -> DataFrame:
    """time_bin (half hours of the day), from (user), to (event type), value."""
    return table(spark, sf_dir, "events").select(F.floor(minute_of_day("ts") / 30).cast("int").alias("time_bin"), F.col("user_id").alias("from"), F.col("event_type").alias("to"), "value")


def trips(spark, sf_dir) -> DataFrame:
    """Lineitems as trips between nations: time_bin (month), from, to, l_quantity, l_extendedprice, l_shipdate."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("from"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("to"))
    out = line.join(orders, "l_orderkey").join(supplier, "l_suppkey").join(customer, "o_custkey")
    return out.select(F.month("l_shipdate").alias("time_bin"), "from", "to", "l_quantity", "l_extendedprice", "l_shipdate")


TRIPS_SQL = """trips AS (SELECT month(l_shipdate)::INT AS time_bin, s_nationkey AS "from", c_nationkey AS "to", l_quantity, l_extendedprice, l_shipdate
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey)"""


def paths(spark, sf_dir) -> DataFrame:
    """Orders as paths: path, nodes (suppliers' nations by line), times (running quantities, in minutes)."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    order = ["l_linenumber", "s_nationkey", "l_quantity", "l_partkey"]
    at = F.sum(F.col("l_quantity") * 8).over(Window.partitionBy("l_orderkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # one running sum, in the shuffle that the group needs
    steps = F.array_sort(F.collect_list(F.struct(*order, "at")))
    rows = line.select("l_orderkey", *order, at.alias("at")).groupBy(F.col("l_orderkey").alias("path")).agg(steps.alias("s"))
    return rows.select("path", F.col("s.s_nationkey").alias("nodes"), F.col("s.at").alias("times"))


STEPS_SQL = """ordered AS (SELECT l_orderkey AS path, s_nationkey AS node, l_quantity * 8 AS q,
    row_number() OVER w AS k, sum(l_quantity * 8) OVER (w ROWS UNBOUNDED PRECEDING) AS at
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, s_nationkey, l_quantity, l_partkey)),
segments AS (SELECT a.path, (a.k - 1)::INT AS step, a.node AS "from", b.node AS "to", a.at AS enter, b.at AS leave
  FROM ordered a JOIN ordered b ON a.path = b.path AND b.k = a.k + 1)"""


def nation_edges(spark, sf_dir) -> DataFrame:
    """edge, from, to, length: all pairs of nations between which there is a trip."""
    e = trips(spark, sf_dir).where(F.col("from") != F.col("to"))
    e = e.groupBy("from", "to").agg(F.count("*").alias("n"))
    return e.select((F.col("from") * 100 + F.col("to")).cast("bigint").alias("edge"), F.col("from").cast("bigint").alias("from"), F.col("to").cast("bigint").alias("to"), (F.abs(F.col("from") - F.col("to")) + 0.5).alias("length"))


EDGES_SQL = """edges AS (SELECT ("from" * 100 + "to")::BIGINT AS edge, "from"::BIGINT AS "from", "to"::BIGINT AS "to", abs("from" - "to") + 0.5::DOUBLE AS length
  FROM trips WHERE "from" <> "to" GROUP BY "from", "to")"""
