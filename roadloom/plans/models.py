"""The two count models, forecasts and capacities; rows only, as their draws have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import capacity, chains, simulate, topology
from roadloom.plans.catalogue import register
from roadloom.plans.roles import table, trips
from roadloom.plans.series import daily
from roadloom.sources.lineage import cut


@register("""SELECT p_partkey AS edge, p_type AS kind, round(ln(1 + least(greatest(p_retailprice / 1000, 0.005), top)), 6) AS log_length, coalesce(active, 0) AS active, coalesce(mx, 0)::DOUBLE AS observed_max
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS active, max(l_quantity) AS mx FROM lineitem GROUP BY 1) ON l_partkey = p_partkey CROSS JOIN (SELECT quantile_cont(p_retailprice / 1000, 0.995) AS top FROM part)""")
def capacity_features(spark, sf):
    return _features(spark, sf).select("edge", "kind", F.round("log_length", 6).alias("log_length"), "active", "observed_max")


def _features(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("edge"), (F.col("p_retailprice") / 1000).alias("length"), (F.col("p_size") % 4 + 1.0).alias("lanes"), (F.col("p_size") * 2.0).alias("speed"), F.lit(1800.0).alias("lane_capacity"), F.lit(150.0).alias("jam"), F.col("p_type").alias("kind"))
    stats = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("edge")).agg(F.max("l_quantity").alias("max"), F.count("*").alias("active"))
    return capacity.features(p, stats)


@register()
def capacity_fit(spark, sf):
    return capacity.fit_capacity(_features(spark, sf), trees=60)


@register()
def gibbs_chain(spark, sf):
    """Two chains of the cluster model on the daily counts of all users."""
    design = spark.range(1, 31).select(F.col("id").cast("int").alias("t"), F.array(F.lit(1.0), F.sin(F.col("id") / 5.0)).alias("f"))
    return chains.chain_summary(chains.cluster_draws(daily(spark, sf), design, 2, chains=2, iters=40, burn=20, labels=False), 20)


def _neighbourhood(spark, sf):
    """counts and pairs of a network of regions: trips between them by month, and which edges touch."""
    region = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), (F.col("n_regionkey") + 1).cast("long").alias("region"))
    t = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("int")
    moves = trips(spark, sf).select(F.col("from").alias("a"), F.col("to").alias("b"), t.alias("t")).groupBy("a", "b", "t").count()
    side = lambda k, n: region.select(F.col("key").alias(k), F.col("region").alias(n))
    flow = moves.join(side("a", "from"), "a").join(side("b", "to"), "b").groupBy("from", "to", "t").agg(F.sum("count").cast("double").alias("y"))
    flow = cut(flow.select((F.col("from") * 5 + F.col("to") - 5).alias("edge"), "from", "to", "t", "y"))
    nodes = region.select(F.col("region").alias("node"), F.col("region").alias("x"), F.lit(0).cast("long").alias("y")).distinct()
    pairs = cut(topology.pair_table(flow.select("edge", "from", "to").distinct(), nodes, "two_endpoint", "regions"))
    spine = flow.select("edge").distinct().select("edge", F.explode(F.sequence(F.lit(1), F.lit(MONTHS))).alias("t"))
    return spine.join(flow.select("edge", "t", "y"), ["edge", "t"], "left").na.fill(0.0, ["y"]), pairs


#: Months of the tables' trips, and those of them that models are fitted on.
MONTHS, FITTED = 84, 72


def _fits(spark, sf, **options):
    counts, pairs = _neighbourhood(spark, sf)
    blocks = chains.design_blocks(counts.where(F.col("t") <= FITTED), pairs, steps_day=12)
    return counts, pairs, chains.fit_edges(blocks, pairs, iters=30, burn=10, **options)


@register()
def neighbourhood_fit(spark, sf):
    """One edge a group: trips between regions by month, explained by the month and by the month before on edges that touch."""
    _, pairs, fits = _fits(spark, sf, shrink=True)
    return chains.pair_draws(fits, pairs)


@register()
def neighbourhood_forecast(spark, sf):
    counts, pairs, fits = _fits(spark, sf)
    last = counts.where(F.col("t") == FITTED).select("edge", "y")
    return chains.forecast_total(chains.forecast(fits, pairs, last, horizon=12, t_next=FITTED + 1, steps_day=12, saved=10))


@register()
def simulated_counts(spark, sf):
    """Counts of as many edges as there are users, at the half hours that have events."""
    e = table(spark, sf, "events")
    slots = e.select(F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 1800).alias("id")).distinct()
    return simulate.cluster_counts(simulate.flagged(slots), e.select("user_id").distinct().count())[0]
