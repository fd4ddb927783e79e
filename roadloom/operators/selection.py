"""Selections, positions, labels and reports over tables of edges, segments and forecasts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.clean import dense_index
from roadloom.operators.quantiles import quantiles

#: Labels of speed limit codes from 0.
SPEED_LABELS = ("unknown", "5 km/h", "20 km/h", "30 km/h", "40 km/h", "50 km/h", "60 km/h", "70 km/h", "80 km/h", "90 km/h", "100 km/h", "110 km/h")


def in_number_order(df: DataFrame, c: str, name: str = "place") -> DataFrame:
    """Adds each row's 0-based place in the order of a text column read as a whole number; texts that are none come last."""
    n = F.col(c).try_cast("bigint")
    return dense_index(df.withColumns({"_none": n.isNull(), "_n": n}), ["_none", "_n", c], name).drop("_none", "_n")


def background(segments: DataFrame, chosen: DataFrame, key: str, length: str, most: int = 6400) -> DataFrame:
    """The chosen segments, then the longest others, each once, `most` in all; ties to the least key."""
    first = chosen.select(key).distinct().withColumn("_chosen", F.lit(True))
    rows = segments.dropDuplicates([key]).join(first, key, "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)))
    return rows.orderBy(F.desc("_chosen"), F.desc_nulls_last(length), key).limit(most).withColumnRenamed("_chosen", "chosen")


def largest(df: DataFrame, value: str, key: str, k: int = 8) -> DataFrame:
    """The k rows of the largest value, ties to the least key."""
    return df.orderBy(F.desc_nulls_last(value), key).limit(k)


def sample_keys(df: DataFrame, key: str, k: int = 6, seed: int = 1) -> DataFrame:
    """k keys at most, the first by a seeded hash, so that a rerun picks the same."""
    return df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def at_position(rows: DataFrame, members: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Rows of the members with the member's 0-based position in an order, as a matrix has it."""
    return rows.join(dense_index(members.select(key, *(o for o in order if o != key)).distinct(), order, name).select(key, name), key)


def visible(roads: DataFrame, stations: DataFrame, key: str) -> DataFrame:
    """Roads that any of the shown stations is on."""
    return roads.join(stations.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")


def with_geometry(links: DataFrame, matched: DataFrame, key: str, hide: bool = False) -> DataFrame:
    """Links (ax, ay, bx, by) with their matched points; without any, the straight line or, with `hide`, not at all."""
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    out = links.join(matched.select(key, F.col("points").alias("_points")), key, "inner" if hide else "left")
    return out.withColumn("matched", F.col("_points").isNotNull()).withColumn("points", F.coalesce("_points", F.array(point("ax", "ay"), point("bx", "by")))).drop("_points")


def day_totals(rows: DataFrame, ts: str, value: str) -> DataFrame:
    """day, n, total: the total of a day without any value is null."""
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def speed_label(code) -> Column:
    """Label of a speed limit code; an unknown code is its own text, a null one counts as 0."""
    c = F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit(0)).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, SPEED_LABELS)), F.when(c >= 0, c)), c.cast("string"))


def side(direction) -> Column:
    """The side on which a direction is drawn: 1 for north and east, -1 for south and west, 0 else."""
    d = F.upper(F.substring(F.trim(F.col(direction) if isinstance(direction, str) else direction), 1, 1))
    return F.when(d.isin("N", "E"), 1).when(d.isin("S", "W"), -1).otherwise(0)


#: Nodes of a model network whose distances are all listed.
MODEL_NODES = 2000


def node_distance(nodes: DataFrame) -> DataFrame:
    """a, b, distance: Manhattan distances of all pairs of a model network's nodes (node, x, y), MODEL_NODES at most.

    A row for each pair is the result; for neighbours of a larger network there are `k_nearest` and the pair tables.
    """
    if (n := nodes.count()) > MODEL_NODES:
        raise ValueError(f"{n} nodes; distances of all pairs are for model networks of {MODEL_NODES} at most")
    every = nodes.agg(F.collect_list(F.struct("node", "x", "y")).alias("_all"))  # one row, of the size just checked
    pairs = nodes.crossJoin(F.broadcast(every)).select("node", "x", "y", F.explode("_all").alias("o"))
    return pairs.select(F.col("node").alias("a"), F.col("o.node").alias("b"), (F.abs(F.col("x") - F.col("o.x")) + F.abs(F.col("y") - F.col("o.y"))).alias("distance"))


def mean_intensity(states: DataFrame, eta: str, stored: str | None = None, limit: float = 8.0) -> DataFrame:
    """Adds intensity: the stored posterior mean where there is one, else exp of the last state's eta within +-limit."""
    own = F.exp(F.least(F.greatest(F.col(eta), F.lit(-limit)), F.lit(limit)))
    return states.withColumn("intensity", F.coalesce(F.col(stored), own) if stored else own)


def one_edge(bands: DataFrame, truth: DataFrame, edge, steps_day: int, method: str) -> DataFrame:
    """Forecast bands (h, edge, mean, lower, upper) of one edge beside what was observed and true (h, edge, y, rate)."""
    own = bands.where(F.col("edge") == edge).select("h", "edge", "mean", "lower", "upper").join(truth.select("h", "edge", "y", "rate"), ["h", "edge"], "left")
    return own.select("h", (F.col("h") / steps_day).alias("forecast_day"), F.lit(method).alias("method"), F.col("y").alias("observed"), F.col("rate").alias("truth"), "mean", "lower", "upper")


def bound(frames: Mapping[str, DataFrame], name: str = "method") -> DataFrame:
    """Frames of several models under each other, with their names."""
    out = None
    for label, df in frames.items():
        part = df.withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no frames")
    return out


def flow_payload(flow: DataFrame, edge: str, value: str, digits: int = 3) -> DataFrame:
    """time_bin, flows: each bin's [edge, value] pairs by edge, as JSON; whole values without a point."""
    from roadloom.functions.scalars import compact

    pair = F.concat(F.lit("["), F.col(edge).cast("string"), F.lit(","), compact(value, digits), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(edge).alias("e"), pair.alias("p"))))
    return flow.groupBy("time_bin").agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["p"]), ","), F.lit("]")).alias("flows"))


def describe(rows: DataFrame, value: str, at: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: count, mean, std, min, exact percentiles, max of a column's values."""
    base = rows.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(rows, [], value, at)
    names = [f"p{round(100 * p)}" for p in at]
    return base.crossJoin(q).select("count", "mean", "std", "min", *(F.col("q")[i].alias(n) for i, n in enumerate(names)), "max")  # one row each


def report(rows: DataFrame, numbers: Sequence[str], classes: Sequence[str]) -> list[str]:
    """Lines of a text report: a description of each number, the counts of each class. What is collected is the report."""
    out = []
    for c in numbers:
        out.append(f"{c}:")
        out += [f"  {k}: {v}" for r in describe(rows, c).collect() for k, v in r.asDict().items()]
    for c in classes:
        out.append(f"{c}:")
        out += [f"  {r[0]}: {r['n']}" for r in rows.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).collect()]
    return out


def next_name(name: str, taken: Sequence[str]) -> str:
    """A run's name, with _2, _3 ... where it is taken."""
    used, k = set(taken), 2
    if name not in used:
        return name
    base = re.sub(r"/+$", "", name)
    while f"{base}_{k}" in used:
        k += 1
    return f"{base}_{k}"


def manifest(spark: SparkSession, run: str, outputs: Mapping[str, str | None], facts: Mapping[str, object]) -> DataFrame:
    """name, value: what a run wrote and was asked, in order; outputs that are None are left out."""
    rows = [("run", run), *((k, str(v)) for k, v in facts.items()), *((f"output {k}", v) for k, v in outputs.items() if v is not None)]
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "pos int, name string, value string")
