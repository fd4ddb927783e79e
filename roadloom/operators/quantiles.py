"""Exact quantiles with linear interpolation, of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.sources.lineage import cut

#: Groups of at most this many rows are left to the built-in aggregate, which gives the same values.
ONE_TASK_ROWS = 1_000_000


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], one_task: int = ONE_TASK_ROWS, most: int | None = None) -> DataFrame:
    """keys, q: the array of quantiles `at` of each group's finite values; a group without any has no row.

    `most` is how many rows a group has at most where the caller knows it, which saves counting them. Where a group is
    larger than one task should hold, values are counted (map-side first), and the counts are range-partitioned by group and value, so that one group, or
    the whole table as one, spans many tasks. Ranks are running sums inside a partition plus what stands before it, which
    is one row a partition and group. The built-in aggregate would hold all distinct values of a group in one task.
    """
    keys = list(keys)
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf"))
    if most is None:
        most = rows.count()
        if most > one_task:
            most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= one_task:
        found = rows.where(ok).groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.array(*(F.lit(float(q)) for q in at))).alias("q"))
        return found.where(F.col("q").isNotNull())
    counts = rows.where(ok).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = cut(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))  # bounds are sampled, so the dealing is fixed
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*keys)
    before = sums.select(*keys, "_part", (F.sum("_sum").over(group.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(group).alias("_total"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = F.col("a._part") == F.col("b._part")
    for s in same:
        on = on & s
    both = dealt.alias("a").join(before.alias("b"), on).select(*(F.col(f"a.{k}").alias(k) for k in keys), "a._part", "_v", "_n", "_before", "_total")
    hi = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    both = both.withColumn("_hi", hi)
    place = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    rank = lambda k: F.min(F.when(F.col("_hi") > k, F.col("_v")))
    found = both.groupBy(*keys).agg(F.max("_total").alias("_total"), *(f.alias(n) for i, q in enumerate(at) for n, f in ((f"_a{i}", rank(F.floor(place(q)))), (f"_b{i}", rank(F.ceil(place(q)))))))
    line = lambda i, q: F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (place(q) - F.floor(place(q)))
    return found.select(*keys, F.array(*(line(i, q) for i, q in enumerate(at))).alias("q"))
