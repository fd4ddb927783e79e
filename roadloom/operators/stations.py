"""Station statistics: monthly summaries, time-of-day profiles, coverage, file and anomaly summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.scalars import safe_divide
from roadloom.operators.quantiles import quantiles


def weighted(value: str, weight: str, policy: str = "strict") -> Column:
    """Mean of value by weight; null where the weights add to 0.

    strict: a row counts in both sums only with a positive weight and a value. reference: the denominator takes
    every row's weight, with a value or not.
    """
    if policy not in ("strict", "reference"):
        raise ValueError(policy)
    use = (F.col(weight) > 0) & F.col(value).isNotNull()
    num = F.sum(F.when(use, F.col(value) * F.col(weight)))
    den = F.sum(F.when(use, F.col(weight))) if policy == "strict" else F.sum(weight)
    return F.try_divide(num, den)


def weighted_rounded(value: str, weight: str, unit: int, digits: int) -> Column:
    """The strict mean of value by weight, rounded half away from zero.

    Where a group's weights are whole, its values whole multiples of 1 / unit and its sums under 2 ** 53, sums are of whole
    numbers, so that no order of addition decides how a mean that ends in a 5 is rounded. Other groups round the plain mean.
    """
    v, w = F.col(value), F.col(weight)
    use = (w > 0) & v.isNotNull()
    n, m = F.round(v * unit).try_cast("bigint"), w.try_cast("bigint")
    x = F.try_multiply(n, m)
    whole = F.bool_and(F.when(use, F.coalesce((n / unit == v) & (m == w) & x.isNotNull(), F.lit(False))))
    num, den = F.try_sum(F.when(use, x)), F.try_multiply(F.try_sum(F.when(use, m)), F.lit(unit).cast("bigint"))
    small = F.coalesce((num.between(-(2**53), 2**53)) & (den < 2**40), F.lit(False))
    size = F.when(small, F.abs(num))
    over = F.try_mod(size, den)
    steps = F.try_divide(size - over, den) * 10**digits + F.floor(F.try_divide(over * (2 * 10**digits) + den, 2 * den))
    return F.when(whole & small, F.signum(num) * steps / 10**digits).otherwise(F.round(weighted(value, weight), digits))


def whole_sum(value: Column, unit: int) -> Column:
    """The sum of a group's values: of whole numbers where all are whole multiples of 1 / unit and the sum is under 2 ** 53
    of them, so that no order of addition shows in it; else of the values as they are."""
    n = F.rint(value * unit).try_cast("bigint")
    whole = F.bool_and((n / unit).eqNullSafe(value) & F.coalesce(n.between(-(2**53), 2**53), F.lit(True)))
    total = F.try_sum(n)
    return F.when(whole & total.between(-(2**53), 2**53), total / unit).otherwise(F.sum(value))


def month_summary(rows: DataFrame) -> DataFrame:
    """station, month, ts, samples, flow, speed -> records, sums, counts, plain and weighted means, first and last time.

    With month as a number and ts as a date, nothing but the few result rows needs formatting, and the aggregate hashes.
    """
    return rows.groupBy("station", "month").agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum("samples"), F.lit(0.0)).alias("samples_sum"),
        F.count("flow").alias("flow_count"),
        F.avg("flow").alias("flow_mean"),
        weighted("flow", "samples").alias("flow_weighted"),
        F.count("speed").alias("speed_count"),
        F.avg("speed").alias("speed_mean"),
        weighted("speed", "samples").alias("speed_weighted"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def profile(rows: DataFrame, policy: str = "reference") -> DataFrame:
    """station, time, date, samples, flow -> records, distinct days, sums and the weighted mean of each time of day."""
    return rows.groupBy("station", "time").agg(
        F.count("*").alias("records"), F.countDistinct("date").alias("days"), F.sum("samples").alias("samples_sum"),
        F.count("flow").alias("flow_count"), weighted("flow", "samples", policy).alias("flow_weighted"),
    )


def flow_map(rows: DataFrame, key: str, slot: str, value: str) -> DataFrame:
    """key, flows: map slot -> value, in slot order."""
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(slot, value)))).alias("flows"))


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str = "station") -> DataFrame:
    """Adds metadata_matched, yes or no."""
    known = metadata.select(key).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, key, "left").withColumn("metadata_matched", F.when(F.col("_known"), "yes").otherwise("no")).drop("_known")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """metric, value: how many keys are in both, and in one only; a key is tagged by side and met once."""
    both = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side"))).where(F.col(key).isNotNull())
    sides = both.groupBy(key).agg(F.bit_or("side").alias("side"))
    counted = sides.agg(F.count_if(F.col("side") != 2).alias("left"), F.count_if(F.col("side") != 1).alias("right"), F.count_if(F.col("side") == 3).alias("matched"), F.count_if(F.col("side") == 1).alias("unmatched_left"), F.count_if(F.col("side") == 2).alias("unmatched_right"))
    return counted.unpivot([], counted.columns, "metric", "value")


def file_summary(rows: DataFrame, file: str, ordinal: str, date: str, station: str, value: str) -> DataFrame:
    """Rows, first and last date, distinct stations, and the first and last value by ordinal of each file."""
    return rows.groupBy(file).agg(
        F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(station).alias("stations"),
        F.min_by(value, ordinal).alias("first_value"), F.max_by(value, ordinal).alias("last_value"),
    )


def classify(names: DataFrame, name: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds kind: the first pattern that the name matches, null for none."""
    kind = F.coalesce(*(F.when(F.col(name).rlike(f"^(?:{p})$"), F.lit(k)) for k, p in patterns))
    return names.withColumn("kind", kind)


def anomalies(files: DataFrame) -> DataFrame:
    """kind, name, length -> one row: totals, unknown, empty, repeated names, the years, months and days in names, and a code.

    The code is 0 where nothing is odd, 1 where a name is unknown or repeated or a file empty, 2 where there is no file.
    """
    once = files.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isNull()).alias("unknown"), F.count_if(F.col("length") == 0).alias("empty"))
    part = lambda i: F.nullif(F.regexp_extract("name", r"(\d{4})_(\d{2})(?:_(\d{2}))?", i), F.lit("")).try_cast("int")
    out = once.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"), F.coalesce(F.sum("empty"), F.lit(0)).alias("empty"), F.count_if(F.col("n") > 1).alias("repeated"),
        *(F.array_join(F.array_sort(F.collect_set(part(i))), ",").alias(k) for i, k in ((1, "years"), (2, "months"), (3, "days"))),
    )
    odd = (F.col("unknown") > 0) | (F.col("empty") > 0) | (F.col("repeated") > 0)
    return out.withColumn("code", F.when(F.col("total") == 0, 2).when(odd, 1).otherwise(0))


def edge_statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, exact quantiles (linear interpolation), max and count of each edge."""
    found = quantiles(rows, [key], value, (0.5, 0.9, 0.95, 0.99)).select(F.col(key).alias("_k"), F.col("q").alias("_q"))
    out = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))
    out = out.join(found, F.col(key).eqNullSafe(F.col("_k")), "left")
    return out.select(key, "mean", *(F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))), "max", "n")


def observed_share(rows: DataFrame, key: str, num: str, den: str) -> DataFrame:
    return rows.groupBy(key).agg(safe_divide(F.sum(num), F.sum(den)).alias("share"))
