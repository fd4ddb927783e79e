"""Segmented scans against windows, with one key that holds most rows, and the operators built on them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.operators import evaluate, frames, spatial
from roadloom.operators.quantiles import quantiles
from roadloom.operators.scans import Scan, leads


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds nine tenths of the rows; null keys, null values, and keys of one row."""
    r = random.Random(0)
    data = [(("hot" if r.random() < 0.9 else r.choice(["a", "b", None, f"k{k}"])), k, r.choice([None, 1.0, 2.5, -3.0]), r.randint(0, 5)) for k in range(4000)]
    return spark.createDataFrame(data, "key string, at int, v double, n int").repartition(7).cache()


def same(a, b, name, digits=9):
    pick = lambda df: sorted(((r["key"] or ""), r["at"], repr(round(r[name], digits) if isinstance(r[name], float) else r[name])) for r in df.collect())
    assert pick(a) == pick(b)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_against_windows(rows, one_task):
    w = Window.partitionBy("key").orderBy("at")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v, scan = F.col("v"), lambda: Scan(rows, ["key"], ["at"], one_task)
    cases = {
        "sum": (scan().sum("x", v), F.sum(F.coalesce(v, F.lit(0))).over(back)),
        "number": (scan().number("x"), F.row_number().over(w)),
        "last": (scan().last("x", v), F.last(v, ignorenulls=True).over(back)),
        "first": (scan().first("x", v), F.first(v, ignorenulls=True).over(ahead)),
        "lag": (scan().lag("x", v), F.lag(v).over(w)),
        "lead": (scan().lead("x", v), F.lead(v).over(w)),
    }
    for got, want in cases.values():
        assert got.split == (one_task == 0)
        same(got.done(), rows.withColumn("x", want), "x")


def test_a_hot_key_spans_all_tasks(rows, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a few thousand rows are one task's
    try:
        scan = Scan(rows, ["key"], ["at"], one_task=0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = scan.rows.where("key = 'hot'").groupBy("_part").count().collect()
    total = scan.rows.select("_part").distinct().count()
    assert total == 4 and len(parts) >= total - 1 and max(p["count"] for p in parts) < 0.6 * rows.count()
    one = rows.withColumn("key", F.lit("x"))
    assert Scan(one, [], ["at"], one_task=0).number("x").done().agg(F.max("x"), F.countDistinct("x")).first()[:] == (4000, 4000)


def test_no_rows(rows):
    assert Scan(rows.limit(0), ["key"], ["at"], one_task=0).number("x").lag("y", F.col("v")).done().count() == 0


def test_leads_over_blocks(rows):
    numbered = Scan(rows, ["key"], ["at"], 0).number("i").done()
    w = Window.partitionBy("key").orderBy("at")
    for block in (1, 7, 10**6):
        got = leads(numbered, ["key"], "i", {"a": (F.col("n"), 1), "b": (F.col("n"), 30)}, block)
        assert got.count() == rows.count()
        same(got, rows.withColumn("a", F.lead("n", 1).over(w)), "a")
        same(got, rows.withColumn("b", F.lead("n", 30).over(w)), "b")


def test_operators_of_a_hot_key(spark, rows):
    """Interpolation, streaks, links, chainage, diagnostics and quantiles are the same in one task and in many."""
    clean = rows.where("key IS NOT NULL")
    ways = clean.select(F.col("key").alias("way"), F.col("at").alias("pos"), F.col("n").cast("double").alias("x"), F.coalesce("v", F.lit(0.0)).alias("y"))
    makes = [
        lambda k: frames.interpolate(clean.select("key", F.col("at").alias("slot"), F.col("v").alias("value")), "key", one_task=k),
        lambda k: frames.congestion_runs(clean, "key", "at", "n", 2.0, one_task=k),
        lambda k: frames.sensor_links(clean, "at", ["key"], "n", lambda a, b: b("n") - a("n"), 9.0, "v", one_task=k),
        lambda k: spatial.chainage(ways, one_task=k),
        lambda k: evaluate.chain_diagnostics(clean, "key", "at", "v", one_task=k, block=10**6 if k else 50),
        lambda k: quantiles(clean, ["key"], "v", (0.0, 0.3, 0.9), one_task=k).select("key", F.concat_ws(",", F.transform("q", lambda x: F.round(x, 9).cast("string")))),
    ]
    for make in makes:
        pick = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
        assert pick(make(0)) == pick(make(10**6))
