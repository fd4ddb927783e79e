"""What keeps one task's memory and time from growing with the tables."""

from pyspark.sql import functions as F

from roadloom.operators import chains
from roadloom.plans import catalogue
from roadloom.sources import tables


def test_line_facts_writes_parts(spark, sf, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen, summary = [], tables.line_summary
    monkeypatch.setattr(tables, "line_summary", lambda s, path: seen.append(path) or summary(s, path))
    try:
        got = catalogue.QUERIES["line_facts"](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.text(seen[0]).select(F.col("_metadata.file_name")).distinct().count() > 1
    assert [tuple(r) for r in got] == [(1500, "line 0", "line 1499")]


def test_way_chainage_sorts_once(spark, sf):
    df = catalogue.QUERIES["way_chainage"](spark, sf)
    assert df._jdf.queryExecution().sparkPlan().toString().count("Window") >= 2
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 1


def test_gibbs_chain_sends_no_labels(spark, sf, monkeypatch):
    seen, summary = [], chains.chain_summary
    monkeypatch.setattr(chains, "chain_summary", lambda draws, burn: seen.append(draws) or summary(draws, burn))
    got = catalogue.QUERIES["gibbs_chain"](spark, sf).collect()
    assert sorted({r.quantity for r in got}) == ["mean_lambda", "pi", "size"]
    assert seen[0].count() == 2 * 40 * 6  # chains, iterations, three quantities of two clusters
