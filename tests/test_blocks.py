"""Tiled matrices, payloads in pieces, factorised neighbours and footer statistics."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators import matrices, payloads, topology
from roadloom.sources import tables


def test_tiles_round_trip(spark, tmp_path):
    r = random.Random(0)
    cells = {(r.randint(0, 999), r.randint(0, 199)): round(r.uniform(-5, 5), 3) for _ in range(5000)}
    rows = spark.createDataFrame([(a, b, v) for (a, b), v in cells.items()] + [(1000, 3, None)], "row long, col long, value double")
    tiles = matrices.to_tiles(rows, "row", "col", "value", 100, 16)
    matrices.write_tiles(tiles, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.agg(F.max(F.size("values"))).first()[0] <= 1600
    assert {(x.row, x.col): x.value for x in matrices.to_long(back, height=100, width=16).collect()} == cells
    some = matrices.rows_between(back, 150, 290, 100, 16)
    assert {(x.row, x.col): x.value for x in some.collect()} == {k: v for k, v in cells.items() if 150 <= k[0] < 290}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_hi,150)" in plan and "LessThan(row_lo,290)" in plan
    chosen = [17, 3, 160, 3]
    got = matrices.to_long(matrices.columns_of(back, chosen, 100, 16), height=100, width=16)
    assert {(x.row, x.col): x.value for x in got.collect()} == {(a, k): v for (a, b), v in cells.items() for k, c in enumerate(chosen) if b == c}
    assert matrices.columns_of(back, [], 100, 16).count() == 0


def test_day_of_tiles(spark):
    rows = spark.range(3 * 288).select(F.col("id").alias("row"), F.lit(5).alias("col"), (F.col("id") * 0.5).alias("value")).where("row <> 300")
    tiles = matrices.to_tiles(rows, "row", "col", "value")
    assert matrices.day_of_tiles(tiles, 2).agg(F.min("row"), F.max("row")).first()[:] == (576, 863)
    with pytest.raises(ValueError, match="287"):
        matrices.day_of_tiles(tiles, 1)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_pieces_join_to_the_whole(spark, one_task):
    r = random.Random(1)
    rows = [(("big" if r.random() < 0.8 else f"f{k % 3}"), k, r.randint(0, 10**6)) for k in range(3000)]
    df = spark.createDataFrame(rows, "frame string, id int, v int").repartition(5)
    cut = payloads.pieces(df, "frame", "id", payloads.pair("id", F.col("v").cast("string")), 500, one_task)
    found: dict[str, list] = {}
    for p in cut.orderBy("frame", "piece").collect():
        part = json.loads(p.body)
        assert len(part) == p.entries and (part[0][0], part[-1][0]) == (p.first, p.last) and p.bytes == len(p.body) < 500 + 25
        found.setdefault(p.frame, []).extend(part)
    want: dict[str, list] = {}
    for f, k, v in sorted(rows, key=lambda x: x[1]):
        want.setdefault(f, []).append([k, v])
    assert found == want
    listed = {x.frame: json.loads(x["index"]) for x in payloads.index(cut, "frame").collect()}
    assert [x["piece"] for x in listed["big"]] == list(range(len(listed["big"]))) and sum(x["entries"] for x in listed["big"]) == len(want["big"])


def test_durations_and_facts(spark):
    rows = [(0, 1, 1.0), (0, 2, 0.5), (1, 1, 1.5), (1, 2, 2.0), (2, 2, 1.0), (3, 1, 1.0)]
    flow = spark.createDataFrame(rows, "time_bin int, edge int, v double")
    got = {x.time_bin: json.loads(x.body) for x in payloads.durations(flow, "time_bin", "edge", "v", 1.0).collect()}
    assert got == {0: [[1, 1]], 1: [[1, 2], [2, 1]], 2: [[2, 2]], 3: [[1, 1]]}
    facts = {x.time_bin: x for x in payloads.frame_facts(flow, "time_bin", "v", "v", 5, 4).collect()}
    assert facts[1][1:] == (5, 10, 2, 0.5, 2, 0.5, 3.5, 1.75, 1.975, 2.0) and facts[0].congested_share == 0.25
    assert payloads.frame_facts(flow, "time_bin", "v", "v", 5, 0).first().active_share == 0.0


def test_neighbors_of_a_hub(spark):
    """A hub of 300 edges: its lists are cut, and expanded they give the pairs of the joins."""
    edges = spark.createDataFrame([(k, 0 if k % 3 else k, k if k % 3 else 0, float(k)) for k in range(1, 300)] + [(900, 5, 0, None)], "edge long, from long, to long, length double")
    blocks = topology.neighbor_blocks(edges, 32)
    assert blocks.agg(F.max(F.size("edges"))).first()[0] == 32 and blocks.where("node = 0").count() == 11
    got, want = topology.expand_neighbors(blocks), topology.edge_neighbors(edges)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()


def test_footer_statistics(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") * -1.5).alias("b"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("c"), F.when(F.col("id") == 7, float("nan")).otherwise(F.col("id").cast("double")).alias("d"), F.lit(None).cast("int").alias("e"))
    path = str(tmp_path / "t")
    rows.repartition(3).write.parquet(path)
    got = {x.name: (x.min, x.max, x.nulls, x.rows) for x in tables.footer_stats(spark, path, ["a", "b", "c"]).collect()}
    assert got == {"a": (0.0, 999.0, 0, 1000), "b": (-1498.5, 0.0, 0, 1000), "c": (0.0, 996.0, 750, 1000)}
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    mixed = {x.name: (x.min, x.max, x.nulls, x.rows) for x in tables.footer_stats(spark, path, ["a", "d", "e"]).collect()}  # d and e have no bounds in their footers
    assert mixed["a"] == got["a"] and mixed["d"][0] == 0.0 and math.isnan(mixed["d"][1]) and mixed["e"] == (None, None, 1000, 1000)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == before
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.useV1SourceList", "csv")
    plan = own.read.parquet(path).agg(F.min("a"), F.max("a"), F.count("a"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(a), MAX(a), COUNT(a)]" in plan
