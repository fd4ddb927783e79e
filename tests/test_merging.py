"""Loads of files of several versions, and metrics by name."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import stations as O
from roadloom.plans import catalogue
from roadloom.sources import merging as M

LAYOUTS = [M.Layout(r"day_(\d{4})_(\d{2})\.csv$", None, ("year", "month")), M.Layout(r"raw_(\d{4})\.txt$", ("timestamp", "station", "skip", "flow"), ("year",))]
COLUMNS = {"station": ("string", ("station", "Station ID")), "flow": ("double", ("flow", "Total Flow")), "samples": ("int", ("samples",))}


def test_versions_and_quarantine(spark, tmp_path):
    (tmp_path / "day_2020_01.csv").write_text('Station ID,Total Flow,samples\n7,10.5,3\n8,,4\n"9, x","1.5",\n10,abc,5\n,2,2\n11,3\n')
    (tmp_path / "day_2020_02.csv").write_text("samples,station,note,flow\r\n1,7,\"a \"\"b\"\"\",2\r\n2.5,8,n,1\r\n\r\n")
    (tmp_path / "raw_2019.txt").write_text("t0,12,,4.25\nt1,13,,NaN\n")
    (tmp_path / "notes.txt").write_text("not,a,table\n")
    (tmp_path / "old_day_2020_01.csv").write_text("x\n")
    (tmp_path / "day_2020_03.bak").write_text("x\n")
    rows = M.read_merged(spark, str(tmp_path), LAYOUTS, COLUMNS, ["station"], "*[.ct][sx][vt]")
    got = sorted((r.file, r.station, r.flow, r.samples, r.year, r.month) for r in M.good(rows).collect())
    assert got == [
        ("day_2020_01.csv", "7", 10.5, 3, "2020", "01"), ("day_2020_01.csv", "8", None, 4, "2020", "01"), ("day_2020_01.csv", "9, x", 1.5, None, "2020", "01"),
        ("day_2020_02.csv", "7", 2.0, 1, "2020", "02"), ("raw_2019.txt", "12", 4.25, None, "2019", None),
    ]
    bad = {r.line.strip(): r.problems for r in M.quarantined(rows).collect()}
    assert bad == {"10,abc,5": ["flow: abc"], ",2,2": ["station missing"], "11,3": ["2 fields of 3"], "2.5,8,n,1": ["samples: 2.5"], "t1,13,,NaN": ["flow: NaN"]}
    assert len(got) + len(bad) == rows.count()
    with pytest.raises(ValueError, match="no layouts"):
        M.read_merged(spark, str(tmp_path), [], COLUMNS)


def test_first_layout_wins_and_headers_alone(spark, tmp_path):
    (tmp_path / "a_1.csv").write_text("station,flow\n")
    (tmp_path / "a_2.csv").write_text("station,flow,flow\n1,2,2\n")
    rows = M.read_merged(spark, str(tmp_path), [M.Layout(r"a_"), M.Layout(r"a_2", ("x",))], {"flow": ("double", ("flow",))})
    assert [(r.file, r.flow, r.problems) for r in rows.collect()] == [("a_2.csv", 2.0, [])]


def test_texts_are_cast_once_and_lines_stay_where_they_are_read(spark, tmp_path):
    (tmp_path / "day_2020_01.csv").write_text("Station ID,Total Flow,samples\n" + "".join(f"{i},{i}.5,{i}\n" for i in range(300)))
    (tmp_path / "raw_2019.txt").write_text("t0,12,,4.25\n")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        rows = M.read_merged(spark, str(tmp_path), LAYOUTS, COLUMNS, ["station"])
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("try_cast(") == 2 * 2  # numbers x layouts
    assert plan.count("hashpartitioning(") == 1 and "SortMergeJoin" not in plan  # the first lines of files only
    assert rows.agg(F.count("*"), F.sum("samples"), F.sum(F.size("problems"))).first() == (301, 299 * 150, 0)


def test_headers_of_files_in_many_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"day_2020_0{k}.csv").write_text("\n \nsamples,Station ID,Total Flow\n" + "".join(f'{i},"{k}, {i}",{i}.5\n' if i % 2 else f"{i},{k},{i}.5\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = M.read_merged(spark, str(tmp_path), LAYOUTS, COLUMNS, ["station"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file, r.station, r.samples, r.flow, tuple(r.problems)) for r in rows) == sorted((f"day_2020_0{k}.csv", f"{k}, {i}" if i % 2 else f"{k}", i, i + 0.5, ()) for k in range(3) for i in range(200))


def test_repeated_and_second_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Station ID,flow,,station,flow,\n1,2,x,3,2,y\n4\n")
    columns = {"station": ("string", ("", "station", "Station ID")), "flow": ("double", ("none", "flow"))}
    rows = M.read_merged(spark, str(tmp_path), [M.Layout("a")], columns, ["flow"])
    assert sorted((r.station, r.flow, r.problems) for r in rows.collect()) == [("3", 2.0, []), ("4", None, ["1 fields of 6", "flow missing"])]
    (tmp_path / "b.csv").write_text("flow,flow\n1,2\n")
    for layout in (M.Layout("b"), M.Layout("b", ("flow", "flow"))):
        with pytest.raises(Exception, match="(?i)key|two values"):
            M.read_merged(spark, str(tmp_path), [layout], {"flow": ("double", ("flow",))}).collect()


def test_sums_of_cents_do_not_depend_on_the_order(spark, tmp_path):
    rows = [(i % 7, float(i % 5 + 1), -4e13 if i // 14 % 2 else 40000000000000.01, 1 + i % 7, datetime(1994 + i % 2, 3, 4)) for i in range(140)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_linenumber int, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.year: tuple(r)[1:] for r in catalogue.QUERIES["merged_loads"](spark, str(tmp_path)).collect()}
    good = {y: [r for r in rows if r[4].year == y and r[3] not in (3, 5)] for y in (1994, 1995)}
    assert got == {str(y): (50, 10, 10, int(sum(r[1] for r in g)), float(sum(Decimal(str(r[2])) for r in g))) for y, g in good.items()}
    t = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, None), (2, 0.125), (2, 0.25), (3, None), (4, 1e300), (4, -1e300), (5, float("nan"))], "k int, v double")
    sums = {r.k: r.s for r in t.groupBy("k").agg(O.whole_sum(F.col("v"), 100).alias("s")).collect()}
    assert sums[1] == 0.3 and sums[2] == 0.375 and sums[3] is None and sums[4] == 0 and sums[5] != sums[5]


def test_metrics_by_name(spark):
    row = spark.createDataFrame([(2.0, 0.12345, 0.98765, None)], "x_ijt double, density_veh_per_km_lane double, congestion_index double, xijt_saturation double")
    got = row.select(*(S.metric_text(m).alias(m) for m in S.METRIC_COLUMNS)).first().asDict()
    assert got == {"xijt": "2", "density": "0.123", "congestion": "0.9876", "saturation": "0"}
    assert row.select(S.metric_value("saturation")).first()[0] == 0.0 and row.select(S.metric_text("congestion", F.lit(1.0))).first()[0] == "1.0"
    with pytest.raises(ValueError, match="speed"):
        S.metric_value("speed")
