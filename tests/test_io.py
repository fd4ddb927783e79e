"""Readers, writers, spatial matching and streaming."""

import heapq
import json
import random

from pyspark.sql import functions as F

from roadloom.operators import spatial, topology
from roadloom.sources import sinks, tables
from roadloom.streaming import flows


def test_csv_encodings(spark, tmp_path):
    for name, enc in (("a.csv", "utf-8-sig"), ("b.csv", "gbk")):
        (tmp_path / name).write_bytes(" id , name ,Unnamed: 2\n1,道路,x\n2,b,y\n".encode(enc))
        got = tables.read_csv(spark, str(tmp_path / name))
        assert got.columns == ["id", "name"] and [r.name for r in got.collect()] == ["道路", "b"]


def test_late_bytes_and_odd_headers(spark, tmp_path):
    """The first character that tells the encoding may stand anywhere; headers that only begin like nameless ones stay."""
    lines = ["_code,_c9,,name,Unnamed: 4"] + [f"{k},b,x,plain,y" for k in range(400)] + ["400,b,x,道路\"边\",y"]
    (tmp_path / "late.csv").write_bytes("\n".join(lines).encode("gbk"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    got = tables.read_csv(spark, str(tmp_path / "late.csv"))
    assert got.columns == ["_code", "_c9", "name"] and got.where("_code = 400").first()["name"].startswith("道路")
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    (tmp_path / "utf.csv").write_bytes("\n".join(lines).encode())
    assert tables.read_csv(spark, str(tmp_path / "utf.csv")).where("_code = 400").first()["name"].startswith("道路")


def test_rows_with_an_empty_second_field(spark, tmp_path):
    (tmp_path / "day.txt").write_text('t1,,11,5\n"a,b"\nend\nt2,7,11,5\n')
    rows = tables.read_positional(spark, str(tmp_path), ["timestamp", "station", "district"]).collect()
    assert [(r.timestamp, r.station) for r in rows] == [("t1", None), ("t2", "7")]


def test_quantiles(spark):
    import numpy as np

    from roadloom.operators.quantiles import quantiles

    r = random.Random(3)
    rows = [(k % 3 if k % 11 else None, None if k % 7 == 0 else float(r.choice([1, 2, 2, 5, 9, r.random()]))) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    at = (0.0, 0.1, 0.5, 0.95, 1.0)
    for key in (0, 1, 2, None):
        want = np.quantile([v for k, v in rows if k == key and v is not None], at)
        got = [x.q for x in quantiles(df, ["k"], "v", at).collect() if x.k == key]
        assert np.allclose(got[0], want)
    assert np.allclose(quantiles(df, [], "v", at).first().q, np.quantile([v for _, v in rows if v is not None], at))


def test_cells_of_a_segment(spark):
    """Every cell that a point of the segment is in, and no more than its length needs."""
    r = random.Random(9)
    rows = [(k, *(r.uniform(-40, 40) for _ in range(4))) for k in range(150)] + [(900, 1.0, -9.0, 1.0, 20.0), (901, -3.0, 4.0, 25.0, 4.0), (902, 2.0, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, ax double, ay double, bx double, by double")
    got = {x.id: {tuple(c) for c in x.c} for x in df.select("id", spatial.covered(*(F.col(c) for c in ("ax", "ay", "bx", "by")), 5.0).alias("c")).collect()}
    for k, ax, ay, bx, by in rows:
        at = {(int((ax + t / 999 * (bx - ax)) // 5), int((ay + t / 999 * (by - ay)) // 5)) for t in range(1000)}
        assert at <= got[k] and len(got[k]) <= len(at) + 4


def settled(edges, source):
    """Label-setting search: node -> (distance, level, predecessor), the predecessor settled first."""
    near, queue, done, n = {}, [(0.0, 0, source, 0, source)], {}, 0
    for a, b, w in edges:
        near.setdefault(a, []).append((b, 1.0 if w is None else w))
    while queue:
        d, level, u, _, p = heapq.heappop(queue)
        if u not in done:
            done[u] = d, level, p
            for v, w in near.get(u, ()):
                n += 1
                heapq.heappush(queue, (d + w, level + 1 if w == 0 else 0, v, n, u))
    return done


def route(edges, source, target, budget):
    done = settled(edges, source)
    if target not in done or done[target][0] > budget:
        return (), None
    path = [target]
    while path[-1] != source:
        path.append(done[path[-1]][2])
    return tuple(path[::-1]), done[target][0]


def check_routes(spark, edges, asked):
    e = spark.createDataFrame(edges, "from long, to long, length double")
    got = {(x.source, x.target, x.budget): (tuple(x.path), x.cost) for x in topology.routes(spark.createDataFrame(asked, "source long, target long, budget double"), e).collect()}
    assert got == {a: route(edges, *a) for a in asked}
    return got


def test_routes_against_a_search(spark):
    """Ties, edges of no length (in circles too) and missing lengths on random graphs."""
    for seed in range(3):
        r = random.Random(seed)
        edges = [(a, b, float(r.choice([0, 0, 1, 2, 3]) if seed else r.randint(1, 9))) for a in range(25) for b in r.sample(range(25), 3) if a != b] + [(0, 1, None)]
        check_routes(spark, edges, [(a, (a * 7 + 3) % 27, b) for a in range(0, 25, 3) for b in (3.0, 40.0)])


def test_routes_keep_the_predecessor_settled_first(spark):
    got = check_routes(spark, [(1, 9, 1.0), (1, 3, 2.0), (9, 20, 2.0), (3, 20, 1.0)], [(1, 20, 9.0)])
    assert got[(1, 20, 9.0)] == ((1, 9, 20), 3.0)
    got = check_routes(spark, [(5, 2, 0.0), (2, 3, 0.0), (3, 2, 0.0)], [(5, 3, 1.0), (5, 5, 0.0)])
    assert got[(5, 3, 1.0)] == ((5, 2, 3), 0.0)


def test_nearest_nodes_against_a_search(spark):
    r = random.Random(11)
    edges = [(a, b, float(r.randint(0, 9))) for a in range(30) for b in r.sample(range(30), 3) if a != b]
    e, nodes = spark.createDataFrame(edges, "from long, to long, length double"), spark.range(0, 30, 3).toDF("node")
    for radius in (None, 9.0):
        want = set()
        for s in range(0, 30, 3):
            order = sorted((d, u) for u, (d, _, _) in settled(edges, s).items() if u != s and (radius is None or d <= radius))
            want |= {(s, u, d, n + 1) for n, (d, u) in enumerate(order if radius else order[:4])}
        assert {tuple(x) for x in topology.k_nearest(nodes, e, 4, radius).collect()} == want


def test_run_names(spark):
    from roadloom.operators import selection

    assert selection.next_name("a", []) == "a" and selection.next_name("a", ["a", "a_2"]) == "a_3"
    lines = selection.report(spark.createDataFrame([(1.0, "x"), (3.0, "x"), (None, "y")], "v double, k string"), ["v"], ["k"])
    assert "  mean: 2.0" in lines and "  p50: 2.0" in lines and lines[-2:] == ["  x: 2", "  y: 1"]


def test_finding_files(spark, tmp_path):
    (tmp_path / "Node.CSV").write_text("x")
    assert tables.find_file(spark, str(tmp_path), ["node.csv"]).endswith("Node.CSV") and tables.find_file(spark, str(tmp_path), ["link.csv"]) is None
    tables.require_sources(spark, str(tmp_path), ["Node.CSV"])
    try:
        tables.require_sources(spark, str(tmp_path), ["a", "Node.CSV", "b"])
        raise AssertionError
    except FileNotFoundError as e:
        assert str(e) == "a, b"


def test_station_files(spark, tmp_path):
    (tmp_path / "d11_text_station_hour_2020_01.txt").write_text("01/01/2020 00:00:00,1100,11,5,N,ML,0.5,10,90,123.5,0.1,61\nbad\n01/01/2020 01:00:00,1100,11,5,N,ML,0.5\n")
    rows = tables.read_hour(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r.samples, r.total_flow, r.average_speed) for r in rows] == [(10, 123.5, 61.0), (None, None, None)]
    assert len(tables.STATION_5MIN) == 52 and len(tables.STATION_DAY) == 16
    day = tables.read_positional(spark, str(tmp_path), tables.STATION_DAY, ["station", "samples"])
    assert day.count() == 2 and day.columns == ["station", "samples"]
    s = tables.line_summary(spark, str(tmp_path)).first()
    assert s.lines == 3 and s.first.startswith("01/01/2020 00") and s.last.startswith("01/01/2020 01")


def test_metadata(spark, tmp_path):
    fields = "\t".join(map(str, range(20)))
    (tmp_path / "d11_text_meta_2020_03_04.txt").write_text("ID\tFwy\n" + fields + "\n7\t5\n")
    rows = tables.read_metadata(spark, str(tmp_path)).orderBy("station").collect()
    assert [(r.station, r.name, r.metadata_date) for r in rows] == [("0", "13 14 15", "2020-03-04"), ("7", "", "2020-03-04")]


def test_ways(spark, tmp_path):
    at = lambda i: {"lat": 1.0 * i, "lon": 2.0 * i}
    e = [{"type": "way", "id": 1, "tags": {"highway": "primary", "name": "A"}, "geometry": [at(0), at(1)]}, {"type": "way", "id": 2, "tags": {"highway": "footway"}, "geometry": [at(0), at(1)]}, {"type": "way", "id": 3, "tags": {"highway": "primary"}, "geometry": [at(0)]}]
    (tmp_path / "w.json").write_text(json.dumps({"elements": e}))
    assert [(r.way, r.pos, r.lon) for r in tables.read_ways(spark, str(tmp_path / "w.json")).orderBy("pos").collect()] == [(1, 0, 0.0), (1, 1, 2.0)]
    e = [{"type": "node", "id": 5, **at(1)}, {"type": "node", "id": 6, **at(2)}, {"type": "way", "id": 9, "tags": {"highway": "primary"}, "nodes": [6, 4, 5]}]
    (tmp_path / "n.json").write_text(json.dumps({"elements": e}))
    assert [(r.pos, r.lat) for r in tables.read_ways_by_node(spark, str(tmp_path / "n.json")).orderBy("pos").collect()] == [(0, 2.0), (2, 1.0)]


def test_wide_tables(spark, tmp_path):
    spark.createDataFrame([(1.0, None, 0.0), (3.0, 2.0, 0.0)], "a double, b double, c double").coalesce(1).write.parquet(str(tmp_path / "w"))
    t = tables.with_row_index(spark, str(tmp_path / "w"))
    assert sorted(r.node_id for r in t.collect()) == [0, 1]
    got = {r.name: (r.min, r.max, r.nulls) for r in tables.column_stats(t, ["a", "b", "c"]).collect()}
    assert got == {"a": (1.0, 3.0, 0), "b": (2.0, 2.0, 1)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_table(df, str(tmp_path / "p"), ["k"])
    assert (tmp_path / "p" / "k=1").is_dir() and spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_table(df, str(tmp_path / "c"), fmt="csv")
    one = df.agg(F.count("*").alias("n"), F.max("v").alias("top"))
    assert [r.value for r in sinks.summary_lines(one).collect()] == ["n: 2", "top: b"]
    assert json.loads(sinks.summary_json(one).first().value) == {"n": 2, "top": "b"}
    assert sinks.js_payload(sinks.summary_json(one), "DATA").first().value.startswith("window.DATA = {")
    series = spark.createDataFrame([(1, 3, 2.5)], "k int, slot int, value double")
    got = {r.k: json.loads(r.payload) for r in sinks.station_payload(df, series, "k").collect()}
    assert got[1]["flows"] == {"3": 2.5} and got[2]["flows"] == {}


def test_nearest_against_brute_force(spark):
    r = random.Random(0)
    pts = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(300)]
    seg = [(w, 0, x, y, x + r.uniform(-90, 90), y + r.uniform(-90, 90)) for w, (_, x, y) in enumerate(pts[100:])]
    q = spark.createDataFrame(pts[:100], "id int, x double, y double")
    s = spark.createDataFrame(seg, "way int, seg int, ax double, ay double, bx double, by double")

    def dist(px, py, ax, ay, bx, by):
        d2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d2))
        return ((px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by - ay)) ** 2) ** 0.5

    want = {}
    for i, x, y in pts[:100]:
        d, w = min((dist(x, y, *g[2:]), g[0]) for g in seg)
        if d <= 50:
            want[i] = w
    assert {v.id: v.way for v in spatial.nearest_segments(q, s, 50.0).collect()} == want


def test_sublines(spark):
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"), F.lit(float(x)).alias("at")) for x in (0, 10, 20, 30)))
    df = spark.range(1).select(pts.alias("p"))
    cut = lambda a, b: [v["x"] for v in df.select(spatial.subline("p", F.lit(float(a)), F.lit(float(b))).alias("s")).first().s]
    assert cut(5, 25) == [5, 10, 20, 25] and cut(25, 5) == [25, 20, 10, 5] and cut(12, 13) == [12, 13] and cut(0, 30) == [0, 10, 20, 30]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = flows.edge_flow_stream(stream, "ts", "user_id", "event_type").writeStream.format("memory").queryName("flow").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r["from"], r.to): r.x for r in spark.table("flow").collect()}
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "30 minutes").start.alias("start"), F.col("user_id").alias("from"), F.col("event_type").alias("to")).count()
    assert got == {(r.start, r["from"], r.to): float(r["count"]) for r in batch.collect()}
    q = flows.frame_stream(stream, "ts", "user_id", "value").writeStream.format("memory").queryName("frames").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("frames").count() > 0


def test_day_slice_and_metric_source(spark):
    rows = spark.sql("select timestamp_ntz '2019-07-31' + make_interval(0,0,0,0,0,5*id,0) as ts, id from range(400)")
    assert tables.day_slice(rows, "ts", "2019-07-31").count() == 288
    try:
        tables.day_slice(rows, "ts", "2019-08-01")
        raise AssertionError
    except ValueError as e:
        assert "112" in str(e)
    occ, n = spark.createDataFrame([(1, 2.5)], "edge int, avg_vehicles double"), spark.createDataFrame([(1, 9.0)], "edge int, x double")
    assert tables.metric_flow("density", occ, n)[0].first().x == 2.5 and tables.metric_flow("rate", occ, n)[1] == "period_count" and tables.metric_flow("density", None, n)[1] == "period_count"


def test_way_graph(spark):
    pts = [(1, 0, 0.0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 3.0, 4.0), (2, 0, 1.0, 0.0, 3.0, 4.0), (2, 1, 1.0, 0.0, 3.0, 4.0), (2, 2, 2.0, 0.0, 6.0, 8.0)]
    g = topology.way_graph(spark.createDataFrame(pts, "way int, pos int, lon double, lat double, x double, y double")).collect()
    assert len(g) == 4 and all(r.length == 5 for r in g) and len({r["from"] for r in g}) == 3
