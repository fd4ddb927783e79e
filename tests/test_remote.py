"""Remote reads against a server of our own."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from roadloom.sources import remote


@pytest.fixture(scope="module")
def server():
    files, log = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            data = files.get(self.path)
            if data is None:
                return self.send_error(503)
            asked = self.headers.get("Range")
            a, b = 0, len(data)
            if asked:
                first, last = asked.removeprefix("bytes=").split("-")
                a, b = (int(first), int(last) + 1) if first else (len(data) - int(last), len(data))
            log.append((a, b))
            self.send_response(206 if asked else 200)
            self.send_header("Content-Range", f"bytes {a}-{b - 1}/{len(data)}")
            self.end_headers()
            self.wfile.write(data[a:b])

        def do_POST(self):
            files["/asked"] = self.rfile.read(int(self.headers["Content-Length"]))
            self.do_GET()

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", files, log
    s.shutdown()


def test_merged():
    assert remote.merged([(50, 60), (0, 10), (12, 20), (15, 18)], 5) == [(0, 20), (50, 60)] and remote.merged([]) == []


def test_columns_by_ranges(spark, server):
    url, files, log = server
    n = 40_000
    t = pa.table({f"c{k}": pa.array(range(k, n + k)) for k in range(30)} | {"name": [f"row {i}" for i in range(n)]})
    out = pa.BufferOutputStream()
    pq.write_table(t, out, row_group_size=10_000, compression="none")
    files["/wide.parquet"] = out.getvalue().to_pybytes()
    got = remote.read_columns(spark, f"{url}/wide.parquet", ["c7", "name"]).orderBy("c7").collect()
    assert [tuple(r) for r in got] == [(i + 7, f"row {i}") for i in range(n)]
    assert sum(b - a for a, b in log) < 0.3 * len(files["/wide.parquet"])
    with pytest.raises(ValueError, match="nope"):
        remote.read_columns(spark, f"{url}/wide.parquet", ["nope"])


def test_fallback(server, tmp_path):
    url, files, _ = server
    files["/ok"] = b"{}"
    at = tmp_path / "x.json"
    assert remote.fetch([f"{url}/down", f"{url}/ok"], str(at), remote.roads_query(1, 2, 3, 4)) == f"{url}/ok" and at.read_bytes() == b"{}"
    assert b"highway" in files["/asked"]
    with pytest.raises(OSError, match="down.*gone"):
        remote.fetch([f"{url}/down", f"{url}/gone"], str(at))


def test_data_source(server, spark):
    """Row groups are partitions, columns alone are asked for, and filters rule out row groups by their statistics."""
    url, files, log = server
    table = pa.table({"k": range(40_000), "x": [float(v % 97) for v in range(40_000)], **{f"w{c}": [f"{v * (c + 3)}-{c}" for v in range(40_000)] for c in range(6)}})
    out = pa.BufferOutputStream()
    pq.write_table(table, out, row_group_size=4000)
    files["/t.parquet"] = out.getvalue().to_pybytes()
    remote.register(spark)
    read = lambda **o: spark.read.format("remote_parquet").options(gap=0, **o).load(f"{url}/t.parquet")
    log.clear()
    both = read(columns="k,x")
    assert both.columns == ["k", "x"] and both.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, both.collect())) == [(v, float(v % 97)) for v in range(40_000)]
    asked = sum(b - a for a, b in log)
    assert asked < len(files["/t.parquet"])
    log.clear()
    some = both.where("k >= 30500 AND k < 33000 AND x <> 5")
    assert sorted(r.k for r in some.collect()) == [v for v in range(30_500, 33_000) if v % 97 != 5]
    assert some.rdd.getNumPartitions() == 2 and sum(b - a for a, b in log) < asked
    assert read(columns="k").where("k > 99999").count() == 0 and read().columns == table.schema.names
    with pytest.raises(Exception, match="missing columns: nope"):
        read(columns="k,nope").collect()
