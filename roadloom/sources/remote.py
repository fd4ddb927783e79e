"""Remote files over HTTP: Parquet files by byte ranges as a data source, and downloads that fall back to other endpoints."""

from __future__ import annotations

import io
import threading
import time
import urllib.parse
import urllib.request
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Ranges no farther apart are asked for as one; requests at once; tries of each.
GAP, THREADS, TRIES = 64 << 10, 4, 4


def _get(url: str, start: int | None = None, end: int | None = None, tries: int = TRIES, timeout: float = 120) -> tuple[bytes, Mapping]:
    """Bytes start..end - 1 (the last -start ones where start is negative), tried again where the transport fails or is short."""
    asked = {} if start is None else {"Range": f"bytes={start}-{end - 1}" if start >= 0 else f"bytes={start}"}
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=asked), timeout=timeout) as r:
                data = r.read()
                if asked and r.status != 206:
                    raise OSError(f"{url} answers no ranges")
                if start is not None and start >= 0 and len(data) != end - start:
                    raise OSError(f"{len(data)} bytes for {end - start}")
                return data, r.headers
        except OSError:
            if attempt == tries - 1:
                raise
            time.sleep(min(2**attempt, 12) / 4)
    raise AssertionError


def merged(ranges: Sequence[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """Sorted ranges (start, end) where those that overlap or are at most `gap` apart are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class RangeFile(io.RawIOBase):
    """A remote file that is read by ranges; what `hold` asked for stays in memory until the file is closed."""

    def __init__(self, url: str, gap: int = GAP, threads: int = THREADS):
        self.url, self.gap, self.threads, self.at = url, gap, threads, 0
        tail, headers = _get(url, -8)
        self.size = int(headers["Content-Range"].rsplit("/", 1)[1])
        self.starts, self.parts = [self.size - len(tail)], [tail]
        self.requests = 1

    def hold(self, ranges: Sequence[tuple[int, int]]) -> None:
        todo = merged(ranges, self.gap)
        with ThreadPoolExecutor(self.threads) as pool:
            for (a, _), data in zip(todo, pool.map(lambda r: _get(self.url, *r)[0], todo), strict=True):
                k = bisect_right(self.starts, a)
                self.starts.insert(k, a)
                self.parts.insert(k, data)
        self.requests += len(todo)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.size, self.at + n)
        k = bisect_right(self.starts, self.at) - 1
        if k < 0 or self.starts[k] + len(self.parts[k]) < end:
            self.hold([(self.at, end)] if end > self.at else [])
            k = bisect_right(self.starts, self.at) - 1
        data = self.parts[k][self.at - self.starts[k] : end - self.starts[k]] if end > self.at else b""
        self.at += len(data)
        return data


def _open(url: str, gap: int, threads: int):
    """The file and its footer, which two requests bring."""
    import pyarrow.parquet as pq

    f = RangeFile(url, gap, threads)
    length = int.from_bytes(f.parts[0][:4], "little")
    f.hold([(f.size - length - 8, f.size)])
    return f, pq.ParquetFile(f)


def _chunks(meta, group: int, columns: Sequence[str]) -> list[tuple[int, int]]:
    out = []
    for i in range(meta.num_columns):
        c = meta.row_group(group).column(i)
        if c.path_in_schema.split(".")[0] in columns:
            start = min(x for x in (c.dictionary_page_offset, c.data_page_offset) if x)
            out.append((start, start + c.total_compressed_size))
    return out


def read_columns(spark: SparkSession, url: str, columns: Sequence[str], gap: int = GAP, threads: int = THREADS) -> DataFrame:
    """Columns of a remote Parquet file whose server answers byte ranges, one task a row group.

    The driver reads the footer alone. A task asks for its group's chunks of those columns, neighbouring ones together, so
    that a few columns of a wide file cost their own bytes. For stores that Spark reads itself, spark.read.parquet does this.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    _, file = _open(url, gap, threads)
    names = list(columns)
    if missing := [c for c in names if c not in file.schema_arrow.names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = from_arrow_schema(file.schema_arrow.empty_table().select(names).schema)
    groups = file.metadata.num_row_groups

    def run(batches):
        for b in batches:
            for g in b.column("id").to_pylist():
                f, own = _open(url, gap, threads)
                f.hold(_chunks(own.metadata, g, names))
                yield from own.read_row_group(g, columns=names).select(names).to_batches()

    return spark.range(0, groups, 1, max(1, groups)).mapInArrow(run, schema)


class RemoteGroup(InputPartition):
    """A row group of a remote file."""

    def __init__(self, url: str, group: int):
        self.url, self.group = url, group


#: Comparisons that a row group's statistics can rule out: may a value v of [lo, hi] pass against x?
_MAY = {
    EqualTo: lambda lo, hi, x: lo <= x <= hi,
    GreaterThan: lambda lo, hi, x: hi > x,
    GreaterThanOrEqual: lambda lo, hi, x: hi >= x,
    LessThan: lambda lo, hi, x: lo < x,
    LessThanOrEqual: lambda lo, hi, x: lo <= x,
    In: lambda lo, hi, x: any(lo <= v <= hi for v in x),
}


class _RemoteReader(DataSourceReader):
    def __init__(self, urls: Sequence[str], columns: Sequence[str], gap: int, threads: int):
        self.urls, self.columns, self.gap, self.threads, self.filters = list(urls), list(columns), gap, threads, []

    def pushFilters(self, filters):  # noqa: N802, the interface's name
        """All filters are left to Spark as well: statistics rule out row groups, not rows."""
        self.filters = [f for f in filters if type(f) in _MAY and len(f.attribute) == 1]
        yield from filters

    def _may_hold(self, group) -> bool:
        bounds = {c.path_in_schema: c.statistics for c in (group.column(i) for i in range(group.num_columns)) if c.statistics is not None and c.statistics.has_min_max}
        for f in self.filters:
            s = bounds.get(f.attribute[0])
            try:
                if s is not None and not _MAY[type(f)](s.min, s.max, f.value):
                    return False
            except TypeError:  # kinds that don't compare
                continue
        return True

    def partitions(self) -> list[RemoteGroup]:
        out = []
        for url in self.urls:
            meta = _open(url, self.gap, self.threads)[1].metadata
            out += [RemoteGroup(url, g) for g in range(meta.num_row_groups) if self._may_hold(meta.row_group(g))]
        return out or [RemoteGroup("", -1)]

    def read(self, partition: RemoteGroup):
        if partition.group < 0:
            return
        f, file = _open(partition.url, self.gap, self.threads)
        f.hold(_chunks(file.metadata, partition.group, self.columns))
        yield from file.read_row_group(partition.group, columns=self.columns).select(self.columns).to_batches()


class RemoteParquet(DataSource):
    """spark.read.format("remote_parquet"): columns of Parquet files behind HTTP servers that answer byte ranges.

    Options: `path`, the URLs, separated by blanks; `columns`, names separated by commas (all if absent); `gap`, `threads`.
    A partition is a row group; groups whose statistics rule out a filter are not asked for; a task asks for the chunks of
    the columns alone. Register with `register(spark)`.
    """

    @classmethod
    def name(cls) -> str:
        return "remote_parquet"

    def _urls(self) -> list[str]:
        return self.options["path"].split()

    def _columns(self, schema) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else list(schema.names)

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        own = _open(self._urls()[0], GAP, THREADS)[1].schema_arrow
        names = self._columns(own)
        if missing := [c for c in names if c not in own.names]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return from_arrow_schema(own.empty_table().select(names).schema)

    def reader(self, schema) -> _RemoteReader:
        return _RemoteReader(self._urls(), schema.names, int(self.options.get("gap", GAP)), int(self.options.get("threads", THREADS)))


def register(spark: SparkSession) -> None:
    """Make format("remote_parquet") known to a session, filters reaching it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteParquet)


class Served:
    """A file of any file system that Spark reads, behind a range server on the driver: a stand-in for a remote store.

    Use as a context; `url` is its address on the driver's host, `sent` the bytes that were asked for.
    """

    def __init__(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        size, outer = fs.getFileStatus(at).getLen(), self
        self.sent, self.size = 0, size

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802, the interface's name
                first, last = self.headers["Range"].removeprefix("bytes=").split("-")
                a, b = (int(first), int(last) + 1) if first else (size - int(last), size)
                stream = fs.open(at)
                try:
                    stream.seek(a)
                    data = bytes(stream.readNBytes(b - a))
                finally:
                    stream.close()
                outer.sent += len(data)
                self.send_response(206)
                self.send_header("Content-Range", f"bytes {a}-{b - 1}/{size}")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        host = sc.getConf().get("spark.driver.host", "127.0.0.1")
        self.server = ThreadingHTTPServer((host, 0), Handler)
        self.url = f"http://{host}:{self.server.server_address[1]}/"

    def __enter__(self) -> Served:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.server.shutdown()
        self.server.server_close()


def fetch(endpoints: Sequence[str], path: str, form: Mapping[str, str] | None = None, timeout: float = 120) -> str:
    """Write what the first endpoint that answers gives to a local path, and return that endpoint; fails naming all errors."""
    body, errors = urllib.parse.urlencode(form).encode() if form else None, []
    for url in endpoints:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body), timeout=timeout) as r:
                data = r.read()
        except OSError as e:
            errors.append(f"{url}: {e}")
            continue
        with open(path, "wb") as f:
            f.write(data)
        return url
    raise OSError("; ".join(errors) or "no endpoints")


def roads_query(south: float, west: float, north: float, east: float, timeout: int = 180) -> dict[str, str]:
    """The form that asks a map service for all road ways of a box, with their points."""
    return {"data": f'[out:json][timeout:{timeout}];(way["highway"]({south:.7f},{west:.7f},{north:.7f},{east:.7f}););out tags geom;'}
