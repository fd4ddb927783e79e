"""Shared plumbing of the training-data operators: checkpoints, shipping, Arrow maps, Bloom filters."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
#: Rows and bytes of one Arrow batch handed to Python; documents may be long, so both are kept low.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Largest Bloom filter, in bits (16 MiB): the proven bound of what `Bloom` broadcasts.
BLOOM_BITS_MAX = 1 << 27
_PAGE = 1 << 13


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches bounded, the package shipped and a checkpoint folder set."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)
    _ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own, with a local master only."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if at is None and sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc._jsc.sc().getCheckpointDir().get()
    if at is None:
        at = spark.conf.get("roadloom.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            at = "file://" + tempfile.mkdtemp(prefix="roadloom-")
            spark.conf.set("roadloom.checkpoint.dir", at)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that a later step rereads."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of `table_path` that nothing reads any more."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors where PYTHONPATH doesn't already lead to it."""
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    sc = spark.sparkContext
    if any(p and Path(p).resolve() == ROOT for p in places) or getattr(sc, "_roadloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="roadloom-")) / "roadloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in (ROOT / "roadloom").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._roadloom_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    session(df)
    return df.checkpoint(eager=True)


def one_thread() -> None:
    """Keep BLAS to the task's core; takes effect where the library is not loaded yet."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(k, "1")


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict] | dict | None]], schema: str) -> DataFrame:
    """mapInArrow where `make()` is called once a task and its result once a batch; columns come back as a dict."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    session(df)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            if b.num_rows:
                out = each(b)
                for o in [out] if isinstance(out, dict) else out or ():
                    yield pa.RecordBatch.from_arrays([_column(o[f.name], f.type) for f in arrow], schema=arrow)
        for o in getattr(each, "close", tuple)() or ():
            yield pa.RecordBatch.from_arrays([_column(o[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, keys: list[str], each, schema: str) -> DataFrame:
    """each(columns of one group as lists) -> dict of columns, over groups that are small enough for a task's memory."""

    def make():
        held: dict[str, list] = {}

        def batch(b):
            cols = {k: b.column(k).to_pylist() for k in b.schema.names}
            marks = list(zip(*(cols[k] for k in keys), strict=True))
            start = 0
            for i in range(1, len(marks) + 1):
                if i == len(marks) or marks[i] != marks[start]:
                    if held and tuple(held[k][0] for k in keys) != marks[start]:
                        yield each(dict(held))
                        held.clear()
                    for k, v in cols.items():
                        held.setdefault(k, []).extend(v[start:i])
                    start = i

        def close():
            if held:
                yield each(dict(held))

        batch.close = close
        return batch

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), make, schema)


def attach(docs: DataFrame, column, fields: list[str]) -> DataFrame:
    """All columns of `docs` and the fields of a struct column; a field replaces a column of its name."""
    mine = [c for c in docs.columns if c.lower() not in {f.lower() for f in fields}]
    name = "_attached"
    while name in docs.columns:
        name += "_"
    out = docs.select(*(docs[f"`{c}`"] for c in mine), column.alias(name))
    return out.select(*(F.col(f"`{c}`") for c in mine), *(F.col(f"{name}.{f}").alias(f) for f in fields))


def held_out(doc_id) -> object:
    """True for rows whose crc32(doc_id as text) mod 3 is 1; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def sample_by_class(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """At most `most` rows (doc_id, kind) of each class, the first by a hash of doc_id.

    Classes are counted, and a hash threshold lets about four times `most` of each through before rows are ranked,
    so that no task ranks a whole class.
    """
    unit = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    rows = rows.select("doc_id", kind).withColumn("h", unit)
    share = {r[kind]: min(1.0, 4.0 * most / r["n"]) for r in rows.groupBy(kind).agg(F.count("*").alias("n")).collect()}
    if not share:
        return rows.select("doc_id", kind)
    limit = F.coalesce(*(F.when(F.col(kind) == k, F.lit(v)) for k, v in sorted(share.items(), key=str)))
    nth = F.row_number().over(Window.partitionBy(kind).orderBy("h", "doc_id"))
    return rows.where(F.col("h") <= limit).withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", kind)


def bits_of(hi: np.ndarray, lo: np.ndarray, bits: int, hashes: int = 4) -> np.ndarray:
    """Bit positions (hashes x n) of 128-bit keys by double hashing; bits is a power of two."""
    a, b = hi.astype(np.uint64), lo.astype(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) >> np.uint64(17) & np.uint64(bits - 1) for i in range(1, hashes + 1)])


class Bloom:
    """A Bloom filter over 128-bit keys, at most BLOOM_BITS_MAX bits, so that it may be broadcast.

    Beyond about ten million keys it saturates and lets more rows through; callers join afterwards,
    so that costs shuffled bytes and never a result.
    """

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8) if data is None else data

    @staticmethod
    def size_for(n: int) -> int:
        return min(BLOOM_BITS_MAX, max(1 << 16, 1 << int(16 * max(n, 1) - 1).bit_length()))

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        at = bits_of(hi, lo, self.bits).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        at = bits_of(hi, lo, self.bits)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    @classmethod
    def build(cls, keys: DataFrame) -> Bloom:
        """From columns hi, lo (long). Each task emits the pages it touched; pages are OR-ed by a shuffle."""
        bits = cls.size_for(keys.count())

        def make():
            mine = cls(bits)

            def each(b):
                d = b.to_pydict()
                mine.add(np.array(d["hi"], np.int64), np.array(d["lo"], np.int64))

            def close():
                pages = mine.data.reshape(-1, min(_PAGE, mine.data.size))
                used = np.flatnonzero(pages.any(axis=1))
                if len(used):
                    yield {"page": used.tolist(), "data": [pages[i].tobytes() for i in used]}

            each.close = close
            return each

        def merge(pdf):
            return pdf.iloc[:1].assign(data=[np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf.data]).tobytes()])

        found = map_arrow(keys.select("hi", "lo"), make, "page long, data binary").groupBy("page").applyInPandas(merge, "page long, data binary").collect()
        out = cls(bits)
        step = min(_PAGE, out.data.size)
        for r in found:
            out.data[r.page * step : (r.page + 1) * step] = np.frombuffer(r.data, np.uint8)
        return out

    def column(self, spark: SparkSession, hi: str, lo: str):
        """A boolean column: may the key be present? Only the two longs cross to Python."""
        shared, bits = spark.sparkContext.broadcast(self.data), self.bits

        @F.pandas_udf("boolean")
        def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(Bloom(bits, shared.value).has(a.to_numpy(), b.to_numpy()))

        return maybe(hi, lo)


one_thread()
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
