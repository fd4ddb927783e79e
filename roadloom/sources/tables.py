"""Readers: CSV in unknown encodings, header-less station files, metadata, map extracts, wide Parquet, raw listings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.scalars import fold_fields

ENCODINGS = ("utf-8", "gbk", "iso-8859-1")
#: Columns that one aggregate takes.
WIDE = 200
#: Column names of header-less station files, by position.
STATION_DAY = "timestamp station district route direction_of_travel lane_type station_length samples percentage_observed total_flow delay_35 delay_40 delay_45 delay_50 delay_55 delay_60".split()
STATION_5MIN = "timestamp station district freeway direction_of_travel lane_type station_length samples percentage_observed total_flow average_occupancy average_speed".split() + [
    f"lane{k}_{c}" for k in range(1, 9) for c in ("samples", "flow", "average_occupancy", "average_speed", "observed")
]
METADATA = "station freeway direction district county city state_postmile absolute_postmile latitude longitude length type lanes name user_id_1 user_id_2 user_id_3 user_id_4".split()
#: Highway classes that carry no motor traffic.
NOT_ROADS = ("bridleway", "bus_stop", "construction", "corridor", "cycleway", "elevator", "footway", "path", "pedestrian", "platform", "proposed", "raceway", "steps")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length of the files under a folder, empty ones too, in any file system Spark reads.

    The driver asks the file system, as it does before every scan; readers of files leave empty ones out.
    """
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    found, rows = at.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getPath().getName(), f.getLen()))
    return spark.createDataFrame(sorted(rows), "path string, name string, length long").where(~F.col("name").rlike("^[._].*(crc|SUCCESS)$"))


def find_file(spark: SparkSession, folder: str, candidates: Sequence[str]) -> str | None:
    """The first candidate that exists: exact names first, then without regard to case."""
    names = {r.name: r.path for r in listing(spark, folder).select("name", "path").collect()}
    lower = {k.lower(): v for k, v in sorted(names.items(), reverse=True)}
    return next((names[c] for c in candidates if c in names), None) or next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def require_sources(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Fails naming every file that is not there."""
    there = {r.name for r in listing(spark, folder).select("name").collect()}
    if missing := [n for n in names if n not in there]:
        raise FileNotFoundError(", ".join(missing))


def _decoded(spark: SparkSession, df: DataFrame, encoding: str) -> DataFrame:
    """Columns that were read as iso-8859-1, which keeps every byte, in their real encoding.

    Readers and decode() refuse gbk unless a session setting allows it. An expression keeps what it was made with, so
    the setting is put back at once.
    """
    if encoding == ENCODINGS[-1]:
        return df
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        out = df.select(*(F.decode(F.encode(F.col(f"`{c}`"), "ISO-8859-1"), encoding).alias(c) for c in df.columns))
        out.schema  # noqa: B018
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return out


def _bytes(spark: SparkSession, path: str):
    return spark.read.option("encoding", "ISO-8859-1")


def sniff(spark: SparkSession, path: str) -> str:
    """The first encoding in which no line of the file has a replacement character; a file is searched until one is found."""
    lines = _bytes(spark, path).csv(path, schema="v string", sep="\u0001", quote="")
    key, malformed = "spark.sql.legacy.codingErrorAction", None
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # decode() gives replacement characters instead of failing
    try:
        for e in ENCODINGS[:-1]:
            malformed = _decoded(spark, lines, e).where(F.col("v").contains("�"))
            if malformed.isEmpty():
                return e
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return ENCODINGS[-1]


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """All columns as text, or as `types` says; header names trimmed, unnamed and blank columns left out, malformed lines dropped.

    Quotes inside quoted fields are doubled, and nothing else is an escape, so no byte of a two-byte character is one.
    """
    encoding = sniff(spark, path)
    df = _bytes(spark, path).option("mode", "DROPMALFORMED").option("escape", '"').csv(path, header=True)
    blank = [f"_c{i}" == c for i, c in enumerate(df.columns)]  # how the reader names a column without a name, at its place
    names = [c if encoding == ENCODINGS[-1] else c.encode("latin-1").decode(encoding) for c in df.columns]
    names = [c.replace("\ufeff", "").strip() for c in names]
    df = df.toDF(*(f"_{i}" for i in range(len(names))))
    keep = [i for i, c in enumerate(names) if c and not blank[i] and not c.startswith("Unnamed")]
    df = _decoded(spark, df.select(*(F.col(f"_{i}") for i in keep)), encoding).toDF(*(names[i] for i in keep))
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items() if c in df.columns}) if types else df


def read_positional(spark: SparkSession, path: str, names: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """A header-less CSV by column names; only `keep` is parsed. A row of one field or none is left out."""
    rows = spark.read.text(path).where(F.regexp_replace("value", '"[^"]*"', "").contains(","))  # a separator outside quotes
    fields = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"escape": '"'})
    return rows.select(fields.alias("_f")).select(*(F.col(f"_f.`{n}`").alias(n) for n in (keep or names)))


def read_hour(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, station, samples, total_flow, average_speed of positional hour files; absent trailing fields are null."""
    f = F.split("value", ",")
    rows = spark.read.text(path).where(F.size(f) > 1)
    num = lambda i, t: F.get(f, F.lit(i)).try_cast(t)
    return rows.select(F.get(f, F.lit(0)).alias("timestamp"), F.get(f, F.lit(1)).alias("station"), num(7, "int").alias("samples"), num(9, "double").alias("total_flow"), num(11, "double").alias("average_speed"), F.col("_metadata.file_name").alias("file"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Tab-delimited metadata of 18 fields, rows brought to that many; the header line of each file is left out."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    rows = rows.where(~F.lower("value").startswith("id\t") & (F.trim("value") != "")).withColumn("f", fold_fields(F.split("value", "\t")))
    date = F.regexp_extract("source_file", r"(\d{4})_(\d{2})_(\d{2})", 0)
    return rows.select(F.translate(date, "_", "-").alias("metadata_date"), "source_file", *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(METADATA)))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """way, highway, name, pos, lon, lat of road ways with inline geometry of at least two points."""
    schema = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    e = e.where((F.col("type") == "way") & F.col("tags")["highway"].isNotNull() & ~F.col("tags")["highway"].isin(*NOT_ROADS) & (F.size("geometry") >= 2))
    return e.select(F.col("id").alias("way"), F.col("tags")["highway"].alias("highway"), F.col("tags")["name"].alias("name"), F.posexplode("geometry").alias("pos", "p")).select("way", "highway", "name", "pos", "p.lon", "p.lat")


def read_ways_by_node(spark: SparkSession, path: str) -> DataFrame:
    """As read_ways, for extracts whose ways list node ids; unknown nodes are left out and the order is kept."""
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,nodes:array<bigint>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    ways = e.where((F.col("type") == "way") & F.col("tags")["highway"].isNotNull() & ~F.col("tags")["highway"].isin(*NOT_ROADS))
    ways = ways.select(F.col("id").alias("way"), F.col("tags")["highway"].alias("highway"), F.col("tags")["name"].alias("name"), F.posexplode("nodes").alias("pos", "node"))
    nodes = e.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    return ways.join(nodes, "node").select("way", "highway", "name", "pos", "lon", "lat")


def with_row_index(spark: SparkSession, path: str, name: str = "node_id") -> DataFrame:
    """A Parquet table with its row ordinal as a column, for tables whose key is only their order."""
    return spark.read.parquet(path).select(F.col("_metadata.row_index").alias(name), "*")


def column_stats(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, min, max, nulls of sensor columns with a positive maximum.

    Columns are aggregated in place, WIDE at a time, each group reading its own columns only; a Parquet scan skips the rest.
    Nothing is turned into a row a cell, and a group's result is one row, turned afterwards.
    """
    out = None
    for lo in range(0, len(columns), WIDE):
        part = list(columns[lo : lo + WIDE])
        one = table.agg(*(f.alias(f"{k}{i}") for i, c in enumerate(part) for k, f in (("a", F.min(F.col(f"`{c}`").cast("double"))), ("b", F.max(F.col(f"`{c}`").cast("double"))), ("n", F.count_if(F.col(f"`{c}`").isNull())))))
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(part)))).alias("s")
        found = one.select(rows).select("s.*").where(F.col("max") > 0)
        out = found if out is None else out.unionByName(found)
    return out


def footer_stats(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """name, min, max, nulls, rows of number columns of a Parquet table, from the files' footers alone.

    Minima, maxima and counts are pushed into the scan, whose tasks read footers and combine the row groups' statistics;
    no data page is read. A column for which a row group has no statistics (one with NaN, say) is aggregated by a scan of
    its pages, and it alone. Plans are made in a session of its own, as the push-down is a setting; what comes to the
    driver is one row a WIDE columns.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")

    def one(session: SparkSession, part: list[str]) -> list[tuple]:
        r = session.read.parquet(path).agg(F.count("*").alias("rows"), *(f(f"`{c}`").alias(f"{k}{i}") for i, c in enumerate(part) for k, f in (("a", F.min), ("b", F.max), ("n", F.count)))).first()
        number = lambda v: None if v is None else float(v)
        return [(c, number(r[f"a{i}"]), number(r[f"b{i}"]), r["rows"] - r[f"n{i}"], r["rows"]) for i, c in enumerate(part)]

    def found(part: list[str]) -> list[tuple]:
        try:
            return one(own, part)
        except Exception as e:  # Spark's error where a row group has no minimum, maximum or count
            if not re.search(r"[Nn]o (min/max|number of nulls) (found )?for", str(e)):
                raise
        half = len(part) // 2
        return found(part[:half]) + found(part[half:]) if half else one(spark, part)

    rows = [r for lo in range(0, len(columns), WIDE) for r in found(list(columns[lo : lo + WIDE]))]
    return spark.createDataFrame(rows, "name string, min double, max double, nulls long, rows long")


def line_summary(spark: SparkSession, path: str) -> DataFrame:
    """file, lines, first, last non-blank line; a line's place is its offset in the file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    at = F.struct("b", "k")
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.min_by("value", at).alias("first"), F.max_by("value", F.when(F.trim("value") != "", at)).alias("last"))


def manifest(files: DataFrame, pattern: str = r"(\d{4})_(\d{2})(?:_(\d{2}))?") -> DataFrame:
    """name, year, month, day, length of raw files; a name without a date fails where it is read."""
    part = lambda i: F.nullif(F.regexp_extract("name", pattern, i), F.lit("")).try_cast("int")
    return files.select("name", part(1).alias("year"), part(2).alias("month"), part(3).alias("day"), "length")


def day_slice(rows: DataFrame, ts: str, day: str, frames: int = 288) -> DataFrame:
    """Rows of [day, day + 1), a range that reaches the scan; fails unless the day has exactly `frames` times."""
    out = rows.where((F.col(ts) >= F.lit(day).cast("timestamp_ntz")) & (F.col(ts) < F.expr(f"timestamp_ntz '{day}' + interval 1 day")))
    n = out.select(ts).distinct().count()
    if n != frames:
        raise ValueError(f"{day} has {n} frames; {frames} are needed")
    return out


def matched_geometry(rows: DataFrame, key: str, geometry: str, ordinal: str) -> DataFrame:
    """key, points: JSON coordinate lists of at least two points; of a key's rows the last one counts."""
    points = F.transform(F.from_json(geometry, "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    ok = rows.withColumn("_points", points).where(F.size("_points") >= 2)
    return ok.groupBy(key).agg(F.max_by("_points", ordinal).alias("points"))


def metric_flow(metric: str, occupancy: DataFrame | None, counts: DataFrame) -> tuple[DataFrame, str]:
    """The flow behind a metric, and what it is based on: occupancy for density and congestion where there is one."""
    if metric in ("density", "congestion") and occupancy is not None:
        return occupancy.withColumn("x", F.col("avg_vehicles")).withColumn("flow_basis", F.lit("time_weighted_occupancy")), "time_weighted_occupancy"
    return counts.withColumn("flow_basis", F.lit("period_count")), "period_count"
