"""Writers: tables, key-value summaries, JSON payloads, GeoJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), fmt: str = "parquet") -> None:
    """A table; CSV has a header, and quotes inside quoted fields are doubled. Rows are dealt by the partition columns first, so each folder gets few files."""
    df = df.repartition(*partition) if partition else df
    w = df.write.mode("overwrite").partitionBy(*partition) if partition else df.write.mode("overwrite")
    w.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else w.format(fmt).save(path)


def write_list(df: DataFrame, column: str, path: str) -> None:
    """A plain list: one value a line, sorted; no line at all where there is no value."""
    df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"), F.col(column).alias("_at")).orderBy("_at").select("value").write.mode("overwrite").text(path)


def summary_lines(one: DataFrame) -> DataFrame:
    """value: one `name: value` line per column of a one-row frame, in column order."""
    names = one.columns
    lines = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in names))
    return one.select(F.posexplode(lines).alias("pos", "value")).orderBy("pos").select("value")


def summary_json(one: DataFrame) -> DataFrame:
    return one.select(F.to_json(F.struct(*one.columns), {"ignoreNullFields": "false"}).alias("value"))


def progress_line(name: str, i: int, n: int, elapsed: float) -> str:
    """A console line of step i of n, i from 1, with the time that is left if steps go on as the i - 1 before."""
    left = elapsed * (n - (i - 1)) / (i - 1) if i > 1 else None
    return f"{name} {i}/{n} ({100 * i // n} %)" + (f", about {left:.0f} s left" if left is not None else "")


def html_page(title: str, payloads: Sequence[str]) -> str:
    """A page that draws the features of `window.NETWORK` by longitude and latitude; payloads are scripts such as `js_payload` gives."""
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    script = "".join(f"<script>{p.replace('</', '<\\/')}</script>" for p in payloads)
    draw = (
        "const c=document.getElementById('map'),g=c.getContext('2d'),f=(window.NETWORK||{features:[]}).features,p=f.flatMap(x=>x.geometry.coordinates);"
        "const a=i=>p.reduce((m,q)=>[Math.min(m[0],q[i]),Math.max(m[1],q[i])],[1e9,-1e9]),[x0,x1]=a(0),[y0,y1]=a(1),s=Math.min(c.width/(x1-x0||1),c.height/(y1-y0||1));"
        "f.forEach(x=>{g.beginPath();x.geometry.coordinates.forEach((q,i)=>g[i?'lineTo':'moveTo']((q[0]-x0)*s,c.height-(q[1]-y0)*s));g.stroke()});"
    )
    return f"<!doctype html><meta charset=utf-8><title>{safe}</title><h1>{safe}</h1><canvas id=map width=1200 height=800></canvas>{script}<script>{draw}</script>"


def js_payload(df: DataFrame, name: str, column: str = "value") -> DataFrame:
    return df.select(F.concat(F.lit(f"window.{name} = "), F.col(column), F.lit(";")).alias("value"))


def feature(geometry: Column, properties: Sequence[str], digits: int = 7) -> Column:
    """A GeoJSON LineString feature as text; coordinates rounded half to even."""
    line = F.transform(geometry, lambda p: F.array(F.bround(p["x"], digits), F.bround(p["y"], digits)))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def station_payload(stations: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """key, payload: a station's metadata with its values by slot, as JSON; stations without values have an empty map."""
    flows = series.groupBy(key).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda s: F.struct(s["slot"].cast("string"), s["value"]))).alias("flows"))
    return stations.join(flows, key, "left").select(key, F.to_json(F.struct(*stations.columns, F.coalesce("flows", F.create_map().cast("map<string,double>")).alias("flows")), {"ignoreNullFields": "false"}).alias("payload"))
