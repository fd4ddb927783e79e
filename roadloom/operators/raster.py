"""Maps and heat maps as pyramids of image tiles: values are summed by pixel, levels by four pixels of the one below."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators.spatial import covered

#: Pixels of a tile's side.
SIDE = 256


def line_pixels(segments: DataFrame, pixel: float, value: Column) -> DataFrame:
    """px, py, value: every pixel that a segment (ax, ay, bx, by) passes gets its value; what falls on one pixel is summed."""
    at = F.explode(covered(*(F.col(c) for c in ("ax", "ay", "bx", "by")), pixel)).alias("p")
    return _summed(segments.select(at, value.cast("double").alias("value")).select(F.col("p.cx").alias("px"), F.col("p.cy").alias("py"), "value"))


def point_pixels(rows: DataFrame, px: Column, py: Column, value: Column) -> DataFrame:
    """px, py, value: sums of values by pixel, as of a heat map of keys against frames."""
    return _summed(rows.select(px.cast("bigint").alias("px"), py.cast("bigint").alias("py"), value.cast("double").alias("value")))


def _summed(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("px", "py").agg(F.sum("value").alias("value"))


def pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """level, px, py, value: the pixels themselves at level 0, and at each further level sums over twice the width and height.

    A pixel goes to all its levels at once and sums combine before the shuffle, so the data is read once."""
    up = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level")).alias(c)
    return pixels.select("px", "py", "value", up).select("level", at("px"), at("py"), "value").groupBy("level", "px", "py").agg(F.sum("value").alias("value"))


def png(gray: np.ndarray) -> bytes:
    """A grey image of 8 bits (rows x columns) as PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((gray.shape[0], gray.shape[1] + 1), np.uint8)  # each row begins with its filter, 0
    rows[:, 1:] = gray
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def tiles(levels: DataFrame, side: int = SIDE) -> DataFrame:
    """level, tx, ty, lit, total, png of each tile that has a pixel: its lit pixels, their sum, and the picture.

    A tile holds side x side pixels at most, so none outgrows a task. Brightness is the logarithm of a pixel's value against
    the largest of its level, from 55 for the least that is shown to 255; pixels of value 0 or less stay dark.
    """
    top = levels.groupBy("level").agg(F.max("value").alias("top"))
    at = lambda c: F.floor(F.col(c) / side)
    place = ((F.col("py") - at("py") * side) * side + F.col("px") - at("px") * side).cast("int")
    grouped = levels.groupBy("level", at("px").alias("tx"), at("py").alias("ty")).agg(F.count_if(F.col("value") > 0).alias("lit"), F.sum("value").alias("total"), F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("value").alias("v")))).alias("_cells"))

    @F.arrow_udf("binary")
    def drawn(places: pa.Array, values: pa.Array, tops: pa.Array) -> pa.Array:
        out = []
        for p, v, t in zip(places, values, tops, strict=True):
            image, v = np.zeros(side * side, np.uint8), np.array(v.as_py(), float)
            most = np.log1p(t.as_py()) if t.as_py() > 0 else 1.0
            image[p.as_py()] = np.where(v > 0, np.rint(55 + 200 * np.log1p(np.maximum(v, 0)) / most), 0)
            out.append(png(image.reshape(side, side)))
        return pa.array(out, pa.binary())

    rows = grouped.join(F.broadcast(top), "level")  # a row a level
    return rows.select("level", "tx", "ty", "lit", "total", drawn(F.col("_cells.p"), F.col("_cells.v"), "top").alias("png"))
