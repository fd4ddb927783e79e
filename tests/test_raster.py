"""Image tiles: pixels against their definition, levels, and pictures that read back."""

import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from roadloom.operators import raster


def read_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        chunks[kind] = body
        at += 12 + size
    width, height, depth, color = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
    assert (depth, color) == (8, 0) and list(chunks) == [b"IHDR", b"IDAT", b"IEND"]
    rows = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, width + 1)
    assert not rows[:, 0].any()
    return rows[:, 1:]


def test_lines_levels_and_pictures(spark):
    r = random.Random(2)
    segments = [(x := r.uniform(-40, 300), y := r.uniform(-40, 300), x + r.uniform(-60, 60), y + r.uniform(-60, 60), float(r.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(segments, "ax double, ay double, bx double, by double, v double")
    pixels = raster.line_pixels(df, 2.0, F.col("v")).collect()
    want: dict[tuple, float] = {}
    for ax, ay, bx, by, v in segments:
        for p in {(int((ax + t / 4000 * (bx - ax)) // 2), int((ay + t / 4000 * (by - ay)) // 2)) for t in range(4001)}:
            want[p] = want.get(p, 0) + v
    got = {(p.px, p.py): p.value for p in pixels}
    assert want.keys() <= got.keys() and len(got) <= 1.02 * len(want) and sum(abs(got[k] - v) for k, v in want.items()) <= 0.02 * sum(want.values())
    levels = raster.pyramid(raster.line_pixels(df, 2.0, F.col("v")), 3)
    up: dict[tuple, float] = {}
    for (x, y), v in got.items():
        for k in range(3):
            up[(k, x >> k, y >> k)] = up.get((k, x >> k, y >> k), 0) + v
    assert {(p.level, p.px, p.py): p.value for p in levels.collect()} == up
    tops = {k: max(v for (q, _, _), v in up.items() if q == k) for k in range(3)}
    seen = 0
    for t in raster.tiles(levels, 32).collect():
        image = read_png(t.png)
        mine = {(x - 32 * t.tx, y - 32 * t.ty): v for (k, x, y), v in up.items() if k == t.level and (x // 32, y // 32) == (t.tx, t.ty)}
        assert image.shape == (32, 32) and t.lit == len(mine) == np.count_nonzero(image) and abs(t.total - sum(mine.values())) < 1e-6
        assert all(image[y, x] == round(55 + 200 * np.log1p(v) / np.log1p(tops[t.level])) for (x, y), v in mine.items())
        seen += len(mine)
    assert seen == len(up)


def test_no_rows_and_no_light(spark):
    none = spark.createDataFrame([], "x int, y int, v double")
    assert raster.tiles(raster.pyramid(raster.point_pixels(none, F.col("x"), F.col("y"), F.col("v")), 2)).count() == 0
    dark = spark.createDataFrame([(1, 1, 0.0), (2, 2, -4.0)], "x int, y int, v double")
    t = raster.tiles(raster.pyramid(raster.point_pixels(dark, F.col("x"), F.col("y"), F.col("v")), 1), 8).first()
    assert t.lit == 0 and not read_png(t.png).any()
