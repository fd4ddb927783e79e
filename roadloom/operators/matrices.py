"""Matrices as tiles: time x sensor values in blocks that carry their bounds, so that a reader takes only what it asks for.

A tile covers HEIGHT rows and WIDTH columns and holds its cells in order of place, row by row, as two arrays: places and
values. Its bounds are columns of their own, so that a filter on them is a filter on the file's statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEIGHT, WIDTH = 288, 64


def to_tiles(rows: DataFrame, row: str, col: str, value: str, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """tile_row, tile_col, row_lo, row_hi, col_lo, col_hi, places, values of long rows with numbered rows and columns.

    A tile has height x width cells at most, so none outgrows a task; cells without a row, or with a null, are left out.
    Of a cell's rows the largest value stays.
    """
    r, c = F.col(row).cast("bigint"), F.col(col).cast("bigint")
    at = lambda v, n: F.floor(v / F.lit(n))
    cells = rows.where(F.col(value).isNotNull()).select(at(r, height).alias("tile_row"), at(c, width).alias("tile_col"), r.alias("_r"), c.alias("_c"), F.col(value).cast("double").alias("_v"))
    cells = cells.groupBy("tile_row", "tile_col", "_r", "_c").agg(F.max("_v").alias("_v"))
    place = ((F.col("_r") - F.col("tile_row") * height) * width + F.col("_c") - F.col("tile_col") * width).cast("int")
    tiles = cells.groupBy("tile_row", "tile_col").agg(
        F.min("_r").alias("row_lo"), F.max("_r").alias("row_hi"), F.min("_c").alias("col_lo"), F.max("_c").alias("col_hi"), F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("_v").alias("v")))).alias("_cells")
    )
    return tiles.select("tile_row", "tile_col", "row_lo", "row_hi", "col_lo", "col_hi", F.col("_cells.p").alias("places"), F.col("_cells.v").alias("values"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """One range of rows and columns a file, tiles in order, so that a file's statistics are narrow."""
    tiles.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col").write.parquet(path)


def to_long(tiles: DataFrame, row: str = "row", col: str = "col", value: str = "value", height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    cell = tiles.select("tile_row", "tile_col", F.explode(F.arrays_zip("places", "values")).alias("c"))
    return cell.select((F.col("tile_row") * height + F.floor(F.col("c.places") / width)).alias(row), (F.col("tile_col") * width + F.col("c.places") % width).alias(col), F.col("c.values").alias(value))


def rows_between(tiles: DataFrame, lo: int, hi: int, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """Cells of rows lo to hi - 1; the tiles' bounds reach the scan as filters."""
    mine = tiles.where((F.col("row_hi") >= lo) & (F.col("row_lo") < hi))
    return to_long(mine, height=height, width=width).where((F.col("row") >= lo) & (F.col("row") < hi))


def columns_of(tiles: DataFrame, columns: Sequence[int], height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """Tiles of the chosen columns alone, each at its new place: column k of the result is the k-th of `columns`.

    Only tiles with one of the columns are read; their cells are dealt anew, in tiles of the same size. A column that is
    asked for twice comes twice.
    """
    if not columns:
        return tiles.limit(0)
    wanted = F.map_from_entries(F.array(*(F.struct(F.lit(int(c)), F.array(*(F.lit(k) for k, x in enumerate(columns) if x == c))) for c in sorted(set(columns)))))
    mine = tiles.where(F.col("tile_col").isin(sorted({c // width for c in columns})))
    cells = to_long(mine, height=height, width=width).where(F.col("col").isin(sorted(set(columns)))).withColumn("col", F.explode(wanted[F.col("col").cast("int")]))
    return to_tiles(cells, "row", "col", "value", height, width)


def day_of_tiles(tiles: DataFrame, day: int, frames: int = 288, step: int = 288, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """Cells of one day, whose rows are day * step to day * step + step - 1; fails unless it has exactly `frames` rows."""
    out = rows_between(tiles, day * step, (day + 1) * step, height, width)
    n = out.select("row").distinct().count()
    if n != frames:
        raise ValueError(f"day {day} has {n} frames; {frames} are needed")
    return out
