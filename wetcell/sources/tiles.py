"""Layers as tile rows: one row for `side` x `side` cells, the second physical form of cells (scene, layer, r, c, v).

A tile has its cells' places (row-major within the tile) and values as two arrays, and the least and largest row and
column that it holds. Tiles are written in Z-order, so that a file is a compact patch of the grid and the bounds in its
statistics let a clip skip most files and row groups. Sparse layers are as good as dense ones; a null value is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 256
SCHEMA = "scene string, layer string, z long, side int, tr int, tc int, r0 int, r1 int, c0 int, c1 int, places array<int>, values array<double>"


def z_order(row: Column, column: Column, bits: int = 24) -> Column:
    """The bits of both, in turns."""
    bit = lambda x, i, to: F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), to)
    return reduce(Column.bitwiseOR, [part for i in range(bits) for part in (bit(column, i, 2 * i), bit(row, i, 2 * i + 1))])


def to_tiles(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """cells: scene, layer, r, c, v with r, c from 0. One shuffle; a task gathers one tile at a time."""
    tr, tc = F.expr(f"cast(r div {side} as int)").alias("tr"), F.expr(f"cast(c div {side} as int)").alias("tc")
    cell = F.struct((F.col("r") % side * side + F.col("c") % side).alias("p"), F.col("v").cast("double").alias("v"))
    found = cells.groupBy("scene", "layer", tr, tc).agg(
        F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.sort_array(F.collect_list(cell)).alias("cells"),
    )
    return found.select("scene", "layer", z_order(F.col("tr"), F.col("tc")).alias("z"), F.lit(side).alias("side"), "tr", "tc", "r0", "r1", "c0", "c1", F.col("cells.p").alias("places"), F.col("cells.v").alias("values"))


def to_cells(tiles: DataFrame) -> DataFrame:
    """scene, layer, r, c, v."""
    cells = tiles.select("scene", "layer", "side", "tr", "tc", F.explode(F.arrays_zip("places", "values")).alias("x"))
    r, c = F.expr("cast(tr * side + x.places div side as int)"), F.expr("cast(tc * side + x.places % side as int)")
    return cells.select("scene", "layer", r.alias("r"), c.alias("c"), F.col("x.values").alias("v"))


def write_tiles(tiles: DataFrame, path: str, *, files: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet by scene and layer, in Z-order over files (as many as the session's shuffle partitions if not given)."""
    by = ["scene", "layer", "z"]
    ordered = tiles.repartitionByRange(*by) if files is None else tiles.repartitionByRange(files, *by)
    ordered.sortWithinPartitions(*by).write.mode(mode).partitionBy("scene", "layer").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def clip_tiles(tiles: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """The cells of rows top to bottom and columns left to right (ends included), with their own r, c. The bounds of tiles
    are compared with constants, so the comparison reaches the Parquet scan."""
    near = tiles.filter((F.col("r1") >= top) & (F.col("r0") <= bottom) & (F.col("c1") >= left) & (F.col("c0") <= right))
    return to_cells(near).filter(F.col("r").between(top, bottom) & F.col("c").between(left, right))
