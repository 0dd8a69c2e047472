"""Grids as tables: schemas, reading and writing of layers, and conversions.

cells: scene, layer, r, c, v (null: nodata; row 0 is north). grids: one row per layer with its georeference.
A wide frame has one column per layer: scene, r, c, dem, wse, ...
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODATA = -9999.0
KEY = ["scene", "r", "c"]
CELLS = T.StructType([
    T.StructField("scene", T.StringType()), T.StructField("layer", T.StringType()), T.StructField("r", T.IntegerType()),
    T.StructField("c", T.IntegerType()), T.StructField("v", T.DoubleType()),
])
GRIDS = "scene string, layer string, height int, width int, x0 double, y0 double, res_x double, res_y double, crs string, nodata double"


def from_embeddings(vectors: DataFrame, scene_rows: int | None = None) -> DataFrame:
    """A terrain grid: row r is a vector, column c a component, dem its value in thousandths. scene_rows cuts scenes."""
    cells = vectors.select("vec_id", F.posexplode("embedding").alias("c", "x"))
    scene = F.lit("emb") if scene_rows is None else F.concat(F.lit("s"), F.expr(f"vec_id div {scene_rows}").cast("string"))
    row = F.col("vec_id") if scene_rows is None else F.col("vec_id") % scene_rows
    return cells.select(scene.alias("scene"), row.cast("int").alias("r"), "c", (F.round(F.col("x").cast("double") * 1000) + 0.0).alias("dem"))  # no -0.0


def from_orders(orders: DataFrame, width: int = 256) -> DataFrame:
    """A terrain grid of order prices."""
    return orders.select(F.lit("ord").alias("scene"), F.expr(f"cast(o_orderkey div {width} as int)").alias("r"), (F.col("o_orderkey") % width).cast("int").alias("c"), F.round("o_totalprice").cast("double").alias("dem"))


def coarse_water(fine: DataFrame, f: int) -> DataFrame:
    """A coarse water surface over the terrain: block means, dry in a pattern of tiles. scene, br, bc, wse."""
    blocks = fine.groupBy("scene", F.expr(f"r div {f}").cast("int").alias("br"), F.expr(f"c div {f}").cast("int").alias("bc")).agg(F.sum("dem").alias("total"))
    wet = F.expr("((br div 5) + (bc div 4)) % 2 = 0")
    return blocks.select("scene", "br", "bc", F.when(wet, F.floor(F.col("total") / float(f * f)).cast("double")).alias("wse"))


def read_layer(spark: SparkSession, path: str, *, nodata: float = NODATA) -> DataFrame:
    """Cells of Parquet layers; the sentinel and NaN become null."""
    return normalised(spark.read.schema(CELLS).parquet(path), nodata=nodata)


def normalised(cells: DataFrame, *, nodata: float = NODATA) -> DataFrame:
    return cells.withColumn("v", F.when((F.col("v") != nodata) & ~F.isnan("v"), F.col("v")))


def write_layer(cells: DataFrame, path: str, *, nodata: float | None = NODATA, mode: str = "errorifexists") -> None:
    """Parquet by scene and layer; null is written as the sentinel unless nodata is None."""
    rows = cells if nodata is None else cells.fillna(nodata, subset=["v"])
    rows.write.mode(mode).partitionBy("scene", "layer").parquet(path)


def phase_name(phase: str, layer: str, height: int, width: int) -> str:
    return f"{phase}_{layer}_{height:04d}x{width:04d}"


def write_phase(cells: DataFrame, root: str, phase: str, layer: str, height: int, width: int) -> str:
    """An intermediate layer under its phase's name; refuses to overwrite."""
    path = f"{root}/{phase_name(phase, layer, height, width)}"
    cells.write.mode("errorifexists").parquet(path)
    return path


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").csv(path, header=True)


def listing(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """case, phase, layer, path of the files below root/case/phase/layer."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    parts = F.split("path", "/")
    return files.select(*(F.element_at(parts, -4 + i).alias(name) for i, name in enumerate(("case", "phase", "layer"))), "path")


def profile(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Shape, valid cells and bounds of each layer."""
    seen = cells.groupBy("scene", "layer").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"), F.count("v").alias("valid"))
    bounds = {"left": F.col("x0"), "right": F.col("x0") + F.col("width") * F.col("res_x"), "top": F.col("y0"), "bottom": F.col("y0") - F.col("height") * F.col("res_y")}
    return grids.join(seen, ["scene", "layer"], "left").withColumns(bounds)


def from_text(lines: DataFrame, *, sep: str = ",") -> DataFrame:
    """lines: scene, r, line. Cells of a text matrix."""
    return lines.select("scene", "r", F.posexplode(F.split(F.trim("line"), sep)).alias("c", "v")).withColumn("v", F.trim("v").cast("double"))


def to_rows(cells: DataFrame, value: str) -> DataFrame:
    """One array per grid row, in column order."""
    packed = F.array_sort(F.collect_list(F.struct("c", value)))
    return cells.groupBy("scene", "r").agg(F.transform(packed, lambda x: x[value]).alias("values"))


def from_rows(rows: DataFrame, value: str) -> DataFrame:
    return rows.select("scene", "r", F.posexplode("values").alias("c", value))


def empty_like(spark: SparkSession, scene: str, height: int, width: int, value: float | None = None) -> DataFrame:
    """A dense grid of one value."""
    return spark.range(height * width).select(F.lit(scene).alias("scene"), F.expr(f"cast(id div {width} as int)").alias("r"), F.expr(f"cast(id % {width} as int)").alias("c"), F.lit(value).cast("double").alias("v"))


def clip(cells: DataFrame, grid: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Cells whose centres are in the box, with new indexes from 0. grid: the layer's row of grids."""
    place = cells.join(grid.select("scene", "x0", "y0", "res_x", "res_y"), "scene")
    x, y = F.col("x0") + (F.col("c") + 0.5) * F.col("res_x"), F.col("y0") - (F.col("r") + 0.5) * F.col("res_y")
    inside = place.filter((x >= left) & (x <= right) & (y >= bottom) & (y <= top))
    first_c, first_r = F.ceil((F.lit(left) - F.col("x0")) / F.col("res_x") - 0.5), F.ceil((F.col("y0") - F.lit(top)) / F.col("res_y") - 0.5)
    moved = inside.withColumn("r", (F.col("r") - F.greatest(first_r, F.lit(0))).cast("int")).withColumn("c", (F.col("c") - F.greatest(first_c, F.lit(0))).cast("int"))
    return moved.select(*cells.columns)


def decimate(cells: DataFrame, height: int, width: int, rows: int, columns: int) -> DataFrame:
    """The nearest-index cells of a display of rows x columns, as r, c of the display."""
    spark = cells.sparkSession
    pick = lambda n, size, name: spark.range(n).select(F.col("id").cast("int").alias(f"d{name}"), F.round(F.col("id") * ((size - 1) / max(1, n - 1))).cast("int").alias(name))
    shown = cells.join(pick(rows, height, "r"), "r").join(pick(columns, width, "c"), "c")
    return shown.drop("r", "c").withColumnsRenamed({"dr": "r", "dc": "c"})
