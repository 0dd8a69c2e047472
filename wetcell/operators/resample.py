"""Resampling and regrouping of grids (R). f is the number of fine cells along a coarse cell: a number, or the name of a
column of the fine cells that has it, so that scenes of several ratios make one job.

The coarse side has f * f times fewer rows. It is joined on (scene, r div f, c div f); Spark broadcasts it while its
size allows and shuffles by that key otherwise. Fine cells with the columns of BLOCK (see sources.blocks) have their block
there: they are not moved then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wetcell.storage import durable

BLOCK = ["block_r", "block_c"]
SHIFTS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def ratio(f: int | str) -> Column:
    return F.col(f) if isinstance(f, str) else F.lit(f)


def block_of(name: str, f: int | str) -> Column:
    return F.expr(f"cast({name} div {f} as int)")


def at_block(fine: DataFrame, f: int | str) -> DataFrame:
    """fine with br, bc: the block of each cell."""
    known = set(BLOCK) <= set(fine.columns)
    return fine.withColumns({"br": F.col("block_r") if known else block_of("r", f), "bc": F.col("block_c") if known else block_of("c", f)})


def around(coarse: DataFrame, value: str) -> DataFrame:
    """scene, br, bc and n: the values of the 3 x 3 cells around each cell, null where there is none."""
    shifts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in SHIFTS))
    sent = coarse.filter(F.col(value).isNotNull()).select("scene", "br", "bc", value, F.explode(shifts).alias("s"))
    sent = sent.select("scene", (F.col("br") - F.col("s.i")).alias("br"), (F.col("bc") - F.col("s.j")).alias("bc"), "s", value)
    cells = [F.max(F.when((F.col("s.i") == i) & (F.col("s.j") == j), F.col(value))) for i, j in SHIFTS]
    return sent.groupBy("scene", "br", "bc").agg(F.array(*cells).alias("n"))


def bilinear_up(fine: DataFrame, coarse: DataFrame, f: int | str, value: str, out: str) -> DataFrame:
    """Adds `out`: null unless the parent cell is valid, else the mean of the valid ones of the four nearest coarse cells
    by bilinear weights. fine: scene, r, c, ...; coarse: scene, br, bc, value."""
    near = around(coarse, value).filter(F.col("n")[4].isNotNull())
    rows = at_block(fine, f).join(near, ["scene", "br", "bc"], "left")

    def weights(index: str, block: str) -> list[Column]:
        """Of the coarse cells before, at and after the parent."""
        off = (F.col(index) + 0.5) / ratio(f) - F.col(block) - 0.5
        return [F.greatest(-off, F.lit(0.0)), 1 - F.abs(off), F.greatest(off, F.lit(0.0))]

    wr, wc = weights("r", "br"), weights("c", "bc")
    terms = [(F.col("n")[k], wr[i + 1] * wc[j + 1]) for k, (i, j) in enumerate(SHIFTS)]
    total = reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for v, w in terms])
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in terms])
    return rows.withColumn(out, F.when(F.col("n").isNotNull(), total / weight)).drop("br", "bc", "n")


def nearest_up(fine: DataFrame, coarse: DataFrame, f: int | str, value: str, out: str) -> DataFrame:
    rows = at_block(fine, f)
    return rows.join(coarse.select("scene", "br", "bc", F.col(value).alias(out)), ["scene", "br", "bc"], "left").drop("br", "bc")


def valid_up(fine: DataFrame, coarse: DataFrame, f: int | str, value: str, out: str) -> DataFrame:
    """Whether the parent cell is valid."""
    return nearest_up(fine, coarse.withColumn(value, F.col(value).isNotNull()), f, value, out).withColumn(out, F.coalesce(out, F.lit(False)))


def block_reduce(fine: DataFrame, f: int | str, **aggregates: Column) -> DataFrame:
    """scene, br, bc and any aggregates of the blocks' cells."""
    return at_block(fine, f).groupBy("scene", "br", "bc").agg(*(a.alias(k) for k, a in aggregates.items()))


def average_down(fine: DataFrame, f: int | str, value: str) -> DataFrame:
    return block_reduce(fine, f, **{value: F.avg(value)})


def strict_mean(value: str) -> Column:
    """A mean that a null makes null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def coarsen(fine: DataFrame, f: int | str, value: str, nodata: float) -> DataFrame:
    return average_down(fine.withColumn(value, F.when(F.col(value) != nodata, F.col(value))), f, value)


def bilinear_down(fine: DataFrame, f: int | str, value: str) -> DataFrame:
    """Mean weighted by a triangle of radius f around each coarse centre; nulls ignored."""
    shift = F.array(*map(F.lit, (-1, 0, 1)))
    rows = fine.filter(F.col(value).isNotNull()).withColumn("i", F.explode(shift)).withColumn("j", F.explode(shift))
    rows = rows.withColumn("br", block_of("r", f) + F.col("i")).withColumn("bc", block_of("c", f) + F.col("j"))
    weight = lambda index, block: F.greatest(1 - F.abs((F.col(index) + 0.5) / ratio(f) - F.col(block) - 0.5), F.lit(0.0))
    rows = rows.withColumn("w", weight("r", "br") * weight("c", "bc")).filter("w > 0")
    found = rows.groupBy("scene", "br", "bc").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
    own = fine.select("scene", block_of("r", f).alias("br"), block_of("c", f).alias("bc")).distinct()
    return own.join(found, ["scene", "br", "bc"], "left")


def mosaic(layers: DataFrame, value: str = "v") -> DataFrame:
    """layers: scene, r, c, priority, value. The valid value of the highest priority for each cell (of equal ones the
    largest), combined where the layers are read."""
    order = F.when(F.col(value).isNotNull(), F.struct("priority", value))
    return layers.groupBy("scene", "r", "c").agg(F.max_by(value, order).alias(value))


def union_grid(grids: DataFrame) -> DataFrame:
    """grids: scene, height, width, x0, y0, res_x, res_y, a row a layer. The grid of each scene that covers all its layers."""
    right, bottom = F.col("x0") + F.col("width") * F.col("res_x"), F.col("y0") - F.col("height") * F.col("res_y")
    most = grids.groupBy("scene").agg(
        F.min("x0").alias("x0"), F.max("y0").alias("y0"), F.max(right).alias("_right"), F.min(bottom).alias("_bottom"), F.min("res_x").alias("res_x"), F.min("res_y").alias("res_y"),
    )
    whole = lambda x: F.round(x).cast("int")
    size = {"height": whole((F.col("y0") - F.col("_bottom")) / F.col("res_y")), "width": whole((F.col("_right") - F.col("x0")) / F.col("res_x"))}
    return most.withColumns(size).drop("_right", "_bottom")


def mosaic_placed(layers: DataFrame, grids: DataFrame, value: str = "v", *, tolerance: float = 1e-3) -> DataFrame:
    """The mosaic of layers with grids of their own, on their union_grid(). layers: scene, layer, r, c, value; grids: a row
    for each of them with priority. Raises for a layer whose cells differ in size, or lie off the common cells by more than
    tolerance (a share of a cell), and for a layer without a grid."""
    origin = union_grid(grids).select("scene", F.col("x0").alias("_x"), F.col("y0").alias("_y"), F.col("res_x").alias("_rx"), F.col("res_y").alias("_ry"))
    places = grids.join(origin, "scene").withColumns({"_dr": (F.col("_y") - F.col("y0")) / F.col("_ry"), "_dc": (F.col("x0") - F.col("_x")) / F.col("_rx")})
    off = lambda x: F.abs(F.col(x) - F.round(x)) > tolerance
    stretched = lambda own, common, n: F.abs(F.col(own) / F.col(common) - 1) * F.col(n) > tolerance
    wrong = off("_dr") | off("_dc") | stretched("res_x", "_rx", "width") | stretched("res_y", "_ry", "height")
    places = durable(places.select("scene", "layer", "priority", F.round("_dr").cast("int").alias("_dr"), F.round("_dc").cast("int").alias("_dc"), wrong.alias("_wrong")))
    found = places.filter("_wrong").select("scene", "layer").limit(5).collect()
    if found:
        raise ValueError("cells do not fit the common grid: " + ", ".join(f"{x.scene}/{x.layer}" for x in found))
    rows = layers.join(places, ["scene", "layer"], "left")
    known = lambda x: F.when(F.col(x).isNull(), F.raise_error(F.lit("a layer has no grid"))).otherwise(F.col(x))
    return mosaic(rows.select("scene", (F.col("r") + known("_dr")).alias("r"), (F.col("c") + known("_dc")).alias("c"), "priority", value), value)
