"""Rainfall floods: a shallow layer of water is taken off before downscaling and put back after it (X3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetcell.functions import cell
from wetcell.operators import checks, metrics, regions, resample
from wetcell.plans import growth
from wetcell.storage import durable


#: how the fine cells' terrain becomes that of coarse cells, by name
COARSE_TERRAIN = {
    "average": resample.average_down, "bilinear": resample.bilinear_down,
    "min": lambda fine, f, v: resample.block_reduce(fine, f, **{v: F.min(v)}), "max": lambda fine, f, v: resample.block_reduce(fine, f, **{v: F.max(v)}),
    "median": lambda fine, f, v: resample.block_reduce(fine, f, **{v: F.median(v)}),
}


def coarse_depth(fine: DataFrame, coarse: DataFrame, f: int, *, dem_coarse_resampling: str = "average") -> DataFrame:
    """coarse with dem (of the fine cells by a method of COARSE_TERRAIN, unless it is there) and wsh. A coarse terrain made
    from the fine one is poor on steep slopes: give coarse cells dem or wsh where they are known."""
    if dem_coarse_resampling not in COARSE_TERRAIN:
        raise ValueError(f"dem_coarse_resampling {dem_coarse_resampling!r}, not one of {', '.join(COARSE_TERRAIN)}")
    if "dem" not in coarse.columns:
        coarse = coarse.join(COARSE_TERRAIN[dem_coarse_resampling](fine, f, "dem"), ["scene", "br", "bc"], "left")
    return coarse.withColumn("wsh", cell.depth(F.col("wse"), F.col("dem")))


def prepared(coarse: DataFrame, *, filter_depth: float | None = 0.1, mode_buffer: float = 0.01, small_pixel_count: int = 5, filter_method: str = "blanket") -> DataFrame:
    """coarse: scene, br, bc, wse, wsh. Adds depth, blanket, filtered (without the blanket) and wse_in (without small
    groups either). filter_depth None takes the mode of the depths plus a buffer. Raises if nothing is filtered or a cell
    breaks the rules of the blanket, both seen while the rows are written. Of many scenes one may have small groups alone:
    it has no wse_in then, which is for the projection to refuse (growth.downscale does)."""
    if filter_method != "blanket":
        raise ValueError(f"filter_method {filter_method!r}, not blanket")
    if filter_depth is None:
        coarse = coarse.join(metrics.filter_depth(coarse, "wsh", mode_buffer), "scene")
    else:
        coarse = coarse.withColumn("depth", F.lit(float(filter_depth)))
    wse, wsh, depth = F.col("wse"), F.col("wsh"), F.col("depth")
    rows = coarse.withColumn("blanket", cell.blanket(wsh, wse, depth))
    rows = rows.withColumn("filtered", cell.without_blanket(wse, F.col("blanket"), wsh, depth))
    rules = checks.cell_rules("wse", checks.pluvial_conditions(wse="wse", filtered="filtered", blanket="blanket", wsh="wsh", depth="depth"))
    rows, seen = checks.watched(rows, rules, shallow=F.count_if(wsh <= depth))
    rows = durable(rows)
    if not seen.get["shallow"]:
        raise ValueError("filter_depth filters no cell")
    checks.require_kept(rows, rules, seen, at=("br", "bc"))
    if small_pixel_count <= 0:
        return rows.withColumn("wse_in", F.col("filtered"))
    flags = rows.select("scene", F.col("br").alias("r"), F.col("bc").alias("c"), F.col("filtered").isNotNull().alias("on"))
    small = regions.small_groups(flags, "on", small_pixel_count, required=False).select("scene", F.col("r").alias("br"), F.col("c").alias("bc"), "small")
    return rows.join(small, ["scene", "br", "bc"]).withColumn("wse_in", F.when(~F.col("small"), F.col("filtered")))


def small_groups_back(rows: DataFrame, prepared_: DataFrame, f: int, wse: str) -> DataFrame:
    """Coarse cells of small groups, at their nearest fine cells above the terrain, where wse is null."""
    taken = prepared_.withColumn("taken", F.when(F.col("wse_in").isNull(), F.col("filtered")))
    rows = resample.nearest_up(rows, taken, f, "taken", "taken")
    return rows.withColumn(wse, F.coalesce(wse, cell.wet_partial(F.col("taken"), F.col("dem")))).drop("taken")


def downscale(
    fine: DataFrame, coarse: DataFrame, f: int, *, project: Callable[[DataFrame, DataFrame, int], DataFrame] = growth.downscale,
    reapply_small_groups: bool = False, dem_coarse_resampling: str = "average", **filters,
) -> DataFrame:
    """scene, r, c, dem, wse_base (the projection of the filtered water) and wse. project takes (fine, coarse, f) and
    gives a column wse4."""
    coarse = coarse if "wsh" in coarse.columns else coarse_depth(fine, coarse, f, dem_coarse_resampling=dem_coarse_resampling)
    ready = durable(prepared(coarse, **filters))
    base = project(fine, ready.select("scene", "br", "bc", F.col("wse_in").alias("wse")), f)
    rows = base.select("scene", "r", "c", "dem", F.col("wse4").alias("wse_base")).withColumn("wse", F.col("wse_base"))
    if reapply_small_groups:
        rows = small_groups_back(rows, ready, f, "wse")
    rows = resample.bilinear_up(rows, ready, f, "blanket", "layer")
    return rows.withColumn("wse", cell.with_blanket(F.col("wse"), F.col("dem"), F.col("layer"))).drop("layer")
