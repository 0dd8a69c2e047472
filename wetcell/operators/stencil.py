"""Stencils over dense grids: slope, hillshade, structural similarity (N6-N10).

Cells go once to tiles, with a halo as wide as the stencil's reach copied from the tiles beside them; a task then does all
taps of a tile in numpy. That is one shuffle for a stencil of any reach, and a task holds one tile. Columns of a tile's own
cells go along, so nothing is joined back. Grids are dense; a cell beyond the grid, or without a row, is an edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetcell.storage import durable

TILE = 256


def haloed(cells: DataFrame, key: list[str], reach: int, tile: int) -> DataFrame:
    """cells with _tr, _tc: once for its own tile, once more for each tile whose halo it is in."""
    reached = lambda i: F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda d: F.floor((F.col(i) + d) / tile).cast("int")))
    return cells.withColumn("_tr", F.explode(reached("r"))).withColumn("_tc", F.explode(reached("c")))


class Tile:
    """One tile as arrays: values by column name (null: NaN), present where a cell has a row; own are its cells' rows."""

    def __init__(self, table: pa.Table, reach: int, tile: int, values: list[str]):
        first = table.slice(0, 1).to_pydict()
        self.r0, self.c0 = first["_tr"][0] * tile, first["_tc"][0] * tile
        self.reach, side = reach, tile + 2 * reach
        r, c = (table[n].to_numpy().astype(np.int64) for n in ("r", "c"))
        at = (r - self.r0 + reach, c - self.c0 + reach)
        self.present = np.zeros((side, side), bool)
        self.present[at] = True
        self.values = {n: np.full((side, side), np.nan) for n in values}
        for n in values:
            self.values[n][at] = table[n].cast(pa.float64()).to_numpy(zero_copy_only=False)
        inside = (r // tile * tile == self.r0) & (c // tile * tile == self.c0)
        self.own = table.filter(pa.array(inside))
        self.at = (at[0][inside], at[1][inside])
        self.r, self.c = r[inside], c[inside]


def on_tiles(cells: DataFrame, key: list[str], values: list[str], reach: int, tile: int, out: str, compute: Callable[[Tile], np.ndarray]) -> DataFrame:
    """cells with `out`: what compute gives for a tile's cells and its halo (NaN: null). values: the columns it reads."""
    rows = cells.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    names = rows.columns

    def one(table: pa.Table) -> pa.Table:
        t = Tile(table, reach, tile, values)
        with np.errstate(all="ignore"):
            found = compute(t)[t.at]
        return t.own.select(names).append_column(out, pa.array(found, pa.float64(), mask=np.isnan(found)))

    return haloed(rows, key, reach, tile).groupBy(*key, "_tr", "_tc").applyInArrow(one, schema)


def shifted(a: np.ndarray, dr: int, dc: int, empty: float | bool = np.nan) -> np.ndarray:
    """The values dr rows and dc columns further on."""
    out = np.full_like(a, empty)
    h, w = a.shape
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = a[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def neighbours(v: np.ndarray, present: np.ndarray, dr: int, dc: int) -> tuple[np.ndarray, np.ndarray]:
    """The values before and after along an axis; at the edges they go on in a straight line."""
    before, after = shifted(v, -dr, -dc), shifted(v, dr, dc)
    return np.where(shifted(present, -dr, -dc, False), before, 2 * v - after), np.where(shifted(present, dr, dc, False), after, 2 * v - before)


def slope_horn(cells: DataFrame, dem: str = "dem", out: str = "slope", scale: float | Column = 1.0, *, tile: int = TILE) -> DataFrame:
    """Percent slope by Horn's formula with unit cells; any null in the 3 x 3 cells gives null."""

    def compute(t: Tile) -> np.ndarray:
        v = t.values[dem]
        west, east = neighbours(v, t.present, 0, 1)
        across, along = east - west, west + 2 * v + east
        (north, south), (above, below) = neighbours(across, t.present, 1, 0), neighbours(along, t.present, 1, 0)
        gx, gy = north + 2 * across + south, below - above
        return 100 * np.sqrt(gx * gx + gy * gy) / 8

    rows = on_tiles(cells, ["scene"], [dem], 1, tile, out, compute)
    return rows.withColumn(out, F.col(out) / scale)


def slope_zt(cells: DataFrame, dem: str = "dem", out: str = "slope", size: float = 1.0, *, tile: int = TILE) -> DataFrame:
    """Slope in degrees by Zevenbergen and Thorne's formula: central differences."""

    def compute(t: Tile) -> np.ndarray:
        v = t.values[dem]
        (west, east), (north, south) = neighbours(v, t.present, 0, 1), neighbours(v, t.present, 1, 0)
        gx, gy = (east - west) / (2 * size), (south - north) / (2 * size)
        return np.degrees(np.arctan(np.sqrt(gx * gx + gy * gy)))

    return on_tiles(cells, ["scene"], [dem], 1, tile, out, compute)


def gradient(v: np.ndarray, present: np.ndarray, dr: int, dc: int, size: float) -> np.ndarray:
    """Central differences, one-sided at the edges."""
    before, after = shifted(v, -dr, -dc), shifted(v, dr, dc)
    first, last = ~shifted(present, -dr, -dc, False), ~shifted(present, dr, dc, False)
    return np.where(first, (after - v) / size, np.where(last, (v - before) / size, (after - before) / (2 * size)))


def hillshade(cells: DataFrame, dem: str = "dem", out: str = "shade", size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, *, tile: int = TILE) -> DataFrame:
    """Light from a direction on the terrain, nulls filled with the scene's mean, scaled to 0 to 1 in each scene."""
    az, al = math.radians(azimuth), math.radians(altitude)

    def compute(t: Tile) -> np.ndarray:
        v = t.values["_z"]
        gx, gy = gradient(v, t.present, 0, 1, size), gradient(v, t.present, 1, 0, size)
        slope, aspect = math.pi / 2 - np.arctan(np.sqrt(gx * gx + gy * gy)), np.arctan2(-gx, gy)
        return math.sin(al) * np.sin(slope) + math.cos(al) * np.cos(slope) * np.cos(az - aspect)

    mean = durable(cells.groupBy("scene").agg(F.avg(dem).alias("_mean")))  # a row a scene, of known size for the join
    rows = cells.join(mean, "scene").withColumn("_z", F.coalesce(dem, "_mean")).drop("_mean")
    rows = durable(on_tiles(rows, ["scene"], ["_z"], 1, tile, "_shade", compute).drop("_z"))
    span = durable(rows.groupBy("scene").agg(F.min("_shade").alias("_lo"), F.max("_shade").alias("_hi")))
    return rows.join(span, "scene").withColumn(out, (F.col("_shade") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_shade", "_lo", "_hi")


def smoothed(a: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted sums over squares of cells; weights go along one axis, from the first cell to the last."""
    reach = len(weights) // 2
    for dr, dc in ((0, 1), (1, 0)):
        a = sum(w * shifted(a, k * dr, k * dc, 0.0) for k, w in enumerate(weights, -reach))
    return a


def mean_similarity(cells: DataFrame, key: list[str], weights: list[float], unbiased: float, tile: int) -> DataFrame:
    """key and ssim over the windows inside the grid. cells: key, r, c, _x, _y, _h, _w (last row and column) and _range.
    A tile gives one row, a sum and a count."""
    reach = len(weights) // 2
    schema = T.StructType([*cells.select(*key).schema.fields, T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def one(table: pa.Table) -> pa.Table:
        t = Tile(table, reach, tile, ["_x", "_y"])
        x, y = t.values["_x"], t.values["_y"]
        with np.errstate(all="ignore"):
            s = similarity(*(smoothed(a, weights) for a in (x, y, x * x, y * y, x * y)), t.own["_range"][0].as_py() if len(t.own) else 1.0, unbiased)[t.at]
        height, width = (t.own[n].to_numpy() for n in ("_h", "_w"))
        inner = (t.r >= reach) & (t.r <= height - reach) & (t.c >= reach) & (t.c <= width - reach)
        s = s[inner]
        s = s[~np.isnan(s)]
        return table.slice(0, 1).select(key).append_column("s", pa.array([float(s.sum())])).append_column("n", pa.array([len(s)], pa.int64()))

    parts = haloed(cells, key, reach, tile).groupBy(*key, "_tr", "_tc").applyInArrow(one, schema)
    return parts.groupBy(*key).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("ssim"))


def similarity(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray, xy: np.ndarray, data_range: float, unbiased: float) -> np.ndarray:
    """The structural similarity of a window from its means; unbiased is n / (n - 1) for sample covariances."""
    c1, c2 = (0.01 * data_range) * (0.01 * data_range), (0.03 * data_range) * (0.03 * data_range)
    vx, vy, vxy = (xx - x * x) * unbiased, (yy - y * y) * unbiased, (xy - x * y) * unbiased
    return ((2 * x * y + c1) * (2 * vxy + c2)) / ((x * x + y * y + c1) * (vx + vy + c2))


def ssim(cells: DataFrame, key: list[str], observed: str, predicted: str, valid: Column, *, tile: int = TILE) -> DataFrame:
    """key and ssim: 7 x 7 plain windows, outer 3 cells left out, data range of the valid observed cells (1 if none),
    zero outside the valid cells, null with fewer than 9 valid cells. Cells must be dense with indexes from 0."""
    value = lambda v: F.when(valid, F.coalesce(F.col(v).cast("double"), F.lit(0.0))).otherwise(0.0)
    rows = cells.select(*key, "r", "c", valid.alias("_ok"), value(observed).alias("_x"), value(predicted).alias("_y"))
    seen = F.when(F.col("_ok"), F.col("_x"))
    stats = durable(rows.groupBy(*key).agg(F.count_if("_ok").alias("_n"), (F.max(seen) - F.min(seen)).alias("_range"), F.max("r").alias("_h"), F.max("c").alias("_w")))
    stats = stats.withColumn("_range", F.when(F.col("_range") > 0, F.col("_range")).otherwise(1.0))
    found = mean_similarity(rows.drop("_ok").join(stats.drop("_n"), key), key, [1 / 7] * 7, 49 / 48, tile)
    return found.join(stats, key).select(*key, F.when(F.col("_n") >= 9, F.col("ssim")).alias("ssim"))


def gaussian(reach: int = 5, sigma: float = 1.5) -> list[float]:
    taps = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(reach + 1)]
    total = taps[0] + 2 * sum(taps[1:])
    return [t / total for t in taps]


def ssim_chips(cells: DataFrame, key: list[str], observed: str, predicted: str, max_val: float = 1.0, *, tile: int = TILE) -> DataFrame:
    """key and ssim of each chip: 11 x 11 Gaussian windows that lie inside the chip."""
    rows = cells.select(*key, "r", "c", F.col(observed).cast("double").alias("_x"), F.col(predicted).cast("double").alias("_y"))
    stats = durable(rows.groupBy(*key).agg(F.max("r").alias("_h"), F.max("c").alias("_w"))).withColumn("_range", F.lit(float(max_val)))
    taps = gaussian()
    return mean_similarity(rows.join(stats, key), key, taps[:0:-1] + taps, 1.0, tile)
