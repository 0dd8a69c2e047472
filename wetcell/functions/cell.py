"""Column expressions over the layers of a wide frame. Null is nodata or, for a water surface, dry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0


def is_wet(wse: Column) -> Column:
    return wse.isNotNull()


def wet_partial(wse: Column, dem: Column) -> Column:
    """The water surface where it is above the terrain."""
    return F.when(wse > dem, wse)


def depth(wse: Column, dem: Column) -> Column:
    """0 where dry, null outside the terrain, never negative."""
    return F.when(dem.isNotNull(), F.greatest(F.coalesce(wse, dem) - dem, F.lit(0.0)))


def raw_depth(wse: Column, dem: Column) -> Column:
    """Null where dry."""
    return wse - dem


def wet_depth(wse: Column, dem: Column) -> Column:
    return F.when(wse.isNotNull() & dem.isNotNull(), F.greatest(wse - dem, F.lit(0.0)))


def in_domain(value: Column, domain: Column) -> Column:
    return F.when(domain, value)


def terrain_cost(delta: Column, scale: float = 1.0) -> Column:
    """1 where the water is above the terrain, more with the height of terrain over it; null is a barrier."""
    return F.when(delta.isNotNull(), F.when(delta > 0, 1.0).otherwise(1 + F.abs(delta) * scale))


def linear_decay(dry: Column, distance: Column, decay_frac: float) -> Column:
    return F.when(dry, distance * decay_frac).otherwise(0.0)


def slope_linear_decay(accumulated: Column, decay_frac: float) -> Column:
    return accumulated * decay_frac


def slope_power_decay(accumulated: Column, c: float, n: float) -> Column:
    return F.pow(accumulated, n) * c


def within_cap(cells_away: Column, f: int | Column, cap: float | Column | None) -> Column:
    """Strictly under the cap in coarse cells; None, or a null in a column, has no bound."""
    if cap is None:
        return F.lit(True)
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    return F.when(cap.isNull(), True).otherwise(cells_away / f < cap)


def infill(wse: Column, filled: Column, decay: Column, dem: Column, cap: Column) -> Column:
    """Wet cells as they are; dry ones take the filled surface less decay where that is above the terrain."""
    lowered = filled - decay
    return F.when(dem.isNotNull(), F.coalesce(wse, F.when(cap & (lowered > dem), lowered)))


def inundation(wse: Column) -> Column:
    return wse.isNotNull().cast("double")


def blanket(wsh: Column, wse: Column, depth_: Column) -> Column:
    """The water layer that the pluvial filter takes off: 0 where the surface is dry, null outside the domain."""
    return F.when(wsh.isNotNull(), F.when(wse.isNotNull(), F.least(wsh, depth_)).otherwise(0.0))


def without_blanket(wse: Column, blanket_: Column, wsh: Column, depth_: Column) -> Column:
    return F.when(wsh > depth_, wse - blanket_)


def with_blanket(wse: Column, dem: Column, blanket_: Column) -> Column:
    return F.when(blanket_.isNull(), wse).otherwise(F.coalesce(wse, dem) + blanket_)


def above(value: Column, least: float) -> Column:
    """Hides values under a threshold."""
    return F.when(value >= least, value)


def shared_valid(domain: Column, observed: Column, predicted: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return domain & finite(observed) & finite(predicted)


def any_null(*layers: Column) -> Column:
    found = layers[0].isNull()
    for layer in layers[1:]:
        found = found | layer.isNull()
    return found


def metres(res_x: Column, res_y: Column, latitude: Column) -> tuple[Column, Column]:
    """Metres of a cell given in degrees, along x and y, at a latitude in degrees."""
    per_degree = EARTH_RADIUS * 3.141592653589793 / 180
    return F.abs(res_x) * per_degree * F.cos(F.radians(latitude)), F.abs(res_y) * per_degree


def place(r: Column, c: Column, x0: Column, y0: Column, res_x: Column, res_y: Column) -> tuple[Column, Column]:
    """Coordinates of a cell's centre."""
    return x0 + (c + 0.5) * res_x, y0 - (r + 0.5) * res_y
