"""The downscaling pipelines over many scenes at once (X1, X2, X4).

fine: scene, r, c, dem. coarse: scene, br, bc, wse. f: fine cells along a coarse cell, a number or the name of a column of
fine that has each scene's own. Lazy but for distances and the iterative parts. downscale_runs() makes many runs, whose
settings are columns, one chain of jobs.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wetcell.functions import cell
from wetcell.operators import checks, cost, distance, regions, resample, stencil
from wetcell.sources import grids as grids_
from wetcell.storage import durable

KEY = ["scene", "r", "c"]
DECAYS = ("linear", "slope_linear", "slope_power")


@dataclass(frozen=True)
class Settings:
    """distance_fill: neutral or terrain_penalty. distance_fill_method: chessboard, taxicab or euclidean. decay:
    parameters by decay method. cap: growth in coarse cells, None for no bound. cost_model: geometric or node."""

    distance_fill: str = "neutral"
    distance_fill_method: str = "chessboard"
    decay: dict = field(default_factory=lambda: {"linear": {"decay_frac": 0.001}})
    cap: float | None = 10
    as_wsh: bool = False
    pixel_size: float = 1.0
    m_to_rad: float = 1.0
    cost_model: str = "geometric"
    tile: int = 256
    allow_low_wse: bool = False

    def __post_init__(self):
        if self.distance_fill not in ("neutral", "terrain_penalty"):
            raise ValueError(f"distance_fill {self.distance_fill!r}")
        if self.distance_fill_method not in distance.METRICS:
            raise ValueError(f"distance_fill_method {self.distance_fill_method!r}")
        if unknown := set(self.decay) - set(DECAYS):
            raise ValueError(f"decay methods {sorted(unknown)}")
        if self.cost_model not in ("geometric", "node"):
            raise ValueError(f"cost model {self.cost_model!r}")

    def reach(self, f: int) -> int | None:
        return None if self.cap is None else max(1, math.ceil(self.cap * f))


def units(grids: DataFrame, layer: str = "dem", geographic: tuple[str, ...] = ("EPSG:4326", "EPSG:4258", "EPSG:4269")) -> DataFrame:
    """scene, pixel_size (metres along a cell, the mean of both axes) and m_to_rad (metres for one unit of the grid), from
    the rows of a layer. Degrees become metres at the grid's mean latitude; other grids are in metres."""
    rows = grids.filter(F.col("layer") == layer)
    latitude = F.col("y0") - F.col("height") * F.col("res_y") / 2
    x, y = cell.metres(F.col("res_x"), F.col("res_y"), latitude)
    degrees, native = F.col("crs").isin(*geographic), (F.abs("res_x") + F.abs("res_y")) / 2
    size = F.when(degrees, (x + y) / 2).otherwise(native)
    return rows.select("scene", size.alias("pixel_size"), F.when(degrees, size / native).otherwise(1.0).alias("m_to_rad"))


def ratio_of(grids: DataFrame, fine: str = "dem", coarse: str = "wse", coarse_shape: tuple[int, int] | None = None) -> int:
    """The fine cells along a coarse cell; raises unless it is whole and the same in both axes and all scenes. coarse_shape
    (height, width) stands for the coarse layer's own shape where that layer was reprojected already."""
    if coarse_shape is not None:
        height, width = coarse_shape
        own = grids.filter(F.col("layer") == coarse).withColumns({"height": F.lit(height), "width": F.lit(width)})
        grids = grids.filter(F.col("layer") == fine).unionByName(own.select(*grids.columns))
    checks.require(checks.whole_ratio(grids, fine, coarse))
    found = [r["f"] for r in checks.ratio(grids, fine, coarse).select("f").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"ratios of fine to coarse cells: {sorted(found)}; scenes of one ratio make a job")
    return found[0]


def setting(rows: DataFrame, settings: Settings, name: str) -> Column:
    """The scene's own value where rows has such a column, else that of settings."""
    return F.col(name) if name in rows.columns else F.lit(float(getattr(settings, name)))


def resampled(fine: DataFrame, coarse: DataFrame, f: int | str) -> DataFrame:
    """Phase 1 adds wse1; phase 2 adds wse2, the wet partials."""
    rows = resample.bilinear_up(fine, coarse, f, "wse", "wse1")
    return rows.withColumn("wse2", cell.wet_partial(F.col("wse1"), F.col("dem")))


def terrain_fill(rows: DataFrame, coarse: DataFrame, f: int | str, settings: Settings) -> DataFrame:
    """Adds fill: each cell takes the value of the wet cell that the terrain makes cheapest. The coarse surface, filled
    by the nearest wet cell in chessboard distance, tells how far the terrain stands over the water."""
    as_cells = coarse.withColumnsRenamed({"br": "r", "bc": "c"})
    full = distance.filled(as_cells, "wse", "full", None).select("scene", F.col("r").alias("br"), F.col("c").alias("bc"), "full")
    rows = resample.bilinear_up(rows, full, f, "full", "surface")
    rows = rows.withColumn("cost", cell.terrain_cost(F.col("surface") - F.col("dem")))
    filled = cost.cost_fill(durable(rows), "wse2", "cost", "fill", model=settings.cost_model, tile=settings.tile)
    return filled.drop("surface", "cost", "fill_zone", "fill_cost")


def decay(rows: DataFrame, settings: Settings) -> tuple[DataFrame, Column]:
    """The sum of the configured decays of dry cells; slopes are accumulated once for both that need them."""
    dry, total = F.col("wse2").isNull(), F.lit(0.0)
    if {"slope_linear", "slope_power"} & set(settings.decay):
        rows = durable(stencil.slope_horn(rows, "dem", "slope", setting(rows, settings, "pixel_size")))
        found = cost.accumulated_slope(rows, "slope", "wse2", tile=settings.tile)
        rows = rows.join(found, KEY, "left").drop("slope")
        rows = rows.withColumn("accumulated", F.col("accumulated") * setting(rows, settings, "m_to_rad"))
    for name, options in settings.decay.items():
        if name == "linear":
            total = total + cell.linear_decay(dry, F.col("away") * setting(rows, settings, "pixel_size"), **options)
        elif name == "slope_linear":
            total = total + cell.slope_linear_decay(F.col("accumulated"), **options)
        else:
            total = total + cell.slope_power_decay(F.col("accumulated"), **options)
    return rows, total


def reached(away: Column, f: int | str, cap: Column) -> Column:
    """away, null beyond the cap in whole cells; a null cap has no bound."""
    return F.when(cap.isNull() | (away <= F.greatest(F.lit(1), F.ceil(cap * resample.ratio(f)))), away)


def grown(rows: DataFrame, coarse: DataFrame, f: int | str, settings: Settings) -> DataFrame:
    """Phase 3 adds away (cells to the nearest wet one, null beyond the cap), within (the cap) and wse3."""
    cap = F.lit(settings.cap).cast("double")
    rows = distance.filled(rows, "wse2", "fill", None, settings.distance_fill_method)
    rows = rows.withColumn("away", reached(F.col("fill_d"), f, cap)).withColumn("fill", F.when(F.col("away").isNotNull(), F.col("fill"))).drop("fill_d")
    rows = rows.withColumn("within", F.coalesce(cell.within_cap(F.col("away"), resample.ratio(f), cap), F.lit(False)))
    if settings.distance_fill == "terrain_penalty":
        rows = terrain_fill(rows.drop("fill"), coarse, f, settings)
    rows, lowering = decay(rows, settings)
    rows = rows.withColumn("wse3", cell.infill(F.col("wse2"), F.col("fill"), lowering, F.col("dem"), F.col("within")))
    return rows.drop("fill", "accumulated")


def require_wet_partials(rows: DataFrame) -> None:
    """Raises if a scene has no wet partial: all of its water is below the terrain, or it has none."""
    dry = rows.groupBy("scene").agg(F.count("wse2").alias("n")).filter("n = 0").limit(5).collect()
    if dry:
        raise checks.CheckFailed(f"no wet partial is above the terrain in {', '.join(str(x['scene']) for x in dry)}")


def to_depth(rows: DataFrame, wse: str, dem: str = "dem", *, allow_low_wse: bool = False) -> DataFrame:
    """Adds wsh. Water below the terrain is an error, or a warning where it is allowed; its depth is 0."""
    low = rows.filter(F.col(wse) < F.col(dem)).count()
    if low and not allow_low_wse:
        raise checks.CheckFailed(f"{low} cells of {wse} are below the terrain")
    if low:
        warnings.warn(f"{low} cells of {wse} are below the terrain", stacklevel=2)
    return rows.withColumn("wsh", cell.depth(F.col(wse), F.col(dem)))


def write_phases(rows: DataFrame, root: str) -> list[str]:
    """The layers of each phase of downscale() as cells below root, under the phase's name; refuses to overwrite."""
    height, width = rows.agg(F.max("r") + 1, F.max("c") + 1).first()
    layers = {"wse1": "01_resampled", "wse2": "02_wp", "wse3": "03_dp", "wse4": "04_isol"}
    cells = {v: rows.select("scene", F.lit("wse").alias("layer"), "r", "c", F.col(v).alias("v")) for v in layers}
    return [grids_.write_phase(cells[v], root, phase, "wse", height, width) for v, phase in layers.items()]


def of_all(valid: str) -> Column:
    return F.concat(F.count(valid).cast("string"), F.lit(" of "), F.count(F.lit(1)).cast("string"), F.lit(" valid"))


def water_rules() -> list[checks.Rule]:
    """Of the coarse water."""
    return [checks.Rule("wse", "water neither all dry nor all wet", holds=(F.count("wse") > 0) & (F.count("wse") < F.count(F.lit(1))), detail=of_all("wse"))]


def phase_rules() -> list[checks.Rule]:
    """Of the terrain and phases 1 to 3."""
    cells = checks.cell_rules("wse3", checks.phase_conditions(resampled="wse1", partial="wse2", grown="wse3", cap="within"))
    return [*cells, checks.Rule("dem", "terrain partly valid", holds=(F.count("dem") > 0) & (F.max("r") > 0) & (F.max("c") > 0), detail=of_all("dem")),
            checks.Rule("wse2", "no wet partial is above the terrain", holds=F.count("wse2") > 0, detail=of_all("wse2"))]


def result_rules(*, allow_low_wse: bool = False) -> list[checks.Rule]:
    """Of phase 4."""
    low = {} if allow_low_wse else {"water not below terrain": F.col("wse4") < F.col("dem")}
    cells = checks.cell_rules("wse4", {**checks.isolated_conditions("wse3", "wse4", "wse2"), **low})
    return [*cells, checks.Rule("wse4", "some cells kept", holds=F.count("wse4") > 0, detail=of_all("wse4"))]


def kept(rows: DataFrame, rules: list[checks.Rule]) -> DataFrame:
    """rows, written once; raises if they break rules, of which those of cells are counted as the rows are written."""
    rows, seen = checks.watched(rows, rules)
    rows = durable(rows)
    checks.require_kept(rows, rules, seen)
    return rows


def downscale(fine: DataFrame, coarse: DataFrame, f: int | str, settings: Settings = Settings(), *, phases_to: str | None = None, check: bool = False) -> DataFrame:
    """fine with wse1, wse2, away, within, wse3 and wse4 (regions that touch a wet partial); wsh if asked for. Columns
    pixel_size and m_to_rad of fine stand for those of settings. phases_to: a folder for every phase's layer. check: the
    rules of inputs, phases and result hold or it raises; rules of cells take no pass of their own."""
    if check:
        checks.require_kept(coarse, water_rules(), at=("br", "bc"))
        rows = kept(grown(resampled(fine, coarse, f), coarse, f, settings), phase_rules())
    else:
        rows = durable(grown(resampled(fine, coarse, f), coarse, f, settings))
        require_wet_partials(rows)
    rows = regions.isolated_filter(rows, "wse3", "wse2", "wse4")
    if check:
        rows = kept(rows, result_rules(allow_low_wse=settings.allow_low_wse))
    if phases_to is not None:
        rows = rows if check else durable(rows)
        write_phases(rows, phases_to)
    if not settings.as_wsh:
        return rows
    return to_depth(rows if check else durable(rows), "wse4", allow_low_wse=settings.allow_low_wse)


def chosen(by: Column, columns: dict[str, str]) -> Column:
    """The value of the column that stands under the name in `by`."""
    return F.coalesce(*(F.when(by == name, F.col(c)) for name, c in columns.items()))


def downscale_runs(fine: DataFrame, coarse: DataFrame, f: int | str, members: dict[str, Settings]) -> DataFrame:
    """downscale() of every member in one chain of jobs: scene, run_name, r, c, dem, wse1, wse2, away, within, wse3, wse4.

    Resampling, wet partials, each metric's distances, each cost model's fill and the slopes are made once for all members
    that need them. Then every cell has a row for each member, with the member's settings as columns, which choose among
    those; regions are by scene and run."""
    if len({s.tile for s in members.values()}) != 1:
        raise ValueError("members of one chain have one tile size")
    own = [c for c in ("pixel_size", "m_to_rad") if c in fine.columns]
    rows = durable(resampled(fine, coarse, f))
    require_wet_partials(rows)
    settings = list(members.values())
    for metric in sorted({s.distance_fill_method for s in settings}):
        rows = distance.filled(rows, "wse2", f"fill_{metric}", None, metric)
    for model in sorted({s.cost_model for s in settings if s.distance_fill == "terrain_penalty"}):
        rows = terrain_fill(rows, coarse, f, Settings(cost_model=model, tile=settings[0].tile)).withColumnRenamed("fill", f"terrain_{model}")
    slopes = sorted({s.pixel_size for s in settings if {"slope_linear", "slope_power"} & set(s.decay)})[: 1 if "pixel_size" in own else None]
    for k, size in enumerate(slopes):
        rows = durable(stencil.slope_horn(rows, "dem", "slope", F.col("pixel_size") if "pixel_size" in own else F.lit(size)))
        found = cost.accumulated_slope(rows, "slope", "wse2", tile=settings[0].tile).withColumnRenamed("accumulated", f"accumulated_{k}")
        rows = rows.drop("slope").join(found, KEY, "left")
    number = lambda x: F.lit(x).cast("double")
    runs = []
    for name, s in members.items():
        at = 0 if len(slopes) < 2 else slopes.index(s.pixel_size) if s.pixel_size in slopes else 0
        linear, sloped, power = (s.decay.get(x, {}) for x in DECAYS)
        columns = {
            "run_name": F.lit(name), "metric": F.lit(s.distance_fill_method), "source": F.lit(f"terrain_{s.cost_model}" if s.distance_fill == "terrain_penalty" else f"fill_{s.distance_fill_method}"),
            "cap": number(s.cap), "size": number(s.pixel_size), "unit": number(s.m_to_rad), "slopes": F.lit(f"accumulated_{at}"),
            "linear": number(linear.get("decay_frac")), "sloped": number(sloped.get("decay_frac")), "c": number(power.get("c")), "n": number(power.get("n")),
        }
        runs.append(F.struct(*(v.alias(k) for k, v in columns.items())))
    rows = rows.withColumn("run", F.explode(F.array(*runs)))  # a few members each
    metrics = sorted({s.distance_fill_method for s in settings})
    cap, size = F.col("run.cap"), F.col("pixel_size") if "pixel_size" in own else F.col("run.size")
    away = chosen(F.col("run.metric"), {m: f"fill_{m}_d" for m in metrics})
    fill = chosen(F.col("run.source"), {c: c for c in rows.columns if c in {f"fill_{m}" for m in metrics} or c.startswith("terrain_")})
    rows = rows.withColumn("away", reached(away, f, cap)).withColumn("within", F.coalesce(cell.within_cap(F.col("away"), resample.ratio(f), cap), F.lit(False)))
    linear = cell.linear_decay(F.col("wse2").isNull(), F.col("away") * size, F.col("run.linear"))
    total = F.when(F.col("run.linear").isNull(), 0.0).otherwise(linear)
    if slopes:
        climbed = chosen(F.col("run.slopes"), {f"accumulated_{k}": f"accumulated_{k}" for k in range(len(slopes))}) * (F.col("m_to_rad") if "m_to_rad" in own else F.col("run.unit"))
        total = total + F.when(F.col("run.sloped").isNull(), 0.0).otherwise(cell.slope_linear_decay(climbed, F.col("run.sloped")))
        total = total + F.when(F.col("run.c").isNull(), 0.0).otherwise(cell.slope_power_decay(climbed, F.col("run.c"), F.col("run.n")))
    rows = rows.withColumn("wse3", cell.infill(F.col("wse2"), fill, total, F.col("dem"), F.col("within")))
    kept = [c for c in fine.columns if c != "scene"] + ["wse1", "wse2", "away", "within", "wse3"]
    rows = durable(rows.select(F.concat_ws("\x01", "run.run_name", "scene").alias("scene"), F.col("scene").alias("own_scene"), "run.run_name", *kept))
    rows = regions.isolated_filter(rows, "wse3", "wse2", "wse4")
    return rows.select(F.col("own_scene").alias("scene"), "run_name", *kept, "wse4")


def downscale_layers(fine: DataFrame, coarse: DataFrame, grids: DataFrame, settings: Settings = Settings(), *, coarse_shape: tuple[int, int] | None = None, **options) -> DataFrame:
    """downscale() with the ratio, the cells' size and the metres of a unit taken from the georeferences of the layers dem
    and wse (see grids.GRIDS), after the checks of their ratios."""
    f = ratio_of(grids, coarse_shape=coarse_shape)
    return downscale(fine.join(units(grids), "scene"), coarse, f, settings, **options)


def checked(fine: DataFrame, coarse: DataFrame, f: int | str, settings: Settings = Settings()) -> DataFrame:
    """downscale() with its checks."""
    return downscale(fine, coarse, f, settings, check=True)


def downscale_mcp(fine: DataFrame, coarse: DataFrame, f: int, *, cap: float = 10, decay_frac: float = 0.001, scale: float = 1.0, pixel_size: float = 1.0, tile: int = 256) -> DataFrame:
    """The least-path variant: a uniform fill and its distance inside the domain, a cost of the terrain over the filled
    water, cells of the cheapest source added within the cap (it included); decay is on the distance."""
    domain = F.col("dem").isNotNull()
    rows = resample.valid_up(resampled(fine, coarse, f), coarse, f, "wse", "parent")
    rows = durable(rows.withColumn("wse2", F.when(F.col("parent"), F.col("wse2"))).drop("parent").withColumn("one", F.when(domain, 1.0)))
    rows = cost.cost_fill(rows, "wse2", "one", "flat", tile=tile).drop("flat_zone").withColumnRenamed("flat_cost", "away")
    rows = rows.withColumn("cost", cell.terrain_cost(F.col("flat") - F.col("dem"), scale))
    rows = cost.cost_fill(durable(rows), "wse2", "cost", "fill", tile=tile).drop("fill_zone", "fill_cost")
    lowered = F.col("fill") - F.col("away") * pixel_size * decay_frac
    add = F.col("wse2").isNull() & (F.col("away") / f <= cap) & (lowered > F.col("dem"))
    rows = rows.withColumn("wse3", F.when(add, lowered).otherwise(F.col("wse2"))).drop("one", "flat", "cost", "fill")
    return regions.isolated_filter(durable(rows), "wse3", "wse2", "wse4")


def run_metadata(rows: DataFrame, f: int, settings: Settings) -> DataFrame:
    """One row per scene: parameters, shape and wet cells of each phase."""
    count = {f"wet{i}": F.count(f"wse{i}") for i in (1, 2, 3, 4)}
    shape = {"height": F.max("r") + 1, "width": F.max("c") + 1}
    facts = {"f": F.lit(f), "distance_fill": F.lit(settings.distance_fill), "metric": F.lit(settings.distance_fill_method), "cap": F.lit(settings.cap).cast("double")}
    return rows.groupBy("scene").agg(*((x.alias(n)) for n, x in {**shape, **count}.items())).withColumns(facts)


def run_record(rows: DataFrame, coarse: DataFrame, f: int, settings: Settings) -> DataFrame:
    """run_metadata() with the terrain's null cells, the coarse grid's shape and wet cells, and the regions and cells
    before and after the isolated filter."""
    null_ = rows.groupBy("scene").agg(F.count_if(F.col("dem").isNull()).alias("dem_null"))
    shape = coarse.groupBy("scene").agg((F.max("br") + 1).alias("coarse_height"), (F.max("bc") + 1).alias("coarse_width"), F.count("wse").alias("coarse_wet"))
    parts = regions.isolated_counts(rows, "wse3", "wse2")
    return run_metadata(rows, f, settings).join(null_, "scene").join(shape, "scene").join(parts, "scene", "left")
