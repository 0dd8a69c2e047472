"""Toy grid goldens, invariants on random grids, and invariance to tiling."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from wetcell.operators import checks, cost, distance, regions, resample
from wetcell.plans import growth, pluvial, validation
from wetcell.sources import grids

DEM = """1 1 3 9 9 9
1 5 3 9 2 2
1 1 3 3 9 9
1 1 9 3 9 9
1 1 9 9 9 9
1 1 9 9 9 -9999"""
#: rows and columns to the nearest wet cell of the cells that grow; the last two touch no wet partial
GROWN = {(0, 2): (0, 1), (1, 2): (1, 1), (2, 2): (0, 1), (2, 3): (0, 2), (3, 3): (0, 2), (1, 4): (1, 3), (1, 5): (1, 4)}


def toy(spark):
    """A slope down to the left, water of 4 in the coarse cells of the first column; two fine cells along a coarse one."""
    lines = [("toy", r, line) for r, line in enumerate(DEM.split("\n"))]
    cells = grids.from_text(spark.createDataFrame(lines, "scene string, r int, line string"), sep=" ")
    fine = grids.normalised(cells).withColumnRenamed("v", "dem")
    coarse = [("toy", r, c, 4.0 if c == 0 else None) for r in range(3) for c in range(3)]
    return fine, spark.createDataFrame(coarse, "scene string, br int, bc int, wse double")


def values(df, column):
    return {(r.r, r.c): r[column] for r in df.select("r", "c", column).collect() if r[column] is not None}


@pytest.mark.parametrize("metric,size", [("chessboard", max), ("euclidean", math.hypot)])
def test_toy_phases(spark, metric, size):
    rows = growth.checked(*toy(spark), 2, growth.Settings(distance_fill_method=metric))
    partial = {(r, c): 4.0 for r in range(6) for c in range(2) if (r, c) != (1, 1)}
    grown = {p: 4 - 0.001 * size(*d) for p, d in GROWN.items()}
    assert values(rows, "wse2") == pytest.approx(partial)
    assert values(rows, "wse3") == pytest.approx(partial | grown, abs=1e-9)
    assert values(rows, "wse4") == pytest.approx({k: v for k, v in (partial | grown).items() if k not in ((1, 4), (1, 5))}, abs=1e-9)


def test_toy_terrain_penalty_and_mcp_keep_the_rules(spark):
    fine, coarse = toy(spark)
    decay = {"linear": {"decay_frac": 0.001}, "slope_linear": {"decay_frac": 1e-5}, "slope_power": {"c": 1e-6, "n": 1.0}}
    rows = growth.checked(fine, coarse, 2, growth.Settings(distance_fill="terrain_penalty", decay=decay, tile=4))
    assert set(values(rows, "wse2")) < set(values(rows, "wse4"))
    mcp = growth.downscale_mcp(fine, coarse, 2, tile=4)
    assert set(values(mcp, "wse2")) < set(values(mcp, "wse4"))


def test_checks_raise(spark):
    fine, coarse = toy(spark)
    with pytest.raises(checks.CheckFailed):
        growth.checked(fine, coarse.withColumn("wse", F.lit(None).cast("double")), 2)
    with pytest.raises(checks.CheckFailed):
        growth.checked(fine.withColumn("dem", F.lit(99.0)), coarse, 2)
    with pytest.raises(ValueError):
        growth.Settings(decay={"cubic": {}})


def random_grid(spark, h=23, w=31, seed=1):
    rng = random.Random(seed)
    wet = {(r, c): float(rng.randrange(50)) for r in range(h) for c in range(w) if rng.random() < 0.04}
    price = {(r, c): None if rng.random() < 0.1 else float(rng.randrange(1, 9)) for r in range(h) for c in range(w)}
    wet = {p: v for p, v in wet.items() if price[p] is not None}
    rows = [("a", r, c, wet.get((r, c)), price[r, c]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "scene string, r int, c int, wse double, cost double"), wet, price


@pytest.mark.parametrize("metric,measure", [("chessboard", lambda a, b: max(a, b)), ("taxicab", lambda a, b: a + b), ("euclidean", math.hypot)])
def test_nearest_without_bound(spark, metric, measure):
    cells, wet, price = random_grid(spark)
    got = distance.nearest(cells, "wse", metric).collect()
    assert len(got) == len(price)
    for row in got:
        best = min((measure(abs(row.r - sr), abs(row.c - sc)), (row.r - sr) ** 2 + (row.c - sc) ** 2, sr, sc) for sr, sc in wet)
        assert (row.near.sr, row.near.sc, row.near.v) == (best[2], best[3], wet[best[2], best[3]])
        assert row.near.d == pytest.approx(best[0])


def dijkstra(wet, price, steps, node):
    label = {p: (0.0, *p) for p in wet}
    heap = [(*v, *p) for p, v in label.items()]
    heapq.heapify(heap)
    while heap:
        d, sr, sc, r, c = heapq.heappop(heap)
        if label[r, c] != (d, sr, sc):
            continue
        for i, j, length in steps:
            at = (r + i, c + j)
            if price.get(at) is not None:
                new = (d + cost.stepped(price[at] if node else (price[r, c] + price[at]) / 2 * length), sr, sc)
                if at not in label or new < label[at]:
                    label[at] = new
                    heapq.heappush(heap, (*new, *at))
    return label


@pytest.mark.parametrize("model", ["geometric", "node"])
def test_least_cost_for_any_tile_size(spark, model):
    cells, wet, price = random_grid(spark, seed=7)
    want = dijkstra(wet, price, cost.D4 if model == "node" else cost.D8, model == "node")
    for tile in (5, 64):
        got = cost.allocated(cells, "cost", "wse", model=model, tile=tile).collect()
        assert {(r.r, r.c): (r.sr, r.sc) for r in got} == {p: v[1:] for p, v in want.items()}
        assert {(r.r, r.c): r.d for r in got} == pytest.approx({p: v[0] for p, v in want.items()})
    by = {(r.r, r.c): r for r in got}
    ends = cost.paths(spark.createDataFrame(got), cells.select("scene", "r", "c").filter("c < 12")).collect()
    assert len(ends) == sum(c < 12 for _, c in by)
    for e in ends:
        at, steps = (e.r, e.c), 0
        while by[at].pr is not None:
            at, steps = (by[at].pr, by[at].pc), steps + 1
        assert (at, steps) == ((e.sr, e.sc), e.steps) and at == (by[e.r, e.c].sr, by[e.r, e.c].sc)


def test_no_source_and_bad_model(spark):
    cells, _, _ = random_grid(spark)
    assert cost.allocated(cells.withColumn("wse", F.lit(None).cast("double")), "cost", "wse").count() == 0
    with pytest.raises(ValueError):
        cost.allocated(cells, "cost", "wse", model="diagonal")


def test_source_costs_nothing_and_uniform_costs_are_distances(spark):
    cells = grids.empty_like(spark, "w", 6, 4, 1.0).withColumn("s", F.when((F.col("r") == 1) & (F.col("c") == 2), 1.0))
    got = values(cost.allocated(cells, "v", "s", model="node", tile=2), "d")
    assert got == {(r, c): abs(r - 1) + abs(c - 2) for r in range(6) for c in range(4)}


def test_regions_and_small_groups(spark):
    picture = ["##..#", "#...#", "..#..", "###.#", "....#"]
    rows = [("p", r, c, x == "#") for r, line in enumerate(picture) for c, x in enumerate(line)]
    cells = spark.createDataFrame(rows, "scene string, r int, c int, on boolean")
    sizes = {(r.region.r, r.region.c): r.cells for r in regions.sizes(regions.labelled(cells, "on")).collect()}
    assert sizes == {(0, 0): 3, (0, 4): 2, (2, 2): 4, (3, 4): 2}
    assert {k for k, v in values(regions.small_groups(cells, "on", 2), "small").items() if v} == {(0, 4), (1, 4), (3, 4), (4, 4)}
    with pytest.raises(ValueError):
        regions.small_groups(cells, "on", 9)


def test_mosaic_and_decimate(spark):
    rows = [("m", 0, c, p, float(10 * p + c) if (p + c) % 2 else None) for c in range(4) for p in range(3)]
    got = values(resample.mosaic(spark.createDataFrame(rows, "scene string, r int, c int, priority int, v double")), "v")
    assert got == {(0, 0): 10.0, (0, 1): 21.0, (0, 2): 12.0, (0, 3): 23.0}


def test_pluvial_puts_the_blanket_back(spark):
    fine, coarse = toy(spark)
    coarse = pluvial.coarse_depth(fine, coarse, 2)
    with pytest.raises(ValueError):
        pluvial.prepared(coarse, filter_depth=-1.0)
    rows = pluvial.downscale(fine, coarse, 2, small_pixel_count=0)
    base, out = values(rows, "wse_base"), values(rows, "wse")
    assert set(base) <= set(out)
    assert all(out[p] == pytest.approx(base[p] + 0.1) for p in base if p[1] < 1)  # columns whose centres have no dry neighbour


def test_layers_round_trip(spark, tmp_path):
    fine, _ = toy(spark)
    cells = fine.select("scene", F.lit("dem").alias("layer"), "r", "c", F.col("dem").alias("v"))
    grids.write_layer(cells, f"{tmp_path}/layers")
    assert values(grids.read_layer(spark, f"{tmp_path}/layers"), "v") == values(cells, "v")
    with pytest.raises(Exception, match="exist"):
        grids.write_layer(cells, f"{tmp_path}/layers")
    path = grids.write_phase(cells, f"{tmp_path}/case/02_wp/dem", "02_wp", "dem", 9, 9)
    assert path.endswith("02_wp_dem_0009x0009")
    found = grids.listing(spark, f"{tmp_path}/case").select("phase", "layer").distinct().collect()
    assert len(found) == 1
    grids.write_table(spark.createDataFrame([("a|b", 1.5)], "run_name string, rmse double"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first()["run_name"] == "a|b"


def test_counts_of_the_embeddings_grid(spark):
    """Known counts of the sf0.01 grid."""
    from wetcell.queries import flagship

    r = flagship(spark, "/root/testdata/sf0.01").first()
    assert (r.resampled, r.wet_partial, r.grown, r.final, r.beyond_cap) == (16_000, 8_014, 15_204, 12_545, 1_804)


def test_errors_of_inputs(spark):
    fine, coarse = toy(spark)
    with pytest.raises(checks.CheckFailed, match="no wet partial"):
        growth.downscale(fine.withColumn("dem", F.lit(99.0)), coarse, 2)
    cells = grids.empty_like(spark, "e", 3, 3, 1.0)
    with pytest.raises(ValueError, match="no valid cell"):
        distance.require_mask(cells.withColumn("v", F.lit(None).cast("double")), "v")
    with pytest.raises(ValueError, match="nothing to fill"):
        distance.require_mask(cells, "v")
    dry = cells.withColumn("wse", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="no wet cell"):
        cost.cost_fill(dry, "wse", "v", "out")
    half = cells.withColumn("wse", F.when(F.col("c") == 0, 2.0))
    with pytest.raises(ValueError, match="negative costs"):
        cost.cost_fill(half.withColumn("v", F.lit(-1.0)), "wse", "v", "out")
    full = cost.cost_fill(cells.withColumn("wse", F.col("c") + 0.5), "wse", "v", "out").collect()
    assert all(r.out == r.c + 0.5 and r.out_cost == 0 and r.out_zone == 3 * r.r + r.c for r in full)
    low = cells.withColumns({"dem": F.lit(2.0), "wse": F.lit(1.0)})
    with pytest.raises(checks.CheckFailed, match="below the terrain"):
        growth.to_depth(low, "wse")
    with pytest.warns(UserWarning, match="9 cells"):
        assert set(values(growth.to_depth(low, "wse", allow_low_wse=True), "wsh").values()) == {0.0}


def test_ratio_from_georeferences(spark):
    row = lambda layer, h, w: ("t", layer, h, w, 0.0, 0.0, 1.0, 1.0, "EPSG:3857", -9999.0)
    table = lambda *rows: spark.createDataFrame(rows, grids.GRIDS)
    assert growth.ratio_of(table(row("dem", 6, 6), row("wse", 3, 3))) == 2
    with pytest.raises(checks.CheckFailed):
        growth.ratio_of(table(row("dem", 6, 6), row("wse", 4, 3)))
    assert growth.ratio_of(table(row("dem", 6, 6), row("wse", 6, 6)), coarse_shape=(2, 2)) == 3


@pytest.mark.parametrize("metric", list(distance.METRICS))
def test_bands_of_rows_change_nothing(spark, metric):
    """Also where water is a diagonal or one cell, and rows differ in length."""
    random_cells, _, _ = random_grid(spark, seed=3)
    picture = [("diagonal", r, c, float(r) if r == c else None) for r in range(70) for c in range(40)]
    picture += [("corner", r, c, 7.0 if (r, c) == (0, 39) else None) for r in range(50) for c in range(40)]
    picture += [("ragged", r, c, float(c) if (r * 7 + c) % 31 == 0 and r < 20 else None) for r in range(60) for c in range(5, 5 + r % 13)]
    cells = random_cells.select("scene", "r", "c", "wse").unionByName(spark.createDataFrame(picture, "scene string, r int, c int, wse double"))
    whole = {(r.scene, r.r, r.c): r.near for r in distance.searched(cells, "wse", metric, None, rows=1000).collect()}
    for rows, columns in ((16, 128), (3, 5), (1, 1)):
        assert {(r.scene, r.r, r.c): r.near for r in distance.searched(cells, "wse", metric, None, rows=rows, columns=columns).collect()} == whole
    within = {k: n if n is not None and n.d <= 4 else None for k, n in whole.items()}
    assert {(r.scene, r.r, r.c): r.near for r in distance.searched(cells, "wse", metric, 4, rows=16).collect()} == within


def test_columns_are_carried_by_the_distance(spark):
    cells = spark.createDataFrame([("a", 0, 0, 5, "x", None, [1]), ("a", 0, 1, None, None, 2.5, None)], "scene string, r int, c int, v int, value string, low double, band array<int>")
    got = {r.c: r for r in distance.nearest(cells, "v").collect()}
    assert (got[1].near.v, got[1].near.d, got[1].value, got[1].low, got[0].value, got[0].band) == (5, 1.0, None, 2.5, "x", [1])
    assert distance.nearest(cells.limit(0), "v").count() == 0


def test_members_that_fail_or_take_too_long(spark):
    fine, coarse = toy(spark)
    members = {"good": growth.Settings(), "bad": {"distance_fill": "terrain_penalty", "cost_model": "none"}, "slow": growth.Settings()}
    records, scores = validation.ensemble(fine, coarse, validation.bilinear_baseline(fine, coarse, 2), 2, members, seconds={"good": 600, "bad": 600, "slow": 0})
    got = {r.run_name: r for r in records.collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "ok", "bad": "failed", "slow": "timeout"}
    assert got["good"].wet_cell_count > 11 and got["good"].wall_seconds > 0 and "model" in got["bad"].error
    assert {r.run_name for r in scores.collect()} == {"good"}
