"""Scenes whose sides are no multiples of the ratio, and scenes of small groups alone."""

import pytest

from wetcell.operators import checks
from wetcell.plans import growth, pluvial
from wetcell.sources import grids


def layer(name, h, w, res, scene="t"):
    return (scene, name, h, w, 0.0, 0.0, res, res, "EPSG:3857", -9999.0)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), grids.GRIDS)


@pytest.mark.parametrize(("fine", "coarse", "f"), [
    ((82, 64), (20, 16), 4), ((82, 64), (21, 16), 4), ((6, 64), (1, 16), 4), ((3, 64), (0, 16), 4), ((82, 66), (20, 16), 4),
    ((100, 64), (25, 17), None), ((82, 64), (19, 16), None), ((82, 64), (22, 16), None), ((6, 6), (4, 3), None),
])
def test_a_last_block_may_be_cut(spark, fine, coarse, f):
    found = table(spark, layer("dem", *fine, 1.0), layer("wse", *coarse, 4.0))
    assert [r.f for r in checks.ratio(found, "dem", "wse").collect()] == [f]
    assert [r.n_bad for r in checks.whole_ratio(found, "dem", "wse").collect()] == [int(f is None)]


@pytest.mark.parametrize(("coarse", "res", "n_bad"), [((20, 16), 4.0, 0), ((21, 16), 4.0, 0), ((19, 16), 4.0, 1), ((20, 17), 4.0, 1), ((80, 64), 1.0, 1)])
def test_extents_but_for_a_cut_block(spark, coarse, res, n_bad):
    found = table(spark, layer("dem", 82, 64, 1.0), layer("wse", *coarse, res))
    assert [r.n_bad for r in checks.same_extent(found, "dem", "wse").collect()] == [n_bad]


def test_layers_of_scenes_with_a_cut_block(spark):
    """Scenes of 8 and of 6 rows make one job of ratio 4."""
    rows = [(s, r, c, float((r * 5 + c * 3) % 7)) for s, h in (("a", 8), ("b", 6)) for r in range(h) for c in range(8)]
    fine = spark.createDataFrame(rows, "scene string, r int, c int, dem double")
    coarse = spark.createDataFrame([(s, br, bc, 4.0 if bc == 0 else None) for s in "ab" for br in range(2) for bc in range(2)], "scene string, br int, bc int, wse double")
    places = table(spark, *(layer("dem", h, 8, 1.0, s) for s, h in (("a", 8), ("b", 6))), *(layer("wse", h // 4, 2, 4.0, s) for s, h in (("a", 8), ("b", 6))))
    got = growth.downscale_layers(fine, coarse, places, growth.Settings(cap=1)).select("scene", "r", "c", "wse4")
    want = growth.downscale(fine, coarse, 4, growth.Settings(cap=1)).select("scene", "r", "c", "wse4")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_a_scene_of_small_groups_alone_does_not_stop_the_others(spark):
    wet = {"a": {(0, 0), (0, 1), (1, 0)}, "b": {(0, 0)}}
    rows = [(s, br, bc, 5.0 if (br, bc) in cells else None, 1.0) for s, cells in wet.items() for br in range(3) for bc in range(3)]
    coarse = spark.createDataFrame(rows, "scene string, br int, bc int, wse double, dem double")
    ready = pluvial.prepared(pluvial.coarse_depth(coarse, coarse, 4), small_pixel_count=2).filter("wse_in IS NOT NULL").collect()
    assert {(r.scene, r.br, r.bc) for r in ready} == {("a", *p) for p in wet["a"]}
