"""Tile rows, clips that skip files, mosaics by place, and the options of the pluvial plan."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wetcell.operators import resample
from wetcell.plans import pluvial
from wetcell.sources import tiles


def test_tiles_there_and_back(spark, tmp_path):
    rows = [("s", "dem", r, c, None if (r + c) % 5 == 0 else r + c / 100) for r in range(9) for c in range(11) if (r, c) != (4, 4)]
    cells = spark.createDataFrame(rows, "scene string, layer string, r int, c int, v double")
    tiles.write_tiles(tiles.to_tiles(cells, 4), str(tmp_path / "t"))
    back = tiles.read_tiles(spark, str(tmp_path / "t"))
    assert back.count() == 9
    assert sorted(map(tuple, tiles.to_cells(back).collect())) == sorted(rows)
    assert tiles.to_cells(tiles.to_tiles(cells.limit(0))).count() == 0
    got = tiles.clip_tiles(back, 2, 3, 5, 8).collect()
    assert sorted(map(tuple, got)) == sorted(x for x in rows if 2 <= x[2] <= 5 and 3 <= x[3] <= 8)


def test_a_clip_skips_files(spark, tmp_path, capsys):
    cells = spark.range(128 * 128).selectExpr("'s' AS scene", "'dem' AS layer", "cast(id div 128 as int) AS r", "cast(id % 128 as int) AS c", "cast(id as double) AS v")
    path = str(tmp_path / "t")
    tiles.write_tiles(tiles.to_tiles(cells, 8), path, files=16)
    files = glob.glob(path + "/**/*.parquet", recursive=True)

    def bounds(file, column):
        group = pq.ParquetFile(file).metadata.row_group(0)
        return next(group.column(i).statistics for i in range(group.num_columns) if group.column(i).path_in_schema == column)

    hit = [f for f in files if bounds(f, "r1").max >= 5 and bounds(f, "r0").min <= 20 and bounds(f, "c1").max >= 5 and bounds(f, "c0").min <= 20]
    assert len(files) >= 12 and len(hit) <= 4
    found = tiles.clip_tiles(tiles.read_tiles(spark, path), 5, 5, 20, 20)
    assert found.count() == 256
    found.explain()
    assert "GreaterThanOrEqual(r1,5)" in capsys.readouterr().out


def placed(spark, *grids):
    return spark.createDataFrame([("s", *g) for g in grids], "scene string, layer string, height int, width int, x0 double, y0 double, res_x double, res_y double, priority int")


def test_mosaic_by_place(spark):
    layers = spark.createDataFrame([("s", "a", r, c, 1.0) for r in range(2) for c in range(2)] + [("s", "b", 0, 0, 2.0), ("s", "b", 0, 1, None)], "scene string, layer string, r int, c int, v double")
    grids = placed(spark, ("a", 2, 2, 10.0, 20.0, 0.5, 0.5, 0), ("b", 1, 2, 9.5, 19.5, 0.5, 0.5, 1))
    got = {(x.r, x.c): x.v for x in resample.mosaic_placed(layers, grids).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 1.0, (1, 0): 2.0, (1, 1): 1.0, (1, 2): 1.0}
    whole = resample.union_grid(grids).first()
    assert (whole.height, whole.width, whole.x0, whole.y0) == (2, 3, 9.5, 20.0)
    for wrong in (("b", 1, 2, 9.7, 19.5, 0.5, 0.5, 1), ("b", 1, 2, 9.5, 19.5, 0.25, 0.25, 1)):
        with pytest.raises(ValueError, match="common grid"):
            resample.mosaic_placed(layers, placed(spark, ("a", 2, 2, 10.0, 20.0, 0.5, 0.5, 0), wrong))
    with pytest.raises(Exception, match="no grid"):
        resample.mosaic_placed(layers, placed(spark, ("a", 2, 2, 10.0, 20.0, 0.5, 0.5, 0))).collect()


def test_coarse_terrain_methods(spark):
    fine = spark.createDataFrame([("s", r, c, float(4 * r + c)) for r in range(4) for c in range(4)], "scene string, r int, c int, dem double")
    coarse = spark.createDataFrame([("s", r, c, 20.0) for r in range(2) for c in range(2)], "scene string, br int, bc int, wse double")
    first = lambda how: pluvial.coarse_depth(fine, coarse, 2, dem_coarse_resampling=how).filter("br = 0 AND bc = 0").first()
    assert {h: first(h).dem for h in ("average", "min", "max", "median")} == {"average": 2.5, "min": 0.0, "max": 5.0, "median": 2.5}
    assert first("max").wsh == 15.0 and first("bilinear").dem is not None
    for wrong in ({"dem_coarse_resampling": "cubic"}, {"filter_method": "none"}):
        with pytest.raises(ValueError):
            pluvial.downscale(fine, coarse, 2, **wrong)
