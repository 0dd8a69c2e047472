import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_grids import dijkstra, toy
from wetcell.operators import cost
from wetcell.plans import growth, validation
from wetcell.storage import shared_folder

RUNS = {
    "plain": growth.Settings(cap=3),
    "wide": growth.Settings(cap=None, distance_fill_method="euclidean", decay={"linear": {"decay_frac": 0.01}}),
    "terrain": growth.Settings(cap=2, distance_fill="terrain_penalty", decay={"linear": {"decay_frac": 0.001}, "slope_power": {"c": 0.0001, "n": 1.1}}),
    "none": growth.Settings(cap=1.5, distance_fill_method="taxicab", decay={}),
}


def rows_of(df):
    return {(r.scene, r.r, r.c): (r.within, r.wse3 and round(r.wse3, 9), r.wse4 and round(r.wse4, 9)) for r in df.collect()}


def test_runs_in_one_chain_are_those_of_each_alone(spark):
    fine, coarse = toy(spark)
    together = growth.downscale_runs(fine, coarse, 2, RUNS).cache()
    for name, settings in RUNS.items():
        assert rows_of(together.filter(F.col("run_name") == name)) == rows_of(growth.downscale(fine, coarse, 2, settings))


def test_scenes_of_two_ratios_make_one_job(spark):
    rng = random.Random(2)
    alone, fine, coarse = {}, None, None
    for f in (2, 3):
        size = 6 * f
        cells = spark.createDataFrame([(f"s{f}", r, c, float(rng.randrange(20)), f) for r in range(size) for c in range(size)], "scene string, r int, c int, dem double, f int")
        water = spark.createDataFrame([(f"s{f}", r, c, 15.0 if (r + c) % 3 == 0 else None) for r in range(6) for c in range(6)], "scene string, br int, bc int, wse double")
        alone |= rows_of(growth.downscale(cells.drop("f"), water, f, growth.Settings(cap=2, distance_fill="terrain_penalty")))
        fine, coarse = (cells, water) if fine is None else (fine.unionByName(cells), coarse.unionByName(water))
    assert rows_of(growth.downscale(fine, coarse, "f", growth.Settings(cap=2, distance_fill="terrain_penalty"))) == alone


def test_members_over_their_limit_start_nothing_more(spark):
    fine, coarse = toy(spark)
    observed = validation.bilinear_baseline(fine, coarse, 2)
    members = {"slow": growth.Settings(distance_fill="terrain_penalty"), "wrong": {"metric": 1}, "model": {"cost_model": "none"}}
    records, scores = validation.ensemble(fine, coarse, observed, 2, members, seconds=1.5)
    tracker = spark.sparkContext.statusTracker()
    assert {r.run_name: r.status for r in records.collect()} == {"slow": "timeout", "wrong": "failed", "model": "failed"} and scores.isEmpty()
    time.sleep(2)
    assert not tracker.getActiveJobsIds()


@pytest.mark.parametrize("node", [False, True])
def test_a_winding_path_crosses_many_tiles(spark, node):
    """Walls leave one long way; rounds are put together on it, and one table is left."""
    h, w = 9, 40
    price = {(r, c): None if r % 2 and c != (w - 1 if r % 4 == 1 else 0) else 1.0 + (r * c) % 3 for r in range(h) for c in range(w)}
    rows = [("m", r, c, price[r, c], 1.0 if (r, c) == (0, 0) else None) for r in range(h) for c in range(w)]
    cells = spark.createDataFrame(rows, "scene string, r int, c int, cost double, wse double")
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = cost.allocated(cells, "cost", "wse", model="node" if node else "geometric", tile=10).collect()
    want = dijkstra({(0, 0): 1.0}, price, cost.D4 if node else cost.D8, node)
    assert {(r.r, r.c): r.d for r in got} == pytest.approx({p: v[0] for p, v in want.items()}) and len(got) > 180
    assert len(set(os.listdir(folder)) - before) == 1
