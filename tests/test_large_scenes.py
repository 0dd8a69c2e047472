"""A scene of many cells is not one task's: what is known of a scene is joined where its cells are."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from wetcell.operators import cost, distance, regions
from wetcell.queries import fields
from wetcell.storage import durable


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_the_cells_of_a_scene_are_not_joined_by_scene(spark):
    noise = F.xxhash64("id") % 1000 / 7.0
    cells = spark.range(40_000).select(F.lit("a").alias("scene"), F.expr("cast(id div 40 as int)").alias("r"), F.expr("cast(id % 40 as int)").alias("c"), noise.alias("v"))
    cells = durable(cells.withColumn("v", F.when(F.col("r") % 3 == 0, F.col("v"))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = plan_of(distance.nearest(cells, "v"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "hashpartitioning(scene#" in plan
    assert all("band" in line or "chunk" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("name", ["n2_distance_taxicab", "n2_distance_taxicab_unbounded", "n3_distance_euclidean"])
def test_without_broadcasts_a_scene_is_still_not_joined_by_scene(spark, tmp_path, name):
    rng = random.Random(7)
    rows = [(k, [rng.uniform(-0.1, 0.1) for _ in range(64)]) for k in range(200)]  # four bands
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {tuple(x) for x in fields.QUERIES[name](spark, str(tmp_path)).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fields.QUERIES[name](spark, str(tmp_path))
        plan, got = plan_of(found), [tuple(x) for x in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 200 * 64 and set(got) == want
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("band" in line or "chunk" in line for line in moved)


@pytest.mark.parametrize("metric", distance.METRICS)
def test_no_task_scans_more_bands_than_a_step(spark, monkeypatch, metric):
    """Scenes of 90, 60 and 1 bands of one row, ragged and with wide dry parts; at a step of 4 the runs have runs of their own."""
    rng = random.Random(3)
    rows = [(s, r, c, float(rng.randrange(99)) if r % 23 in (0, 5) and rng.random() < 0.1 else None)
            for s, low, high in (("a", 0, 90), ("b", 1000, 1060), ("c", 7, 8)) for r in range(low, high) for c in range(r % 3, 14)]
    cells = spark.createDataFrame(rows, "scene string, r int, c int, v double")
    whole = {(x.scene, x.r, x.c): x.near for x in distance.searched(cells, "v", metric, None, rows=1000).collect()}
    real = distance.carrying

    def few(function):
        def run(bands, *outer):
            assert bands.num_rows <= 4, "a task has too many bands"
            return function(bands, *outer)

        return run

    monkeypatch.setattr(distance, "carrying", lambda *args: tuple(few(f) for f in real(*args)))
    found = distance.searched(cells, "v", metric, None, rows=1, columns=5, step=4)
    assert {(x.scene, x.r, x.c): x.near for x in found.collect()} == whole


def test_columns_of_a_scene_are_linked_in_strips(spark, monkeypatch):
    """A lake of 600 rows and two columns, with a gap in one of them: no task needs a whole column to find what touches."""
    on = {(r, c) for r in range(600) for c in range(2)} - {(255, 0), (511, 1)}
    cells = spark.createDataFrame([("a", r, c, (r, c) in on) for r in range(600) for c in range(2)], "scene string, r int, c int, on boolean")
    seen, real = [], regions.components
    monkeypatch.setattr(regions, "components", lambda edges, **options: seen.append(edges) or real(edges, **options))
    found = regions.labelled(cells, "on")
    assert {(x.r, x.c, x.region.r, x.region.c) for x in found.collect()} == {(r, c, 0, 0) for r, c in on}
    links = [(x.r, x.c) for x in seen[0].collect()]
    assert len(links) == len(set(links)) and set(links) == {(r, c) for r, c in on if (r + 1, c) in on}
    moved = [line for line in plan_of(seen[0]).splitlines() if "Exchange hashpartitioning" in line and "scene" in line]
    assert moved and all("_strip" in line for line in moved)


def test_paths_cross_tiles_and_lose_none(spark):
    """A path of 60 cells through tiles of 4, from a source at one end; a cell behind a missing one has no path."""
    way = [(r, c if r % 2 == 0 else 9 - c) for r in range(6) for c in range(10)]
    rows = [("a", r, c, *(way[k - 1] if k else (None, None))) for k, (r, c) in enumerate(way)] + [("b", 0, 0, 5, 5), ("b", 3, 3, None, None)]
    links = spark.createDataFrame(rows, "scene string, r int, c int, pr int, pc int")
    want = {("a", r, c, k, 0, 0) for k, (r, c) in enumerate(way)} | {("b", 3, 3, 0, 3, 3)}
    assert {tuple(x) for x in cost.paths(links, tile=4).collect()} == want
