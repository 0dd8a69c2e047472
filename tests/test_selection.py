"""Exact quantiles, modes and ranks, and stencils on tiles, against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wetcell.operators import metrics, stencil


def test_quantiles_are_exact_through_every_split(spark):
    rng = random.Random(3)
    groups = {
        "wide": [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-9, 12) for _ in range(900)],
        "narrow": [5 + rng.random() * 1e-9 for _ in range(700)],
        "ties": [float(rng.randrange(3)) for _ in range(500)],
        "huge": [-1.7e308, 1.7e308, 0.0, 1.0],
        "one": [4.0],
        "two": [1.0, 2.0],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    cells = spark.createDataFrame(rows, "k string, x double")
    shares = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.95, "e": 1.0}
    for few in (1, 10, 100_000):
        found = {r.k: r for r in metrics.quantiles(cells, ["k"], "x", few=few, **shares).collect()}
        assert set(found) == {*groups, "none"} and found["none"].c is None
        for k, xs in groups.items():
            for name, share in shares.items():
                at = sorted(xs)[math.floor(share * (len(xs) - 1))], sorted(xs)[math.ceil(share * (len(xs) - 1))]
                if k == "huge":
                    assert at[0] <= found[k][name] <= at[1]
                else:
                    assert found[k][name] == pytest.approx(np.quantile(xs, share), rel=1e-12, abs=1e-300), (few, k, name)


def test_quantiles_plan_and_empty(spark, capsys):
    none = spark.createDataFrame([], "k string, x double")
    assert metrics.quantiles(none, ["k"], "x", m=0.5).count() == 0
    cells = spark.createDataFrame([("a", float(i), 0.0) for i in range(50)], "k string, x double, y double")
    found = metrics.differences(cells, ["k"], "y", "x")
    assert found.first().p95 == pytest.approx(np.quantile(np.arange(50), 0.95))
    found.explain()
    assert "percentile" not in capsys.readouterr().out


def test_modes(spark):
    rows = [("a", 1.0), ("a", 1.00004), ("a", 2.0), ("a", 2.0), ("a", None), ("a", None), ("a", None), ("b", None)]
    found = {r.k: r.mode for r in metrics.modes(spark.createDataFrame(rows, "k string, x double"), ["k"], F.col("x")).collect()}
    assert found == {"a": 1.0, "b": None}


def test_ranks_are_long_and_whole(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x"))
    found = metrics.ranked(rows, F.desc("x"))
    assert found.schema["rank"].dataType.typeName() == "long"
    assert all(r["rank"] == 5000 - r.x for r in found.collect())


def grid(spark, h, w, holes=()):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(h, w)) * 50, 2)
    for at in holes:
        a[at] = np.nan
    rows = [("g", r, c, None if np.isnan(a[r, c]) else float(a[r, c]), f"{r}/{c}") for r in range(h) for c in range(w)]
    return a, spark.createDataFrame(rows, "scene string, r int, c int, dem double, note string")


def taken(found, column):
    return {(r.r, r.c): r[column] for r in found.collect()}


@pytest.mark.parametrize("tile", [3, 4, 256])
def test_slope_on_any_tiles(spark, tile):
    a, cells = grid(spark, 7, 10, holes=[(3, 4), (0, 9)])
    wide = np.pad(a, ((0, 0), (1, 1)))
    wide[:, 0], wide[:, -1] = 2 * a[:, 0] - a[:, 1], 2 * a[:, -1] - a[:, -2]
    full = np.pad(wide, ((1, 1), (0, 0)))
    full[0], full[-1] = 2 * wide[0] - wide[1], 2 * wide[-1] - wide[-2]
    found = stencil.slope_horn(cells, scale=2.0, tile=tile)
    assert found.columns == [*cells.columns, "slope"]
    got = taken(found, "slope")
    assert len(got) == 70
    for (r, c), x in got.items():
        n = full[r : r + 3, c : c + 3]
        gx, gy = (n[:, 2] - n[:, 0]) @ [1, 2, 1], (n[2] - n[0]) @ [1, 2, 1]
        want = 100 * math.hypot(gx, gy) / 16
        assert (x is None and math.isnan(want)) or x == pytest.approx(want, rel=1e-12)
    assert all(r.note == f"{r.r}/{r.c}" for r in found.collect())


@pytest.mark.parametrize("tile", [5, 8, 256])
def test_similarity_on_any_tiles(spark, tile):
    a, cells = grid(spark, 13, 17)
    b = np.round(a + np.random.default_rng(1).normal(size=a.shape), 2)
    pairs = cells.withColumnRenamed("dem", "o").join(spark.createDataFrame([(r, c, float(b[r, c])) for r in range(13) for c in range(17)], "r int, c int, p double"), ["r", "c"])
    span = a.max() - a.min()
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    each = []
    for r in range(3, 10):
        for c in range(3, 14):
            x, y = a[r - 3 : r + 4, c - 3 : c + 4].ravel(), b[r - 3 : r + 4, c - 3 : c + 4].ravel()
            v = np.cov(x, y)
            each.append((2 * x.mean() * y.mean() + c1) * (2 * v[0, 1] + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (v[0, 0] + v[1, 1] + c2)))
    found = stencil.ssim(pairs, ["scene"], "o", "p", F.lit(True), tile=tile).collect()
    assert len(found) == 1 and found[0].ssim == pytest.approx(np.mean(each), rel=1e-9)
    assert stencil.ssim(pairs, ["scene"], "o", "p", F.col("r") < 0, tile=tile).first().ssim is None


def test_one_exchange(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cells = spark.range(400).selectExpr("'g' AS scene", "cast(id div 20 as int) AS r", "cast(id % 20 as int) AS c", "cast(id as double) AS dem")
        stencil.slope_horn(cells).explain()
        assert capsys.readouterr().out.count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
