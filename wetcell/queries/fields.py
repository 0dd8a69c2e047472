"""Queries and SQL of distances, stencils, costs, regions and pipelines (N, C, L, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetcell.functions import cell
from wetcell.operators import cost, distance, regions, stencil
from wetcell.plans import growth, pluvial, validation
from wetcell.queries import oracles
from wetcell.queries.fixtures import CAP, EMB_SQL, F4, REACH, SCN2_SQL, SCN_SQL, emb, scn, water
from wetcell.storage import durable

QUERIES, SQL = {}, {}
KEY = ("scene", "r", "c")
TILE, PLAN_TILE = 24, 48  # smaller than a scene, so that labels cross tiles
THREE = {"linear": {"decay_frac": 0.001}, "slope_linear": {"decay_frac": 0.0001}, "slope_power": {"c": 0.00001, "n": 1.1}}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def partial(spark, sf: str, scenes: bool = False) -> DataFrame:
    fine = (scn if scenes else emb)(spark, sf)
    return growth.resampled(fine, water(fine), F4)


def grown(spark, sf: str, scenes: bool = False, **settings) -> DataFrame:
    fine = (scn if scenes else emb)(spark, sf)
    own = growth.Settings(**{"cap": 2, "tile": PLAN_TILE, **settings})
    coarse = water(fine)
    return growth.grown(growth.resampled(fine, coarse, F4), coarse, F4, own)


def downscaled(spark, sf: str, scenes: bool = False, **settings) -> DataFrame:
    fine = (scn if scenes else emb)(spark, sf)
    return growth.downscale(fine, water(fine), F4, growth.Settings(**{"cap": 2, "tile": PLAN_TILE, **settings}))


def near_sql(measure: str, most: int) -> str:
    """The nearest wet cell by brute force."""
    return f""", brute AS (
  SELECT scene, r, c, min(row({measure}, (sr - r) * (sr - r) + (sc - c) * (sc - c), sr, sc, v)) AS n
  FROM wp JOIN (SELECT scene, r AS sr, c AS sc, wse2 AS v FROM wp WHERE wse2 IS NOT NULL) s USING (scene)
  WHERE abs(sr - r) <= {REACH} AND abs(sc - c) <= {REACH} AND {measure} <= {most} GROUP BY ALL)
"""


for metric, measure, most, number in (
    ("chessboard", "greatest(abs(sr - r), abs(sc - c))", REACH, 1),
    ("taxicab", "(abs(sr - r) + abs(sc - c))", REACH, 2),
    ("euclidean", "((sr - r) * (sr - r) + (sc - c) * (sc - c))", REACH * REACH, 3),
):
    d = "sqrt(n[1]::DOUBLE)" if metric == "euclidean" else "n[1]::DOUBLE"
    query(f"n{number}_distance_{metric}", EMB_SQL + near_sql(measure, most) + f"SELECT f.scene, f.r, f.c, {d} AS d, n[3] AS sr, n[4] AS sc FROM fine f LEFT JOIN brute USING (scene, r, c)")(
        lambda spark, sf, m=metric: distance.nearest_within(partial(spark, sf), "wse2", REACH, m).select(*KEY, "near.d", "near.sr", "near.sc")
    )
    every = f""", every AS (SELECT scene, r, c, min(row({measure}, (sr - r) * (sr - r) + (sc - c) * (sc - c), sr, sc)) AS n
  FROM wp JOIN (SELECT scene, r AS sr, c AS sc FROM wp WHERE wse2 IS NOT NULL) s USING (scene) GROUP BY ALL)
"""
    query(f"n{number}_distance_{metric}_unbounded", EMB_SQL + every + f"SELECT f.scene, f.r, f.c, {d} AS d, n[3] AS sr, n[4] AS sc FROM fine f LEFT JOIN every USING (scene, r, c)")(
        lambda spark, sf, m=metric: distance.nearest(partial(spark, sf), "wse2", m).select(*KEY, "near.d", "near.sr", "near.sc")
    )


@query("n4_brute_force", EMB_SQL + near_sql("((sr - r) * (sr - r) + (sc - c) * (sc - c))", 2 * REACH * REACH) + "SELECT scene, r, c, n[1] AS d, n[3] AS sr, n[4] AS sc, n[5] AS v FROM brute")
def n4(spark, sf):
    return distance.brute_force(durable(partial(spark, sf)), "wse2", REACH)


@query("n5_nearest_fill", SCN_SQL + near_sql("greatest(abs(sr - r), abs(sc - c))", REACH) + "SELECT f.scene, f.r, f.c, n[5] AS fill FROM fine f LEFT JOIN brute USING (scene, r, c)")
def n5(spark, sf):
    return distance.filled(partial(spark, sf, True), "wse2", "fill", REACH).select(*KEY, "fill")


@query("n5_nearest_fill_fine_unbounded", SCN_SQL + """, all_ AS (
  SELECT scene, r, c, min(row(greatest(abs(sr - r), abs(sc - c)), (sr - r) * (sr - r) + (sc - c) * (sc - c), sr, sc, v)) AS n
  FROM wp JOIN (SELECT scene, r AS sr, c AS sc, wse2 AS v FROM wp WHERE wse2 IS NOT NULL) s USING (scene) GROUP BY ALL)
SELECT f.scene, f.r, f.c, n[5] AS fill FROM fine f LEFT JOIN all_ USING (scene, r, c)""")
def n5_fine_unbounded(spark, sf):
    return distance.filled(partial(spark, sf, True), "wse2", "fill", None).select(*KEY, "fill")


@query("n5_nearest_fill_unbounded", SCN_SQL + """SELECT k.scene, k.br, k.bc, (SELECT min(row(greatest(abs(s.br - k.br), abs(s.bc - k.bc)), (s.br - k.br) * (s.br - k.br) + (s.bc - k.bc) * (s.bc - k.bc), s.br, s.bc, s.wse))
  FROM coarse s WHERE s.scene = k.scene AND s.wse IS NOT NULL)[5] AS fill FROM coarse k""")
def n5_unbounded(spark, sf):
    cells = water(scn(spark, sf)).withColumnsRenamed({"br": "r", "bc": "c"})
    return distance.nearest(cells, "wse").select("scene", F.col("r").alias("br"), F.col("c").alias("bc"), F.col("near.v").alias("fill"))


#: dem with a border of cells that go on in a straight line: x along rows, then y along columns
EDGES = """, size AS (SELECT scene, max(r) AS h, max(c) AS w FROM fine GROUP BY scene),
wide AS (
  SELECT scene, r, c, dem FROM fine
  UNION ALL SELECT a.scene, a.r, -1, 2 * a.dem - b.dem FROM fine a JOIN fine b ON a.scene = b.scene AND a.r = b.r AND a.c = 0 AND b.c = 1
  UNION ALL SELECT a.scene, a.r, w + 1, 2 * a.dem - b.dem FROM fine a JOIN size s USING (scene) JOIN fine b ON a.scene = b.scene AND a.r = b.r AND a.c = w AND b.c = w - 1),
full_ AS (
  SELECT * FROM wide
  UNION ALL SELECT a.scene, -1, a.c, 2 * a.dem - b.dem FROM wide a JOIN wide b ON a.scene = b.scene AND a.c = b.c AND a.r = 0 AND b.r = 1
  UNION ALL SELECT a.scene, h + 1, a.c, 2 * a.dem - b.dem FROM wide a JOIN size s USING (scene) JOIN wide b ON a.scene = b.scene AND a.c = b.c AND a.r = h AND b.r = h - 1)
"""


@query("n6_slope_horn", SCN_SQL + EDGES + """, g AS (
  SELECT f.scene, f.r, f.c, sum((n.c - f.c) * (2 - abs(n.r - f.r)) * n.dem) AS gx, sum((n.r - f.r) * (2 - abs(n.c - f.c)) * n.dem) AS gy
  FROM fine f JOIN full_ n ON n.scene = f.scene AND abs(n.r - f.r) <= 1 AND abs(n.c - f.c) <= 1 GROUP BY ALL)
SELECT scene, r, c, round(100 * sqrt(gx * gx + gy * gy) / (8 * 2.0), 6) AS slope FROM g""")
def n6(spark, sf):
    return stencil.slope_horn(scn(spark, sf), scale=2.0, tile=TILE).select(*KEY, F.round("slope", 6).alias("slope"))


@query("n7_slope_zt", SCN_SQL + EDGES + """, g AS (
  SELECT f.scene, f.r, f.c, sum((n.c - f.c) * n.dem) / 4.0 AS gx, sum((n.r - f.r) * n.dem) / 4.0 AS gy
  FROM fine f JOIN full_ n ON n.scene = f.scene AND abs(n.r - f.r) + abs(n.c - f.c) <= 1 GROUP BY ALL)
SELECT scene, r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM g""")
def n7(spark, sf):
    return stencil.slope_zt(scn(spark, sf), size=2.0, tile=TILE).select(*KEY, F.round("slope", 6).alias("slope"))


@query("n8_hillshade", SCN_SQL + """, size AS (SELECT scene, max(r) AS h, max(c) AS w FROM fine GROUP BY scene),
g AS (
  SELECT f.scene, f.r, f.c, (e.dem - v.dem) / (e.c - v.c) AS gx, (s.dem - n.dem) / (s.r - n.r) AS gy FROM fine f JOIN size z USING (scene)
  JOIN fine e ON e.scene = f.scene AND e.r = f.r AND e.c = least(f.c + 1, w) JOIN fine v ON v.scene = f.scene AND v.r = f.r AND v.c = greatest(f.c - 1, 0)
  JOIN fine s ON s.scene = f.scene AND s.c = f.c AND s.r = least(f.r + 1, h) JOIN fine n ON n.scene = f.scene AND n.c = f.c AND n.r = greatest(f.r - 1, 0)),
t AS (SELECT *, pi() / 2 - atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(-gx, gy) AS aspect FROM g),
u AS (SELECT *, sin(radians(45)) * sin(slope) + cos(radians(45)) * cos(slope) * cos(radians(315) - aspect) AS shade FROM t)
SELECT scene, r, c, round((shade - min(shade) OVER w) / (max(shade) OVER w - min(shade) OVER w), 6) AS shade FROM u WINDOW w AS (PARTITION BY scene)""")
def n8(spark, sf):
    return stencil.hillshade(scn(spark, sf), tile=TILE).select(*KEY, F.round("shade", 6).alias("shade"))


def predicted(spark, sf: str) -> DataFrame:
    """obs: the terrain's height over -100; pred: the same, shifted by a pattern."""
    rows = scn(spark, sf)
    obs = F.greatest(F.col("dem") + 100, F.lit(0.0)) / 256
    return rows.select(*KEY, obs.alias("obs"), F.greatest(obs + (F.col("r") * 7 + F.col("c") * 3) % 11 / 64.0 - 0.0625, F.lit(0.0)).alias("pred"))


PRED = """, pair AS (SELECT scene, r, c, greatest(dem + 100, 0) / 256 AS obs, greatest(greatest(dem + 100, 0) / 256 + ((r * 7 + c * 3) % 11) / 64.0::DOUBLE - 0.0625::DOUBLE, 0) AS pred FROM fine)
"""


@query("n9_ssim", SCN_SQL + PRED + """, w AS (
  SELECT a.scene, a.r, a.c, avg(b.obs) AS x, avg(b.pred) AS y, avg(b.obs * b.obs) AS xx, avg(b.pred * b.pred) AS yy, avg(b.obs * b.pred) AS xy
  FROM pair a JOIN pair b ON a.scene = b.scene AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 WHERE a.r BETWEEN 3 AND 96 AND a.c BETWEEN 3 AND 60 GROUP BY ALL),
k AS (SELECT scene, power(0.01 * (max(obs) - min(obs)), 2) AS c1, power(0.03 * (max(obs) - min(obs)), 2) AS c2 FROM pair GROUP BY scene)
SELECT scene, round(avg((2 * x * y + c1) * (2 * (xy - x * y) * 49 / 48 + c2) / ((x * x + y * y + c1) * ((xx - x * x + yy - y * y) * 49 / 48 + c2))), 6) AS ssim FROM w JOIN k USING (scene) GROUP BY scene""")
def n9(spark, sf):
    return stencil.ssim(predicted(spark, sf), ["scene"], "obs", "pred", F.lit(True), tile=TILE).select("scene", F.round("ssim", 6).alias("ssim"))


@query("n10_ssim_chips", SCN_SQL + PRED + """, g AS (SELECT k, exp(-k * k / 4.5) / (SELECT sum(exp(-k * k / 4.5)) FROM range(-5, 6) t(k)) AS g FROM range(-5, 6) t(k)),
w AS (
  SELECT a.scene, a.r, a.c, sum(gi.g * gj.g * b.obs) AS x, sum(gi.g * gj.g * b.pred) AS y, sum(gi.g * gj.g * b.obs * b.obs) AS xx, sum(gi.g * gj.g * b.pred * b.pred) AS yy, sum(gi.g * gj.g * b.obs * b.pred) AS xy
  FROM pair a JOIN pair b ON a.scene = b.scene AND abs(a.r - b.r) <= 5 AND abs(a.c - b.c) <= 5 JOIN g gi ON gi.k = b.r - a.r JOIN g gj ON gj.k = b.c - a.c
  WHERE a.r BETWEEN 5 AND 94 AND a.c BETWEEN 5 AND 58 GROUP BY ALL)
SELECT scene, round(avg((2 * x * y + 0.0001) * (2 * (xy - x * y) + 0.0009) / ((x * x + y * y + 0.0001) * (xx - x * x + yy - y * y + 0.0009))), 6) AS ssim FROM w GROUP BY scene""")
def n10(spark, sf):
    return stencil.ssim_chips(predicted(spark, sf), ["scene"], "obs", "pred", tile=TILE).select("scene", F.round("ssim", 6).alias("ssim"))


@query("n11_uniform_distance", SCN_SQL + oracles.allocated("lab", "SELECT scene, r, c, CASE WHEN c % 13 <> 0 THEN 1 END AS cost, wse2 IS NOT NULL AS src FROM wp") + f"SELECT scene, r, c, k[1]::DOUBLE / {oracles.GRAIN} AS d FROM lab")
def n11(spark, sf):
    return cost.uniform_distance(partial(spark, sf, True), "wse2", F.col("c") % 13 != 0, tile=TILE)


@query("c1_node_cost_d4", SCN_SQL + """SELECT f.scene, f.r, f.c, (SELECT min(abs(s.sr - f.r) + abs(s.sc - f.c)) FROM (SELECT scene, r AS sr, c AS sc FROM wp WHERE wse2 IS NOT NULL) s WHERE s.scene = f.scene)::DOUBLE AS d FROM fine f""")
def c1(spark, sf):
    """At a uniform cost node distances are taxicab distances, which SQL can tell."""
    rows = partial(spark, sf, True).withColumn("one", F.lit(1.0))
    return cost.allocated(rows, "one", "wse2", model="node", tile=TILE).select(*KEY, "d")


def penalty(spark, sf: str) -> DataFrame:
    return partial(spark, sf, True).withColumn("cost", F.when(F.col("dem") < 250, 1 + F.abs("dem") / 64))


PENALTY = SCN_SQL + oracles.allocated("lab", "SELECT scene, r, c, CASE WHEN dem < 250 THEN 1 + abs(dem) / 64 END AS cost, wse2 IS NOT NULL AS src FROM wp")


@query("c1_node_cost_d4_varying", SCN_SQL + oracles.allocated("lab", "SELECT scene, r, c, CASE WHEN dem < 250 THEN 1 + abs(dem) / 64 END AS cost, wse2 IS NOT NULL AS src FROM wp", node=True) + f"SELECT scene, r, c, k[1]::DOUBLE / {oracles.GRAIN} AS d, k[2] AS sr, k[3] AS sc FROM lab")
def c1_varying(spark, sf):
    return cost.allocated(durable(penalty(spark, sf)), "cost", "wse2", model="node", tile=TILE).select(*KEY, "d", "sr", "sc")


@query("c2_accumulated_cost", PENALTY + f"SELECT scene, r, c, round(k[1]::DOUBLE / {oracles.GRAIN}, 6) AS d FROM lab")
def c2(spark, sf):
    return cost.allocated(durable(penalty(spark, sf)), "cost", "wse2", tile=TILE).select(*KEY, F.round("d", 6).alias("d"))


SLOPE = EDGES + """, slopes AS (
  SELECT scene, r, c, 100 * sqrt(gx * gx + gy * gy) / 8.0::DOUBLE AS slope FROM (
    SELECT f.scene, f.r, f.c, sum((n.c - f.c) * (2 - abs(n.r - f.r)) * n.dem) AS gx, sum((n.r - f.r) * (2 - abs(n.c - f.c)) * n.dem) AS gy
    FROM fine f JOIN full_ n ON n.scene = f.scene AND abs(n.r - f.r) <= 1 AND abs(n.c - f.c) <= 1 GROUP BY ALL))
""" + oracles.allocated("climb", "SELECT scene, r, c, slope AS cost, wse2 IS NOT NULL AS src FROM slopes JOIN wp USING (scene, r, c)") + f", acc AS (SELECT scene, r, c, k[1]::DOUBLE / {oracles.GRAIN} AS accumulated FROM climb)\n"


@query("c3_accumulated_slope", SCN_SQL + SLOPE + "SELECT scene, r, c, accumulated FROM acc")
def c3(spark, sf):
    rows = durable(stencil.slope_horn(partial(spark, sf, True)))
    return cost.accumulated_slope(rows, "slope", "wse2", tile=TILE)


@query("c4_cost_allocation", PENALTY + oracles.valued("lab", "wp", "wse2", "fill") + "SELECT scene, r, c, fill FROM fine LEFT JOIN lab_v USING (scene, r, c)")
def c4(spark, sf):
    return cost.cost_fill(durable(penalty(spark, sf)), "wse2", "cost", "fill", tile=TILE).select(*KEY, "fill")


@query("c5_zones", PENALTY + "SELECT scene, r, c, (k[2] * 64 + k[3])::BIGINT AS zone FROM fine LEFT JOIN lab USING (scene, r, c)")
def c5(spark, sf):
    return cost.cost_fill(durable(penalty(spark, sf)), "wse2", "cost", "fill", tile=TILE).select(*KEY, F.col("fill_zone").alias("zone"))


@query("c6_barriers", SCN_SQL + """, open_ AS (SELECT scene, r, c, wse2 FROM wp WHERE c % 9 <> 4),
lane AS (SELECT *, c // 9 + (c % 9 > 4)::INTEGER AS lane FROM open_)
SELECT f.scene, f.r, f.c, (SELECT min(abs(s.r - f.r) + abs(s.c - f.c)) FROM lane s WHERE s.scene = f.scene AND s.lane = f.lane AND s.wse2 IS NOT NULL)::DOUBLE AS d
FROM lane f WHERE d IS NOT NULL""")
def c6(spark, sf):
    """Walls at every ninth column: paths stay in their lane."""
    rows = partial(spark, sf, True).withColumn("one", F.when(F.col("c") % 9 != 4, 1.0))
    return cost.allocated(rows, "one", "wse2", model="node", tile=TILE).select(*KEY, "d")


@query("c6_barriers_varying", SCN_SQL + oracles.allocated("lab", "SELECT scene, r, c, CASE WHEN r % 7 <> 3 OR c % 5 = 0 THEN 1 + abs(dem) / 64 WHEN c % 2 = 0 THEN -1 END AS cost, wse2 IS NOT NULL AND c < 20 AS src FROM wp") + f"SELECT scene, r, c, k[1]::DOUBLE / {oracles.GRAIN} AS d FROM lab")
def c6_varying(spark, sf):
    """Walls of null and negative costs with a gap at every fifth column, sources at the left alone: paths go around."""
    price = F.when((F.col("r") % 7 != 3) | (F.col("c") % 5 == 0), 1 + F.abs("dem") / 64).when(F.col("c") % 2 == 0, -1.0)
    rows = partial(spark, sf, True).withColumns({"cost": price, "source": F.when(F.col("c") < 20, F.col("wse2"))})
    return cost.allocated(durable(rows), "cost", "source", tile=TILE).select(*KEY, "d")


@query("c7_backlinks", PENALTY + oracles.backlinks("lab") + "SELECT scene, r, c, pr, pc FROM lab_b")
def c7(spark, sf):
    return cost.allocated(durable(penalty(spark, sf)), "cost", "wse2", tile=TILE).select(*KEY, "pr", "pc")


@query("c8_paths", PENALTY + oracles.backlinks("lab") + """, walk AS (
  SELECT scene, r, c, 0::BIGINT AS steps, r AS sr, c AS sc FROM lab_b WHERE pr IS NULL
  UNION ALL
  SELECT b.scene, b.r, b.c, w.steps + 1, w.sr, w.sc FROM walk w JOIN lab_b b ON b.scene = w.scene AND b.pr = w.r AND b.pc = w.c)
SELECT scene, r, c, steps, sr, sc FROM walk""")
def c8(spark, sf):
    links = durable(cost.allocated(durable(penalty(spark, sf)), "cost", "wse2", tile=TILE))
    return cost.paths(links.select(*KEY, "pr", "pc"), tile=TILE)


@query("c9_target_mask", PENALTY + oracles.valued("lab", "wp", "wse2", "fill") + "SELECT scene, r, c, CASE WHEN r % 2 = 0 THEN fill ELSE wse2 END AS fill FROM wp LEFT JOIN lab_v USING (scene, r, c)")
def c9(spark, sf):
    return cost.cost_fill(durable(penalty(spark, sf)), "wse2", "cost", "fill", target=F.col("r") % 2 == 0, tile=TILE).select(*KEY, "fill")


@query("c10_terrain_fill", SCN_SQL + oracles.TERRAIN + "SELECT scene, r, c, fill FROM fine LEFT JOIN paid_v USING (scene, r, c)")
def c10(spark, sf):
    fine = scn(spark, sf)
    coarse = water(fine)
    rows = durable(growth.resampled(fine, coarse, F4))
    return growth.terrain_fill(rows, coarse, F4, growth.Settings(tile=TILE)).select(*KEY, "fill")


@query("c11_fill_inputs", SCN_SQL + """SELECT scene, n AS wet, cells, CASE WHEN low > 0 THEN 'negative costs' WHEN n = 0 THEN 'no wet cell' WHEN n = cells THEN 'nothing to fill' ELSE 'fill' END AS state
FROM (SELECT scene, count(*) AS cells, count(*) FILTER (k % 3 = 1 AND r = 5 AND dem < 0) AS low, count(CASE WHEN k % 3 = 2 THEN dem WHEN k % 4 <> 0 THEN wse2 END) AS n
  FROM (SELECT *, scene[2:]::INTEGER AS k FROM wp) GROUP BY scene)""")
def c11(spark, sf):
    """Scenes without a wet cell, without a dry one, with negative costs and with something to fill."""
    kind = F.substring("scene", 2, 9).cast("int")
    value = F.when(kind % 3 == 2, F.col("dem")).when(kind % 4 != 0, F.col("wse2"))
    price = F.when((kind % 3 == 1) & (F.col("r") == 5), F.col("dem")).otherwise(1.0)
    return cost.fill_inputs(partial(spark, sf, True).withColumns({"value": value, "price": price}), "value", "price")


@query("c11_nothing_to_fill", SCN_SQL + "SELECT scene, r, c, dem::DOUBLE AS fill, 0::DOUBLE AS fill_cost, (r * 64 + c)::BIGINT AS fill_zone FROM fine")
def c11_full(spark, sf):
    rows = scn(spark, sf).withColumns({"value": F.col("dem").cast("double"), "price": F.lit(1.0)})
    return cost.cost_fill(rows, "value", "price", "fill", tile=TILE).select(*KEY, "fill", "fill_cost", "fill_zone")


@query("p8_linear_decay", EMB_SQL + "SELECT scene, r, c, CASE WHEN wse2 IS NULL THEN away * 0.001::DOUBLE ELSE 0 END AS v FROM grown")
def p8(spark, sf):
    return grown(spark, sf).select(*KEY, cell.linear_decay(F.col("wse2").isNull(), F.col("away"), 0.001).alias("v"))


@query("p12_growth_cap", EMB_SQL + "SELECT scene, r, c, within FROM grown")
def p12(spark, sf):
    return grown(spark, sf).select(*KEY, "within")


@query("p13_infill", EMB_SQL + "SELECT scene, r, c, wse3 FROM grown")
def p13(spark, sf):
    return grown(spark, sf).select(*KEY, "wse3")


LABELS = """, wet AS (SELECT scene, r, c, wse2 FROM wp WHERE wse2 IS NOT NULL AND (r + c) % 5 <> 0),
label AS (
  SELECT scene, r, c, r * 1000 + c AS first FROM wet
  UNION
  SELECT w.scene, w.r, w.c, l.first FROM label l JOIN wet w ON w.scene = l.scene AND w.r BETWEEN l.r - 1 AND l.r + 1 AND w.c BETWEEN l.c - 1 AND l.c + 1 AND abs(w.r - l.r) + abs(w.c - l.c) = 1
  WHERE l.first < w.r * 1000 + w.c),
region AS (SELECT scene, r, c, min(first) AS first FROM label GROUP BY ALL)
"""


def wet_regions(spark, sf: str) -> DataFrame:
    flags = partial(spark, sf, True).select(*KEY, (F.col("wse2").isNotNull() & ((F.col("r") + F.col("c")) % 5 != 0)).alias("on"), (F.col("c") % 16 == 2).alias("anchor"))
    return regions.labelled(flags, "on")


@query("l1_regions", SCN_SQL + LABELS + "SELECT scene, r, c, first FROM region")
def l1(spark, sf):
    return wet_regions(spark, sf).select(*KEY, (F.col("region.r") * 1000 + F.col("region.c")).alias("first"))


@query("l2_region_sizes", SCN_SQL + LABELS + "SELECT scene, first, count(*) AS cells FROM region GROUP BY ALL")
def l2(spark, sf):
    return regions.sizes(wet_regions(spark, sf)).select("scene", (F.col("region.r") * 1000 + F.col("region.c")).alias("first"), "cells")


@query("l3_touching", SCN_SQL + LABELS + "SELECT scene, r, c FROM region WHERE (scene, first) IN (SELECT (scene, first) FROM region WHERE c % 16 = 2)")
def l3(spark, sf):
    return regions.touching(durable(wet_regions(spark, sf)), "anchor").select(*KEY)


@query("l3_isolated_counts", EMB_SQL + """SELECT scene, count(wse3) AS cells_before, count(wse4) AS cells_after FROM final GROUP BY scene""")
def l3_counts(spark, sf):
    return regions.isolated_counts(durable(grown(spark, sf)), "wse3", "wse2").select("scene", "cells_before", "cells_after")


@query("l4_small_groups", SCN_SQL + LABELS + "SELECT f.scene, f.r, f.c, coalesce(n <= 3, false) AS small FROM fine f LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY scene, first) AS n FROM region) USING (scene, r, c)")
def l4(spark, sf):
    flags = partial(spark, sf, True).select(*KEY, (F.col("wse2").isNotNull() & ((F.col("r") + F.col("c")) % 5 != 0)).alias("on"))
    return regions.small_groups(flags, "on", 3).select(*KEY, "small")


@query("x1_neutral", EMB_SQL + "SELECT scene, r, c, wse1, wse2, wse3, wse4 FROM final")
def x1(spark, sf):
    return downscaled(spark, sf).select(*KEY, "wse1", "wse2", "wse3", "wse4")


@query("x1_checked", SCN_SQL + "SELECT scene, r, c, wse1, wse2, wse3, wse4 FROM final")
def x1_checked(spark, sf):
    """With the rules of inputs, phases and result, counted as the phases are written."""
    fine = scn(spark, sf)
    return growth.checked(fine, water(fine), F4, CAP).select(*KEY, "wse1", "wse2", "wse3", "wse4")


@query("x1_neutral_euclidean", EMB_SQL + oracles.downscaled("e", "euclidean", 2.6) + "SELECT scene, r, c, within, wse3, wse4 FROM final_e")
def x1_euclidean(spark, sf):
    """A cap that is no whole number of cells."""
    return downscaled(spark, sf, cap=2.6, distance_fill_method="euclidean").select(*KEY, "within", "wse3", "wse4")


@query("x1_neutral_depth", EMB_SQL + "SELECT scene, r, c, greatest(coalesce(wse4, dem) - dem, 0) AS wsh FROM final")
def x1_depth(spark, sf):
    return downscaled(spark, sf, as_wsh=True).select(*KEY, "wsh")


@query("x9_many_scenes", SCN_SQL + "SELECT scene, count(wse2) AS partial, count(wse3) AS grown, count(wse4) AS final, sum(wse2) AS total FROM final GROUP BY scene")
def x9(spark, sf):
    return downscaled(spark, sf, True).groupBy("scene").agg(F.count("wse2").alias("partial"), F.count("wse3").alias("grown"), F.count("wse4").alias("final"), F.sum("wse2").alias("total"))


EVEN, ODD = "scene[2:]::INTEGER % 2 = 0", "scene[2:]::INTEGER % 2 = 1"
RATIOS = " UNION ALL ".join(f"SELECT * FROM ({sql} SELECT scene, r, c, within, wse1, wse2, wse3, wse4 FROM final WHERE {own})" for sql, own in ((SCN_SQL, EVEN), (SCN2_SQL, ODD)))


def two_ratios(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scenes of ratio 4 and of ratio 2, by turns; fine has a column f."""
    fine = scn(spark, sf).withColumn("f", F.when(F.substring("scene", 2, 9).cast("int") % 2 == 0, 4).otherwise(2))
    coarse = [water(fine.filter(F.col("f") == f).drop("f"), f) for f in (4, 2)]
    return fine, coarse[0].unionByName(coarse[1])


@query("x9_many_ratios", RATIOS)
def x9_ratios(spark, sf):
    fine, coarse = two_ratios(spark, sf)
    return growth.downscale(fine, coarse, "f", growth.Settings(cap=2)).select(*KEY, "within", "wse1", "wse2", "wse3", "wse4")


@query("x6_many_runs", SCN_SQL + oracles.downscaled("e", "euclidean", 2.6) + oracles.downscaled("t", "taxicab", 1) + """SELECT 'a' AS run_name, scene, r, c, within, wse3, wse4 FROM final
UNION ALL SELECT 'b', scene, r, c, within, wse3, wse4 FROM final_e UNION ALL SELECT 'c', scene, r, c, within, wse3, wse4 FROM final_t""")
def x6_runs(spark, sf):
    """Runs of three metrics and caps as data: one chain of jobs."""
    fine = scn(spark, sf)
    runs = {"a": growth.Settings(cap=2), "b": growth.Settings(cap=2.6, distance_fill_method="euclidean"), "c": growth.Settings(cap=1, distance_fill_method="taxicab")}
    return growth.downscale_runs(fine, water(fine), F4, runs).select("run_name", *KEY, "within", "wse3", "wse4")


NO_SLOPES = ", acc AS (SELECT scene, r, c, 0.0::DOUBLE AS accumulated FROM fine)\n"
LINEAR = "CASE WHEN wse2 IS NULL THEN g.away * 0.001::DOUBLE ELSE 0 END"
DECAYS = f"{LINEAR} + accumulated * 0.0001::DOUBLE + pow(accumulated, 1.1::DOUBLE) * 0.00001::DOUBLE".replace("wse2", "w.wse2")
TERRAIN = oracles.TERRAIN.replace("full_", "filled_")


@query("p11_sum_of_decays", SCN_SQL + SLOPE + f"SELECT w.scene, w.r, w.c, round({DECAYS}, 6) AS v FROM wp w JOIN grown g USING (scene, r, c) JOIN acc USING (scene, r, c)")
def p11(spark, sf):
    own = growth.Settings(cap=2, tile=PLAN_TILE, decay=THREE)
    rows = distance.filled(partial(spark, sf, True), "wse2", "fill", own.reach(F4)).withColumnRenamed("fill_d", "away")
    rows, total = growth.decay(durable(rows), own)
    return rows.select(*KEY, F.round(total, 6).alias("v"))


@query("x2_terrain_penalty", SCN_SQL + SLOPE + TERRAIN + oracles.penalised("p", DECAYS) + "SELECT scene, r, c, round(wse4, 6) AS wse4 FROM final_p")
def x2(spark, sf):
    return downscaled(spark, sf, True, distance_fill="terrain_penalty", decay=THREE).select(*KEY, F.round("wse4", 6).alias("wse4"))


@query("x3_pluvial", SCN_SQL + oracles.PLUVIAL + "SELECT scene, r, c, round(wse_base, 10) AS wse_base, round(CASE WHEN layer IS NULL THEN wse ELSE coalesce(wse, dem) + layer END, 10) AS wse FROM over")
def x3(spark, sf):
    fine = scn(spark, sf)
    own = lambda a, b, f: growth.downscale(a, b, f, CAP)
    rained = water(fine).withColumn("wse", F.col("wse") + F.expr("(br * 7 + bc * 3) % 11 * 8"))
    rows = pluvial.downscale(fine, pluvial.coarse_depth(fine, rained, F4), F4, project=own, filter_depth=None, small_pixel_count=2, reapply_small_groups=True)
    return rows.select(*KEY, *(F.round(x, 10).alias(x) for x in ("wse_base", "wse")))


MCP = oracles.allocated("plain", "SELECT scene, r, c, 1 AS cost, wse2 IS NOT NULL AS src FROM wp") + oracles.valued("plain", "wp", "wse2", "flat") + oracles.allocated(
    "dear", "SELECT w.scene, w.r, w.c, CASE WHEN flat - dem > 0 THEN 1 ELSE 1 + abs(flat - dem) * 0.01::DOUBLE END AS cost, wse2 IS NOT NULL AS src FROM wp w JOIN plain_v USING (scene, r, c)"
) + oracles.valued("dear", "wp", "wse2", "fill") + """, merged AS (
  SELECT w.*, CASE WHEN wse2 IS NOT NULL THEN wse2 WHEN flat_cost / 4 <= 2 AND fill - flat_cost * 0.001::DOUBLE > dem THEN fill - flat_cost * 0.001::DOUBLE END AS wse3
  FROM wp w LEFT JOIN plain_v USING (scene, r, c) LEFT JOIN dear_v USING (scene, r, c))
"""


@query("p14_mcp_merge", SCN_SQL + MCP + "SELECT scene, r, c, round(wse3, 6) AS wse3 FROM merged")
def p14(spark, sf):
    fine = scn(spark, sf)
    return growth.downscale_mcp(fine, water(fine), F4, cap=2, scale=0.01, tile=PLAN_TILE).select(*KEY, F.round("wse3", 6).alias("wse3"))


@query("x4_mcp", SCN_SQL + MCP + oracles.isolated("m", "merged") + "SELECT scene, r, c, round(wse4, 6) AS wse4 FROM final_m")
def x4(spark, sf):
    fine = scn(spark, sf)
    return growth.downscale_mcp(fine, water(fine), F4, cap=2, scale=0.01, tile=PLAN_TILE).select(*KEY, F.round("wse4", 6).alias("wse4"))


SHADE = """, shaded AS (
  SELECT scene, r, c, (shade - min(shade) OVER w) / (max(shade) OVER w - min(shade) OVER w) AS shade FROM (
    SELECT scene, r, c, sin(radians(45)) * sin(pi() / 2 - atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * cos(pi() / 2 - atan(sqrt(gx * gx + gy * gy))) * cos(radians(315) - atan2(-gx, gy)) AS shade FROM (
      SELECT f.scene, f.r, f.c, (e.dem - v.dem) / (e.c - v.c) AS gx, (s.dem - n.dem) / (s.r - n.r) AS gy FROM fine f JOIN (SELECT scene, max(r) AS h, max(c) AS w FROM fine GROUP BY scene) z USING (scene)
      JOIN fine e ON e.scene = f.scene AND e.r = f.r AND e.c = least(f.c + 1, w) JOIN fine v ON v.scene = f.scene AND v.r = f.r AND v.c = greatest(f.c - 1, 0)
      JOIN fine s ON s.scene = f.scene AND s.c = f.c AND s.r = least(f.r + 1, h) JOIN fine n ON n.scene = f.scene AND n.c = f.c AND n.r = greatest(f.r - 1, 0)))
  WINDOW w AS (PARTITION BY scene))
"""


@query("x8_terrain_example", SCN_SQL + NO_SLOPES + TERRAIN + oracles.penalised("p", LINEAR.replace("wse2", "w.wse2")) + SHADE + oracles.allocated(
    "cheap", "SELECT scene, r, c, CASE WHEN wse1 - dem > 0 THEN 1 ELSE 1 + abs(wse1 - dem) END AS cost, wse2 IS NOT NULL AS src FROM wp"
) + f"SELECT scene, r, c, round(wse4, 6) AS wse4, round(shade, 6) AS shade, round(k[1]::DOUBLE / {oracles.GRAIN}, 6) AS accumulated, round(CASE WHEN wse2 IS NULL THEN away * 0.001::DOUBLE ELSE 0 END, 6) AS decay FROM final_p JOIN shaded USING (scene, r, c) LEFT JOIN cheap USING (scene, r, c)")
def x8(spark, sf):
    fine = scn(spark, sf)
    rows = validation.terrain_example(fine, water(fine), F4, growth.Settings(distance_fill="terrain_penalty", cap=2, tile=PLAN_TILE))
    return rows.select(*KEY, *(F.round(x, 6).alias(x) for x in ("wse4", "shade", "accumulated", "decay")))
