"""Queries and SQL of metrics, tables and checks (A, T, Q, and the plans made of them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetcell.functions import cell
from wetcell.operators import checks, metrics, resample, stencil, tables
from wetcell.plans import growth, pluvial, validation
from wetcell.queries import oracles
from wetcell.queries.fields import LINEAR, NO_SLOPES, PRED, TERRAIN, downscaled, grown, partial, predicted
from wetcell.queries.fixtures import CAP, EMB_SQL, F4, SCN_SQL, emb, scn, water
from wetcell.storage import durable

QUERIES, SQL = {}, {}
KEY = ("scene", "r", "c")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


P_ = SCN_SQL + PRED


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


def one(name: str, sql: str, **columns):
    """One aggregate record by scene over obs and pred. Columns are built when the query runs."""
    query(name, P_ + f"SELECT scene, {sql} FROM pair GROUP BY scene")(lambda spark, sf: rounded(predicted(spark, sf).groupBy("scene").agg(*(f().alias(n) for n, f in columns.items()))))


RMSE_SQL = "round(sqrt(avg((pred - obs) * (pred - obs))), 6) AS rmse"
one("a1_rmse_mae_bias", f"{RMSE_SQL}, round(avg(abs(pred - obs)), 6) AS mae, round(avg(pred - obs), 6) AS bias",
    rmse=lambda: metrics.rmse(F.col("pred") - F.col("obs")), mae=lambda: metrics.mae(F.col("pred") - F.col("obs")), bias=lambda: metrics.bias(F.col("pred") - F.col("obs")))
one("a2_rmse_wet", "round(sqrt(avg((pred - obs) * (pred - obs)) FILTER (obs > 0.5)), 6) AS rmse_wet", rmse_wet=lambda: metrics.rmse_wet(F.col("obs"), F.col("pred"), 0.5))
CSI_SQL = "round(count(*) FILTER (obs >= 0.5 AND pred >= 0.5) / count(*) FILTER (obs >= 0.5 OR pred >= 0.5), 6) AS csi"
one("a3_csi", CSI_SQL, csi=lambda: metrics.csi(F.col("obs"), F.col("pred"), 0.5))
one("a4_psnr", "round(20 * log10(max(obs)) - 10 * log10(avg((pred - obs) * (pred - obs))), 6) AS psnr", psnr=lambda: metrics.psnr(F.col("obs"), F.col("pred")))
one("a5_wet_fractions", "round(avg((obs >= 0.5)::INTEGER), 6) AS observed, round(avg((pred >= 0.5)::INTEGER), 6) AS predicted",
    observed=lambda: metrics.wet_fraction(F.col("obs"), 0.5), predicted=lambda: metrics.wet_fraction(F.col("pred"), 0.5))
one("a6_valid_pixels", "count(*) FILTER (obs > 0 AND pred > 0) AS valid_pixels", valid_pixels=lambda: F.count_if((F.col("obs") > 0) & (F.col("pred") > 0)))


@query("a7_metric_record", P_ + """, w AS (
  SELECT a.scene, a.r, a.c, avg(b.obs) AS x, avg(b.pred) AS y, avg(b.obs * b.obs) AS xx, avg(b.pred * b.pred) AS yy, avg(b.obs * b.pred) AS xy
  FROM pair a JOIN pair b ON a.scene = b.scene AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 WHERE a.r BETWEEN 3 AND 96 AND a.c BETWEEN 3 AND 60 GROUP BY ALL),
k AS (SELECT scene, power(0.01 * (max(obs) - min(obs)), 2) AS c1, power(0.03 * (max(obs) - min(obs)), 2) AS c2 FROM pair GROUP BY scene),
s AS (SELECT scene, avg((2 * x * y + c1) * (2 * (xy - x * y) * 49 / 48 + c2) / ((x * x + y * y + c1) * ((xx - x * x + yy - y * y) * 49 / 48 + c2))) AS ssim FROM w JOIN k USING (scene) GROUP BY scene),
m AS (SELECT scene, 20 * log10(max(obs)) - 10 * log10(avg((pred - obs) * (pred - obs))) AS psnr, sqrt(avg((pred - obs) * (pred - obs))) AS rmse,
  sqrt(avg((pred - obs) * (pred - obs)) FILTER (obs > 0.5)) AS rmse_wet, avg(abs(pred - obs)) AS mae, avg(pred - obs) AS bias,
  count(*) FILTER (obs >= 0.01 AND pred >= 0.01) / count(*) FILTER (obs >= 0.01 OR pred >= 0.01) AS csi,
  avg((obs >= 0.01)::INTEGER) AS observed_wet_fraction, avg((pred >= 0.01)::INTEGER) AS predicted_wet_fraction, count(*)::DOUBLE AS valid_pixels FROM pair GROUP BY scene),
l AS (UNPIVOT (SELECT * FROM m JOIN s USING (scene)) ON COLUMNS(* EXCLUDE scene) INTO NAME metric VALUE value)
SELECT scene, metric, round(value, 6) AS value FROM l""")
def a7(spark, sf):
    return rounded(metrics.as_long(metrics.record(predicted(spark, sf), ["scene"], F.lit(True)), ["scene"]))


@query("a8_chip_rmse_wet", P_ + "SELECT round(coalesce(avg(x), 0), 6) AS rmse_wet FROM (SELECT scene, sqrt(avg((pred - obs) * (pred - obs)) FILTER (obs > 0.9)) AS x FROM pair GROUP BY scene)")
def a8(spark, sf):
    return rounded(metrics.chip_rmse_wet(predicted(spark, sf), [], "scene", threshold=0.9))


@query("a9_batch_record", P_ + "SELECT scene, " + CSI_SQL + ", " + RMSE_SQL + ", round(-10 * log10(avg((pred - obs) * (pred - obs))), 6) AS psnr FROM pair GROUP BY scene")
def a9(spark, sf):
    return rounded(metrics.batch_record(predicted(spark, sf), ["scene"], threshold=0.5))


@query("a10_differences", SCN_SQL + "SELECT scene, count(wse1 - dem) AS overlap, avg(abs(wse1 - dem)) AS mae, round(sqrt(avg((wse1 - dem) * (wse1 - dem))), 6) AS rmse, avg(wse1 - dem) AS bias, round(quantile_cont(abs(wse1 - dem), 0.95), 6) AS p95 FROM res GROUP BY scene")
def a10(spark, sf):
    found = metrics.differences(partial(spark, sf, True), ["scene"], "dem", "wse1")
    return found.withColumns({c: F.round(c, 6) for c in ("rmse", "p95")})  # the others are exact


@query("a11_statistics", SCN_SQL + "SELECT scene, min(wse1) AS min, max(wse1) AS max, round(avg(wse1), 6) AS mean, round(stddev_pop(wse1), 6) AS std, count(wse1) AS count FROM res GROUP BY scene")
def a11(spark, sf):
    return rounded(metrics.statistics(partial(spark, sf, True), ["scene"], "wse1"))


GRIDS_SQL = SCN_SQL + ", g AS (SELECT scene, max(r) + 1 AS height, max(c) + 1 AS width FROM fine GROUP BY scene)\n"


def located(spark, sf: str) -> DataFrame:
    """Georeferences of the terrain and the water: degrees in some scenes, metres in the others."""
    shape = scn(spark, sf).groupBy("scene").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    crs = F.when(F.col("scene").isin("s1", "s3"), "EPSG:4326").otherwise("EPSG:3857")
    facts = {"x0": F.lit(8.0), "y0": F.lit(40.0), "crs": crs, "nodata": F.lit(-9999.0)}
    fine = shape.withColumns({"layer": F.lit("dem"), "res_x": F.lit(0.01), "res_y": F.lit(0.02), **facts})
    coarse = shape.withColumns({"layer": F.lit("wse"), "height": F.expr("cast(greatest(height div 4, 1) as int)"), "width": F.expr("cast(width div 4 as int)"), "res_x": F.lit(0.04), "res_y": F.lit(0.08), **facts})
    return fine.unionByName(coarse)


def coarse_depths(spark, sf: str) -> DataFrame:
    fine = scn(spark, sf)
    return pluvial.coarse_depth(fine, water(fine), F4)


DEPTH = SCN_SQL + """, deep AS (SELECT q.*, avg_, greatest(coalesce(wse, avg_) - avg_, 0) AS wsh, floor(abs(coalesce(wse, avg_)) / 20) / 8.0 AS step FROM coarse q
  JOIN (SELECT scene, r // 4 AS br, c // 4 AS bc, avg(dem) AS avg_ FROM fine GROUP BY ALL) USING (scene, br, bc)),
moded AS (SELECT scene, arg_max(step, row(n, -step)) AS mode FROM (SELECT scene, round(step, 3) AS step, count(*) AS n FROM deep GROUP BY ALL) GROUP BY scene)
"""


def stepped(spark, sf: str) -> DataFrame:
    return coarse_depths(spark, sf).withColumn("step", F.floor(F.abs(F.coalesce("wse", "dem")) / 20) / 8.0)


@query("x3_coarse_terrain", SCN_SQL + """SELECT q.scene, br, bc, lo AS dem, greatest(coalesce(wse, lo) - lo, 0) AS wsh FROM coarse q
  JOIN (SELECT scene, r // 4 AS br, c // 4 AS bc, min(dem) AS lo FROM fine GROUP BY ALL) USING (scene, br, bc)""")
def x3_coarse_terrain(spark, sf):
    fine = scn(spark, sf)
    return pluvial.coarse_depth(fine, water(fine), F4, dem_coarse_resampling="min").select("scene", "br", "bc", "dem", "wsh")


@query("a12_mode", DEPTH + "SELECT scene, mode FROM moded")
def a12(spark, sf):
    return metrics.modes(stepped(spark, sf), ["scene"], F.col("step"))


@query("a13_filter_depth", DEPTH + "SELECT scene, round(mode + 0.01::DOUBLE, 6) AS depth FROM moded")
def a13(spark, sf):
    return rounded(metrics.filter_depth(stepped(spark, sf), "step"))


def histogram_sql(where: str) -> str:
    return EMB_SQL + f""", v AS (SELECT wse1 - dem AS v FROM res WHERE wse1 IS NOT NULL{where}), s AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
n AS (SELECT least(floor((v - lo) * 60 / (hi - lo)), 59)::INTEGER AS bin, count(*) AS n FROM v, s GROUP BY ALL)
SELECT 'emb' AS scene, k::INTEGER AS bin, round(lo + k * (hi - lo) / 60, 6) AS low, coalesce(n, 0) AS n FROM range(60) t(k) CROSS JOIN s LEFT JOIN n ON bin = k"""


def deltas(spark, sf: str) -> DataFrame:
    return partial(spark, sf).withColumn("delta", F.col("wse1") - F.col("dem"))


@query("a14_histogram", histogram_sql(""))
def a14(spark, sf):
    return rounded(metrics.histogram(deltas(spark, sf), "delta", 60)).drop("high")


@query("a15_histogram_without_zero", histogram_sql(" AND abs(wse1 - dem) > 1e-8"))
def a15(spark, sf):
    return rounded(metrics.histogram(deltas(spark, sf), "delta", 60, without_zero=True)).drop("high")


@query("a14_zeros_and_nulls", EMB_SQL + "SELECT scene, count(*) FILTER (abs(wse1 - dem) <= 1e-8) AS zeros, count(*) FILTER (wse1 IS NULL) AS nulls FROM res GROUP BY scene")
def a14_zeros(spark, sf):
    return metrics.zeros_and_nulls(deltas(spark, sf), "delta")


@query("a16_phase_counts", EMB_SQL + "SELECT scene, count(wse2) AS partial_wet, count(*) - count(wse2) AS partial_dry, count(wse3) AS grown_wet, count(*) - count(wse3) AS grown_dry, count(*) FILTER (wse3 IS NOT NULL AND wse2 IS NULL) AS grown_grown FROM grown GROUP BY scene")
def a16(spark, sf):
    return metrics.phase_counts(grown(spark, sf), partial="wse2", grown="wse3")


@query("a17_dry_fraction", SCN_SQL + "SELECT scene, avg((wse1 IS NULL)::INTEGER) AS dry_fraction FROM res GROUP BY scene")
def a17(spark, sf):
    return partial(spark, sf, True).groupBy("scene").agg(metrics.dry_fraction(F.col("wse1")).alias("dry_fraction"))


@query("a18_run_metadata", EMB_SQL + "SELECT scene, max(r) + 1 AS height, max(c) + 1 AS width, count(wse1) AS wet1, count(wse2) AS wet2, count(wse3) AS wet3, count(wse4) AS wet4, 4 AS f, 'neutral' AS distance_fill, 'chessboard' AS metric, 2.0::DOUBLE AS cap FROM final GROUP BY scene")
def a18(spark, sf):
    return growth.run_metadata(downscaled(spark, sf), F4, CAP)


@query("a18_run_record", SCN_SQL + """, held AS MATERIALIZED (SELECT scene, r, c, wse2 IS NOT NULL AS anchor FROM grown WHERE wse3 IS NOT NULL),
label AS (
  SELECT scene, r, c, r * 1000 + c AS first FROM held
  UNION
  SELECT w.scene, w.r, w.c, l.first FROM label l JOIN off ON abs(i) + abs(j) = 1 JOIN held w ON w.scene = l.scene AND w.r = l.r + i AND w.c = l.c + j WHERE l.first < w.r * 1000 + w.c),
region AS (SELECT scene, first, count(*) AS n, bool_or(anchor) AS kept FROM (SELECT scene, r, c, min(first) AS first FROM label GROUP BY ALL) JOIN held USING (scene, r, c) GROUP BY ALL),
parts AS (SELECT scene, count(*) AS regions_before, count(*) FILTER (kept) AS regions_after, sum(n)::BIGINT AS cells_before, coalesce(sum(n) FILTER (kept), 0)::BIGINT AS cells_after FROM region GROUP BY scene),
shape AS (SELECT scene, max(br) + 1 AS coarse_height, max(bc) + 1 AS coarse_width, count(wse) AS coarse_wet FROM coarse GROUP BY scene)
SELECT scene, max(r) + 1 AS height, max(c) + 1 AS width, count(wse1) AS wet1, count(wse2) AS wet2, count(wse3) AS wet3, count(wse4) AS wet4, 4 AS f, 'neutral' AS distance_fill, 'chessboard' AS metric, 2.0::DOUBLE AS cap,
  count(*) FILTER (dem IS NULL) AS dem_null, any_value(coarse_height) AS coarse_height, any_value(coarse_width) AS coarse_width, any_value(coarse_wet) AS coarse_wet,
  any_value(regions_before) AS regions_before, any_value(regions_after) AS regions_after, any_value(cells_before) AS cells_before, any_value(cells_after) AS cells_after
FROM final JOIN parts USING (scene) JOIN shape USING (scene) GROUP BY scene""")
def a18_record(spark, sf):
    fine = scn(spark, sf)
    coarse = water(fine)
    return growth.run_record(durable(growth.downscale(fine, coarse, F4, CAP)), coarse, F4, CAP)


@query("p22_units", GRIDS_SQL + """SELECT scene, round(CASE WHEN odd THEN (x + y) / 2 ELSE 0.015 END, 6) AS pixel_size, round(CASE WHEN odd THEN (x + y) / 2 / 0.015 ELSE 1 END, 6) AS m_to_rad FROM (
  SELECT scene, scene IN ('s1', 's3') AS odd, 0.01 * 6371000 * pi() / 180 * cos(radians(40 - height * 0.02 / 2)) AS x, 0.02 * 6371000 * pi() / 180 AS y FROM g)""")
def p22(spark, sf):
    """Cells of 0.01 by 0.02 degrees from latitude 40 on in some scenes, of as many metres in the others."""
    return rounded(growth.units(located(spark, sf)))


@query("x1_neutral_geographic", SCN_SQL + """, size AS (SELECT scene, max(r) + 1 AS height FROM fine GROUP BY scene),
unit AS (SELECT scene, CASE WHEN scene IN ('s1', 's3') THEN (0.01 * 6371000 * pi() / 180 * cos(radians(40 - height * 0.02 / 2)) + 0.02 * 6371000 * pi() / 180) / 2 ELSE 0.015 END AS px FROM size),
geo AS (SELECT g.scene, r, c, dem, wse2, CASE WHEN wse2 IS NOT NULL THEN wse2 WHEN within AND fill - away * px * 0.001::DOUBLE > dem THEN fill - away * px * 0.001::DOUBLE END AS wse3 FROM grown g JOIN unit USING (scene))
""" + oracles.isolated("g", "geo") + "SELECT scene, r, c, round(wse4, 6) AS wse4 FROM final_g")
def x1_geographic(spark, sf):
    """The ratio and the metres of a cell come from the georeferences."""
    fine = scn(spark, sf)
    return growth.downscale_layers(fine, water(fine), located(spark, sf), CAP).select(*KEY, F.round("wse4", 6).alias("wse4"))


@query("p29_clip_limits", SCN_SQL + "SELECT scene, round(quantile_cont(dem, 0.02), 6) AS p02, round(quantile_cont(dem, 0.98), 6) AS p98 FROM fine GROUP BY scene")
def p29(spark, sf):
    return rounded(metrics.clip_limits(scn(spark, sf), ["scene"], "dem", 0.02, 0.98))


@query("p16_blanket", DEPTH + "SELECT scene, br, bc, CASE WHEN wse IS NOT NULL THEN least(wsh, 40) ELSE 0 END AS blanket FROM deep")
def p16(spark, sf):
    return coarse_depths(spark, sf).select("scene", "br", "bc", cell.blanket(F.col("wsh"), F.col("wse"), F.lit(0.1) * 400).alias("blanket"))


@query("p17_without_blanket", DEPTH + "SELECT scene, br, bc, CASE WHEN wsh > 0.1 THEN wse - least(wsh, 0.1) END AS filtered FROM deep")
def p17(spark, sf):
    return pluvial.prepared(coarse_depths(spark, sf), small_pixel_count=0).select("scene", "br", "bc", "filtered")


@query("p18_with_blanket", SCN_SQL + "SELECT scene, r, c, CASE WHEN wse1 IS NULL THEN wse2 ELSE coalesce(wse2, dem) + 0.5 END AS v FROM wp")
def p18(spark, sf):
    return partial(spark, sf, True).select(*KEY, cell.with_blanket(F.col("wse2"), F.col("dem"), F.when(F.col("wse1").isNotNull(), 0.5)).alias("v"))


@query("p19_small_groups_back", SCN_SQL + "SELECT f.scene, r, c, coalesce(wse2, CASE WHEN q.wse > dem AND br % 2 = 0 THEN q.wse END) AS wse2 FROM wp f LEFT JOIN coarse q ON q.scene = f.scene AND br = r // 4 AND bc = c // 4")
def p19(spark, sf):
    fine = scn(spark, sf)
    coarse = water(fine)
    ready = coarse.select("scene", "br", "bc", F.col("wse").alias("filtered"), F.when(F.col("br") % 2 != 0, F.col("wse")).alias("wse_in"))
    return pluvial.small_groups_back(growth.resampled(fine, coarse, F4), ready, F4, "wse2").select(*KEY, "wse2")


def runs(spark, sf: str) -> DataFrame:
    """Records by order priority: the orders' tables stand in for runs, so that the tables grow with the data."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    status = F.when(F.col("o_orderkey") % 7 == 0, "failed").when(F.col("o_orderkey") % 5 == 0, "timeout").otherwise("ok")
    return orders.select(F.col("o_orderkey").cast("string").alias("run_name"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("backend"), status.alias("status"), F.col("o_totalprice").cast("double").alias("wall_seconds"))


RUNS = """WITH runs AS (SELECT o_orderkey::VARCHAR AS run_name, 'p' || substr(o_orderpriority, 1, 1) AS backend,
  CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'timeout' ELSE 'ok' END AS status, o_totalprice::DOUBLE AS wall_seconds FROM orders),
scored AS (SELECT l_orderkey::VARCHAR AS run_name, 'rmse' AS metric, max(l_discount)::DOUBLE AS value FROM lineitem GROUP BY 1)
"""


def scored(spark, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.groupBy(F.col("l_orderkey").cast("string").alias("run_name")).agg(F.max("l_discount").cast("double").alias("value")).withColumn("metric", F.lit("rmse"))


@query("t1_matrix", SCN_SQL + "SELECT DISTINCT scene || '|' || m AS run_name, scene, m AS method FROM fine, (VALUES ('chessboard'), ('euclidean')) v(m)")
def t1(spark, sf):
    return tables.matrix(scn(spark, sf).select("scene").distinct(), method=["chessboard", "euclidean"])


LONG = P_ + """, long AS (SELECT scene, run_name, m AS metric, CASE m WHEN 'rmse' THEN sqrt(avg(d * d)) WHEN 'mae' THEN avg(abs(d)) ELSE avg(d) END AS value
  FROM (SELECT scene, 'a' AS run_name, pred - obs AS d FROM pair UNION ALL SELECT scene, 'b', pred FROM pair), (VALUES ('rmse'), ('mae'), ('bias')) v(m) GROUP BY scene, run_name, m)
"""


def long_metrics(spark, sf: str) -> DataFrame:
    rows = predicted(spark, sf)
    both = rows.select("scene", F.lit("a").alias("run_name"), (F.col("pred") - F.col("obs")).alias("d")).unionByName(rows.select("scene", F.lit("b").alias("run_name"), F.col("pred").alias("d")))
    made = both.groupBy("scene", "run_name").agg(metrics.rmse(F.col("d")).alias("rmse"), metrics.mae(F.col("d")).alias("mae"), metrics.bias(F.col("d")).alias("bias"))
    return made.unpivot(["scene", "run_name"], ["rmse", "mae", "bias"], "metric", "value")


WIDE = LONG + ", wide AS (SELECT scene, metric, max(value) FILTER (run_name = 'a') AS a, max(value) FILTER (run_name = 'b') AS b FROM long GROUP BY ALL)\n"


@query("t2_metrics_table", WIDE + "SELECT scene, metric, round(a, 6) AS a, round(b, 6) AS b FROM wide")
def t2(spark, sf):
    return rounded(tables.wide(long_metrics(spark, sf), ["a", "b"], ["scene"]).drop("place"))


@query("t3_delta", WIDE + 'SELECT scene, metric, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS "Delta_a_minus_b" FROM wide')
def t3(spark, sf):
    return rounded(tables.with_delta(tables.wide(long_metrics(spark, sf), ["a", "b"], ["scene"]).drop("place"), "a", "b"))


@query("t4_transposed", WIDE + "SELECT scene, metric, run_name, round(value, 6) AS value FROM long")
def t4(spark, sf):
    return rounded(tables.transposed(tables.wide(long_metrics(spark, sf), ["a", "b"], ["scene"]), ["a", "b"], ["scene", "metric"]))


@query("t5_summary", RUNS + "SELECT r.*, value AS rmse FROM runs r LEFT JOIN scored USING (run_name)")
def t5(spark, sf):
    return tables.summary(runs(spark, sf), scored(spark, sf)).select("run_name", "backend", "status", "wall_seconds", "rmse")


@query("t6_ranking", RUNS + "SELECT run_name, row_number() OVER (ORDER BY status DESC, wall_seconds, run_name) AS rank FROM runs")
def t6(spark, sf):
    return metrics.ranked(runs(spark, sf), F.desc("status"), F.col("wall_seconds"), F.col("run_name")).select("run_name", "rank")


@query("t6_best", RUNS + "SELECT arg_min(run_name, wall_seconds) AS run_name, min(wall_seconds) AS wall_seconds FROM runs")
def t6_best(spark, sf):
    return tables.best(runs(spark, sf), "run_name", "wall_seconds")


@query("t7_successes", RUNS + "SELECT backend, count(*) AS n FROM runs WHERE status = 'ok' GROUP BY backend")
def t7(spark, sf):
    return tables.action_counts(tables.ok(runs(spark, sf)), "backend")


MEMBERS = {"chessboard": growth.Settings(cap=2), "euclidean": growth.Settings(cap=2, distance_fill_method="euclidean"), "broken": {"cap": 2, "distance_fill": "terrain_penalty", "cost_model": "none"}, "slow": growth.Settings(cap=2)}
LIMITS = {"slow": 0.0}


@query("t8_appended", RUNS + "SELECT run_name, status FROM runs UNION ALL SELECT * FROM (VALUES ('broken', 'failed'), ('slow', 'timeout'))")
def t8(spark, sf):
    """The records of members that fail and that run over their limit, after those of the runs before."""
    fine = scn(spark, sf)
    coarse = water(fine)
    members = {k: MEMBERS[k] for k in ("broken", "slow")}
    records, _ = validation.ensemble(fine, coarse, validation.bilinear_baseline(fine, coarse, F4), F4, members, seconds=LIMITS)
    return tables.appended(runs(spark, sf).select("run_name", "status"), records.select("run_name", "status"))


@query("t6_sorted_summary", RUNS + "SELECT run_name, status, wall_seconds, value AS rmse FROM runs LEFT JOIN scored USING (run_name)")
def t6_sorted(spark, sf):
    return tables.sorted_summary(tables.summary(runs(spark, sf), scored(spark, sf)).select("run_name", "status", "wall_seconds", "rmse"))


@query("t9_action_counts", RUNS + "SELECT status, count(*) AS n FROM runs GROUP BY status")
def t9(spark, sf):
    return tables.action_counts(runs(spark, sf), "status")


@query("t10_metric_order", WIDE + "SELECT scene, metric, CASE metric WHEN 'rmse' THEN 2 WHEN 'mae' THEN 4 ELSE 5 END AS place FROM wide")
def t10(spark, sf):
    return tables.wide(long_metrics(spark, sf), ["a", "b"], ["scene"]).select("scene", "metric", "place")


@query("t11_pooled", EMB_SQL + "SELECT scene, count(*) AS n, sum(v) AS total FROM (SELECT scene, unnest([dem, wse1, wse2]) AS v FROM wp) WHERE v IS NOT NULL GROUP BY scene")
def t11(spark, sf):
    return tables.pooled(partial(spark, sf), "dem", "wse1", "wse2").groupBy("scene").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@query("a19_compared", RUNS + """, t AS (SELECT backend, avg(wall_seconds) AS wall_seconds, count(*)::DOUBLE AS runs FROM runs GROUP BY backend)
SELECT n AS name, round(a, 6) AS p1, round(b, 6) AS p2, round(b - a, 6) AS delta, round(b / a, 6) AS ratio FROM (
  SELECT n, max(CASE n WHEN 'runs' THEN runs ELSE wall_seconds END) FILTER (backend = 'p1') AS a, max(CASE n WHEN 'runs' THEN runs ELSE wall_seconds END) FILTER (backend = 'p2') AS b
  FROM t, (VALUES ('runs'), ('wall_seconds')) v(n) GROUP BY n)""")
def a19(spark, sf):
    made = runs(spark, sf).groupBy("backend").agg(F.avg("wall_seconds").alias("wall_seconds"), F.count(F.lit(1)).cast("double").alias("runs"))
    return rounded(metrics.compared(made, "backend", "p1", "p2", ["runs", "wall_seconds"], []))


# checks: the violations of layers made to have some


def check(name: str, label: str, condition: str, made):
    """SQL: count of violating cells of `marked` by scene."""
    query(name, SCN_SQL + MARKED + f"SELECT scene, '{label}' AS \"check\", ({condition})::BIGINT AS n_bad FROM marked GROUP BY scene")(made)


#: some scenes break a rule: s1 is all dry and not inundated, s2 has no terrain, s3 is all wet, s4 has no negative depth
MARKED = """, marked AS (
  SELECT scene, r, c, CASE WHEN scene <> 's2' THEN dem END AS dem, CASE scene WHEN 's1' THEN NULL WHEN 's3' THEN dem + 1 ELSE wse1 END AS wse1, r % 10 > 0 AND scene <> 's1' AS ok,
    CASE WHEN scene = 's4' THEN greatest(dem, 0) ELSE dem END AS wsh, CASE WHEN scene = 's0' THEN c % 2 ELSE c % 3 END AS m FROM wp)
"""


def marked(spark, sf: str) -> DataFrame:
    scene, dem = F.col("scene"), F.col("dem")
    rows = partial(spark, sf, True).withColumns({
        "wsh": F.when(scene == "s4", F.greatest(dem, F.lit(0.0))).otherwise(dem), "wse1": F.when(scene == "s3", dem + 1).when(scene != "s1", F.col("wse1")),
        "ok": (F.col("r") % 10 > 0) & (scene != "s1"), "m": F.when(scene == "s0", F.col("c") % 2).otherwise(F.col("c") % 3),
    })
    return rows.withColumn("dem", F.when(scene != "s2", dem))


def truth(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 0 ELSE 1 END"


check("q1_layer_valid", "wse1: floats, some valid, no NaN", truth("count(wse1) > 0"), lambda s, d: checks.layer_valid(marked(s, d), "wse1"))
check("q2_dem_partly_valid", "terrain partly valid", truth("count(dem) > 0 AND max(r) > 0"), lambda s, d: checks.dem_partly_valid(marked(s, d)))
check("q3_wse_partly_wet", "water neither all dry nor all wet", truth("count(wse1) BETWEEN 1 AND count(*) - 1"), lambda s, d: checks.wse_partly_wet(marked(s, d), "wse1"))
check("q4_wsh_range", "depth from 0 to 1e5", truth("abs(min(wsh)) <= 1e-4 AND max(wsh) BETWEEN 1e-9 AND 1e5"), lambda s, d: checks.wsh_range(marked(s, d), "wsh"))
check("q5_some_inundated", "some cells inundated", truth("count(*) FILTER (ok) > 0"), lambda s, d: checks.some_inundated(marked(s, d), "ok"))
check("q6_binary_mask", "mask has the values 0 and 1", truth("count(*) FILTER (m NOT IN (0, 1)) = 0"), lambda s, d: checks.binary_mask(marked(s, d), "m"))
check("q10_water_not_below", "water not below terrain", "count(*) FILTER (wse1 < dem)", lambda s, d: checks.water_not_below(marked(s, d), "wse1"))
check("q17_domain_dry", "dry outside the domain", "count(*) FILTER (wse1 IS NOT NULL AND NOT ok)", lambda s, d: checks.domain_dry(marked(s, d), "wse1", "ok"))

GRIDS = SCN_SQL + ", g AS (SELECT scene, max(r) + 1 AS height, max(c) + 1 AS width FROM fine GROUP BY scene)\n"


def layers(spark, sf: str, least: int = 1) -> DataFrame:
    """Georeferences of a fine and a coarse layer (of `least` rows or more) of each scene; some scenes' are off."""
    shape = scn(spark, sf).groupBy("scene").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    odd = F.col("scene").isin("s1", "s3")
    fine = shape.select("scene", F.lit("dem").alias("layer"), "height", "width", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("res_x"), F.when(odd, 1.5).otherwise(1.0).alias("res_y"), F.lit("EPSG:3857").alias("crs"), F.when(odd, 0.0).otherwise(-9999.0).alias("nodata"))
    coarse = shape.select("scene", F.lit("wse").alias("layer"), F.expr(f"greatest(height div 4, {least})").cast("int").alias("height"), (F.expr("width div 4") + odd.cast("int")).cast("int").alias("width"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(4.0).alias("res_x"), F.lit(4.0).alias("res_y"), F.lit("EPSG:3857").alias("crs"), F.lit(-9999.0).alias("nodata"))
    plain = fine.withColumns({"layer": F.lit("copy"), "res_y": F.lit(1.0), "nodata": F.lit(-9999.0)})
    moved = coarse.withColumns({"layer": F.lit("moved"), "x0": F.lit(1e-8), "height": F.col("height") + (F.col("scene") == "s2").cast("int")})
    return fine.unionByName(coarse).unionByName(plain).unionByName(moved)


def grid_check(name: str, label: str, bad: str, made):
    query(name, GRIDS + f"SELECT scene, '{label}' AS \"check\", ({bad})::BIGINT AS n_bad FROM g")(made)


ODD = "scene IN ('s1', 's3')"
grid_check("q7_same_extent", "equal extents", f"({ODD})::INTEGER", lambda s, d: checks.same_extent(layers(s, d), "dem", "wse"))
grid_check("q8_conventions", "nodata -9999, a CRS, x and y", f"({ODD})::INTEGER", lambda s, d: checks.conventions(layers(s, d).filter("layer IN ('dem', 'wse')")))
grid_check("q9_square_cells", "square cells", f"({ODD})::INTEGER", lambda s, d: checks.square_cells(layers(s, d).filter("layer IN ('dem', 'wse')")))
grid_check("q11_whole_ratio", "whole and equal ratios", f"({ODD})::INTEGER", lambda s, d: checks.whole_ratio(layers(s, d), "dem", "wse"))
grid_check("q12_same_grid", "equal grids", f"({ODD})::INTEGER", lambda s, d: checks.same_grid(layers(s, d), "dem", "copy"))
grid_check("q16_compatible", "equal grids", "(scene = 's2')::INTEGER", lambda s, d: checks.same_grid(layers(s, d), "wse", "moved"))


@query("p20_ratio", GRIDS + f"SELECT scene, height / (height // 4) AS fy, width / (width // 4 + ({ODD})::INTEGER) AS fx, CASE WHEN NOT {ODD} THEN 4 END AS f FROM g")
def p20(spark, sf):
    return checks.ratio(layers(spark, sf, least=0), "dem", "wse")


def rules_sql(table: str, *rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT scene, '{label}' AS \"check\", ({bad})::BIGINT AS n_bad FROM {table} GROUP BY scene" for label, bad in rules)


grid_check("q8_single_band", "one band", f"({ODD})::INTEGER", lambda s, d: checks.single_band(layers(s, d).filter("layer = 'dem'").withColumn("bands", F.when(F.col("scene").isin("s1", "s3"), 3).otherwise(1))))
grid_check("q8_layer_names", "layer name (warning)", f"({ODD})::INTEGER", lambda s, d: checks.layer_names(layers(s, d).filter("layer IN ('dem', 'wse')").withColumn("name", F.when(F.col("scene").isin("s1", "s3") & (F.col("layer") == "wse"), "depth").otherwise(F.upper("layer"))), {"dem": "DEM", "wse": "WSE"}))

#: every rule is broken in one scene
BROKEN = """, broken AS (
  SELECT scene, r, c, CASE WHEN scene <> 's4' THEN dem END AS dem, CASE WHEN scene <> 's0' OR c % 4 <> 0 THEN wse1 END AS wse1, wse2,
    CASE scene WHEN 's1' THEN CASE WHEN c % 16 <> 0 THEN wse3 END WHEN 's2' THEN wse3 + 1 ELSE wse3 END AS wse3, scene <> 's3' AND within AS within FROM grown),
cut AS (
  SELECT scene, r, c, CASE WHEN scene = 's2' AND wse2 IS NOT NULL THEN NULL ELSE wse3 END AS wse3, wse2, CASE scene WHEN 's1' THEN wse4 + 1 WHEN 's3' THEN NULL ELSE wse4 END AS wse4 FROM final)
"""


@query("q13_phase_rules", SCN_SQL + BROKEN + rules_sql("broken",
    ("wet partials add no water", "count(*) FILTER (wse2 IS NOT NULL AND wse1 IS NULL)"), ("growth takes no water", "count(*) FILTER (wse3 IS NULL AND wse2 IS NOT NULL)"),
    ("wet partials unchanged", "count(*) FILTER (wse3 <> wse2)"), ("dry beyond the cap", "count(*) FILTER (wse2 IS NULL AND wse3 IS NOT NULL AND NOT within)"),
    ("no water off the terrain", "count(*) FILTER (wse3 IS NOT NULL AND dem IS NULL)")))
def q13(spark, sf):
    return checks.phase_rules(broken(spark, sf), resampled="wse1", partial="wse2", grown="wse3", cap="within")


def broken(spark, sf: str) -> DataFrame:
    scene = F.col("scene")
    return grown(spark, sf, True).withColumns({
        "wse1": F.when((scene != "s0") | (F.col("c") % 4 != 0), F.col("wse1")), "within": (scene != "s3") & F.col("within"), "dem": F.when(scene != "s4", F.col("dem")),
        "wse3": F.when(scene == "s1", F.when(F.col("c") % 16 != 0, F.col("wse3"))).when(scene == "s2", F.col("wse3") + 1).otherwise(F.col("wse3")),
    })


def violated_sql(table: str, cells: list[tuple[str, str, str]], scenes: list[tuple[str, str, str]]) -> str:
    """cells: layer, rule and when a cell breaks it; scenes: layer, rule and when a scene keeps it."""
    first = "'first at row ' || (min(row(r, c)))[1] || ', column ' || (min(row(r, c)))[2]"
    parts = [f"SELECT scene, '{v}' AS layer, '{x}' AS \"check\", count(*)::BIGINT AS n_bad, {first} AS detail FROM {table} WHERE {bad} GROUP BY scene" for v, x, bad in cells]
    parts += [f"SELECT scene, '{v}', '{x}', 1::BIGINT, count({v}) || ' of ' || count(*) || ' valid' FROM {table} GROUP BY scene HAVING NOT ({holds})" for v, x, holds in scenes]
    return " UNION ALL ".join(parts)


@query("q13_violations", SCN_SQL + BROKEN + violated_sql("broken", [
    ("wse3", "wet partials add no water", "wse2 IS NOT NULL AND wse1 IS NULL"), ("wse3", "growth takes no water", "wse3 IS NULL AND wse2 IS NOT NULL"),
    ("wse3", "wet partials unchanged", "wse3 <> wse2"), ("wse3", "dry beyond the cap", "wse2 IS NULL AND wse3 IS NOT NULL AND NOT within"),
    ("wse3", "no water off the terrain", "wse3 IS NOT NULL AND dem IS NULL"),
], [("dem", "terrain partly valid", "count(dem) > 0"), ("wse2", "no wet partial is above the terrain", "count(wse2) > 0")]))
def q13_violations(spark, sf):
    """All rules of a phase in one aggregation, with the layer and where it is broken first."""
    return checks.violations(broken(spark, sf), growth.phase_rules())


@query("q14_isolated_rules", SCN_SQL + BROKEN + rules_sql("cut", ("result within source", "count(*) FILTER (wse4 IS NOT NULL AND (wse3 IS NULL OR wse4 <> wse3))"), ("anchors within source", "count(*) FILTER (wse2 IS NOT NULL AND wse3 IS NULL)"), ("some cells kept", "CASE WHEN count(wse4) > 0 THEN 0 ELSE 1 END")))
def q14(spark, sf):
    return checks.isolated_rules(durable(cut(spark, sf)), "wse3", "wse4", "wse2")


def cut(spark, sf: str) -> DataFrame:
    scene = F.col("scene")
    return downscaled(spark, sf, True).withColumns({
        "wse3": F.when((scene != "s2") | F.col("wse2").isNull(), F.col("wse3")), "wse4": F.when(scene == "s1", F.col("wse4") + 1).when(scene != "s3", F.col("wse4")),
    })


@query("q14_violations", SCN_SQL + BROKEN + violated_sql("cut", [
    ("wse4", "result within source", "wse4 IS NOT NULL AND (wse3 IS NULL OR wse4 <> wse3)"), ("wse4", "anchors within source", "wse2 IS NOT NULL AND wse3 IS NULL"),
], [("wse4", "some cells kept", "count(wse4) > 0")]))
def q14_violations(spark, sf):
    return checks.violations(cut(spark, sf), growth.result_rules(allow_low_wse=True))


@query("q15_pluvial_rules", DEPTH + """, spoiled AS (
  SELECT scene, wse, wsh, CASE WHEN scene = 's1' THEN 0.35 WHEN wse IS NULL THEN CASE WHEN scene = 's2' THEN 0.05 ELSE 0 END ELSE least(wsh, 0.1) END AS blanket, scene = 's3' AND wse IS NULL AS added FROM deep)
""" + rules_sql("spoiled", ("blanket within depth", "count(*) FILTER (blanket > 0.1 + 1e-5)"), ("no blanket where dry", "count(*) FILTER (wse IS NULL AND wsh IS NOT NULL AND blanket <> 0)"), ("filter adds no water", "count(*) FILTER (added)")))
def q15(spark, sf):
    scene, dry = F.col("scene"), F.col("wse").isNull()
    ready = pluvial.prepared(coarse_depths(spark, sf), small_pixel_count=2).withColumns({
        "blanket": F.when(scene == "s1", 0.35).when((scene == "s2") & dry, 0.05).otherwise(F.col("blanket")), "wse_in": F.when((scene == "s3") & dry, 1.0).otherwise(F.col("wse_in")),
    })
    return checks.pluvial_rules(ready, wse="wse", filtered="wse_in", blanket="blanket", wsh="wsh", depth="depth")


DEEP = "greatest(coalesce({0}, dem) - dem, 0)"


@query("x5_validation", SCN_SQL + oracles.downscaled("far", cap=4) + f""", pairs AS (
  SELECT scene, run_name, r, c, {DEEP.format("o.wse4")} AS obs, {DEEP.format("v")} AS pred FROM final_far o
  JOIN (SELECT scene, r, c, 'capped' AS run_name, wse4 AS v FROM final UNION ALL SELECT scene, r, c, 'bilinear', wse1 FROM res) USING (scene, r, c))
""" + oracles.SCORES + """, wide AS (SELECT scene, metric, max(value) FILTER (run_name = 'capped') AS capped, max(value) FILTER (run_name = 'bilinear') AS bilinear FROM scores GROUP BY ALL)
SELECT scene, metric, round(capped, 6) AS capped, round(bilinear, 6) AS bilinear, round(capped - bilinear, 6) AS "Delta_capped_minus_bilinear" FROM wide""")
def x5(spark, sf):
    fine = scn(spark, sf)
    coarse = water(fine)
    observed = downscaled(spark, sf, True, cap=4, as_wsh=True)
    runs_ = {"capped": downscaled(spark, sf, True, as_wsh=True), "bilinear": validation.bilinear_baseline(fine, coarse, F4)}
    found = validation.validated(durable(observed), {k: durable(v.select(*KEY, "wsh")) for k, v in runs_.items()})
    return rounded(tables.with_delta(tables.wide(found, list(runs_), ["scene"]).drop("place"), "capped", "bilinear"))


@query("x6_ensemble", SCN_SQL + oracles.downscaled("e", "euclidean") + f""", pairs AS (
  SELECT scene, run_name, r, c, {DEEP.format("wse1")} AS obs, {DEEP.format("v")} AS pred FROM res
  JOIN (SELECT scene, r, c, 'chessboard' AS run_name, wse4 AS v FROM final UNION ALL SELECT scene, r, c, 'euclidean', wse4 FROM final_e) USING (scene, r, c))
""" + oracles.SCORES + """, wet AS (SELECT 'chessboard' AS run_name, count(wse4) AS n FROM final UNION ALL SELECT 'euclidean', count(wse4) FROM final_e),
means AS (PIVOT (SELECT run_name, metric, round(avg(value), 6) AS value FROM scores GROUP BY ALL) ON metric IN ('psnr', 'ssim', 'rmse', 'rmse_wet', 'mae', 'bias', 'csi', 'observed_wet_fraction', 'predicted_wet_fraction', 'valid_pixels') USING first(value) GROUP BY run_name)
SELECT m.*, n AS wet_cell_count, psnr, ssim, rmse, rmse_wet, mae, bias, csi, observed_wet_fraction, predicted_wet_fraction, valid_pixels
FROM (VALUES ('chessboard', 'chessboard', 'ok', NULL), ('euclidean', 'euclidean', 'ok', NULL), ('broken', 'chessboard', 'failed', 'ValueError'), ('slow', 'chessboard', 'timeout', 'no result after 0 s')) m(run_name, distance_fill_method, status, error)
LEFT JOIN wet USING (run_name) LEFT JOIN means USING (run_name)""")
def x6(spark, sf):
    """Two members with results, one that raises and one whose time is up; wall times are left out."""
    fine = scn(spark, sf)
    coarse = water(fine)
    records, scores = validation.ensemble(fine, coarse, validation.bilinear_baseline(fine, coarse, F4), F4, MEMBERS, seconds={**dict.fromkeys(MEMBERS, 1e9), **LIMITS})
    means = scores.groupBy("run_name", "metric").agg(F.avg("value").alias("value"))
    found = tables.summary(records, means).withColumn("error", F.substring_index("error", ":", 1))
    return rounded(found.drop("wall_seconds", "meta_key_count", "distance_fill"))


@query("x7_backends", SCN_SQL + NO_SLOPES + TERRAIN + oracles.penalised("p", LINEAR.replace("wse2", "w.wse2")) + """, d AS (SELECT scene, p.wse4 - n.wse4 AS d FROM final n JOIN final_p p USING (scene, r, c))
SELECT scene, count(d) AS overlap, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(d), 6) AS bias, round(quantile_cont(abs(d), 0.95), 6) AS p95 FROM d GROUP BY scene""")
def x7(spark, sf):
    a, b = (durable(downscaled(spark, sf, True, distance_fill=x).select(*KEY, "wse4")) for x in ("neutral", "terrain_penalty"))
    return rounded(validation.backend_differences(a, b, "wse4"))
