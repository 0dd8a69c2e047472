"""Queries and SQL of sources, cell expressions and resampling (S, P, R)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wetcell.functions import cell
from wetcell.operators import resample
from wetcell.plans import growth, validation
from wetcell.queries.fixtures import EMB_SQL, F4, SCN_SQL, emb, scn, vectors, water
from wetcell.sources import blocks, grids, tiles
from wetcell.storage import shared_folder

QUERIES, SQL = {}, {}
KEY = ("scene", "r", "c")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def res(spark, sf: str) -> DataFrame:
    fine = emb(spark, sf)
    return growth.resampled(fine, water(fine), F4)


E_, S_ = EMB_SQL, SCN_SQL


@query("s3_profile", E_ + """SELECT scene, 'dem' AS layer, max(r) + 1 AS height, max(c) + 1 AS width, count(dem) AS valid,
  100.0::DOUBLE AS "left", (100 + 2 * (max(c) + 1))::DOUBLE AS "right", (50 - 2 * (max(r) + 1))::DOUBLE AS bottom FROM fine GROUP BY scene""")
def s3(spark, sf):
    cells = emb(spark, sf).select("scene", F.lit("dem").alias("layer"), "r", "c", F.col("dem").alias("v"))
    shape = cells.groupBy("scene", "layer").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    facts = {"x0": 100.0, "y0": 50.0, "res_x": 2.0, "res_y": 2.0, "nodata": grids.NODATA}
    made = shape.withColumns({k: F.lit(v) for k, v in facts.items()}).withColumn("crs", F.lit("EPSG:3857"))
    return grids.profile(cells, made).select("scene", "layer", "height", "width", "valid", "left", "right", "bottom")


@query("s4_normalised", E_ + "SELECT scene, r, c, CASE WHEN dem % 7 <> 0 THEN dem END AS v FROM fine")
def s4(spark, sf):
    cells = emb(spark, sf).withColumn("v", F.when(F.col("dem") % 14 == 0, F.lit(float("nan"))).when(F.col("dem") % 7 == 0, F.lit(grids.NODATA)).otherwise(F.col("dem")))
    return grids.normalised(cells).select(*KEY, "v")


def fresh(spark) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def dem_cells(spark, sf: str) -> DataFrame:
    return emb(spark, sf).select("scene", F.lit("dem").alias("layer"), "r", "c", F.when(F.col("dem") % 7 != 0, F.col("dem")).alias("v"))


@query("s1_s5_layer_written_and_read", E_ + "SELECT scene, 'dem' AS layer, r, c, CASE WHEN dem % 7 <> 0 THEN dem END AS v FROM fine")
def s1_s5(spark, sf):
    path = fresh(spark)
    grids.write_layer(dem_cells(spark, sf), path)
    return grids.read_layer(spark, path)


@query("s1_tiles", E_ + "SELECT scene, 'dem' AS layer, r, c, CASE WHEN dem % 7 <> 0 THEN dem END AS v FROM fine")
def s1_tiles(spark, sf):
    path = fresh(spark)
    tiles.write_tiles(tiles.to_tiles(dem_cells(spark, sf), 24), path)
    return tiles.to_cells(tiles.read_tiles(spark, path))


@query("p24_clip_tiles", E_ + "SELECT scene, r, c, CASE WHEN dem % 7 <> 0 THEN dem END AS v FROM fine WHERE r BETWEEN 10 AND 77 AND c BETWEEN 5 AND 44")
def p24_tiles(spark, sf):
    path = fresh(spark)
    tiles.write_tiles(tiles.to_tiles(dem_cells(spark, sf), 24), path)
    return tiles.clip_tiles(tiles.read_tiles(spark, path), 10, 5, 77, 44).drop("layer")


@query("s2_s6_phases_listed", E_ + """SELECT 'emb' AS "case", format('{}_wse_{:04d}x{:04d}', phase, max(r) + 1, max(c) + 1) AS layer, any_value(n) AS valid FROM fine,
  (SELECT '01_resampled' AS phase, count(wse1) AS n FROM final UNION ALL SELECT '02_wp', count(wse2) FROM final UNION ALL SELECT '03_dp', count(wse3) FROM final UNION ALL SELECT '04_isol', count(wse4) FROM final) GROUP BY phase""")
def s2_s6(spark, sf):
    """A run writes its phases, the listing finds them and they are read again."""
    root, fine = f"{fresh(spark)}/emb", emb(spark, sf)
    growth.downscale(fine, water(fine), F4, growth.Settings(cap=2), phases_to=root)
    files = grids.listing(spark, root).select(F.col("phase").alias("case"), "layer").distinct()
    kept = spark.read.option("recursiveFileLookup", True).parquet(root)
    counts = kept.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("layer")).agg(F.count("v").alias("valid"))
    return files.join(counts, "layer").select("case", "layer", "valid")


@query("s7_table_as_csv", """SELECT o_orderkey AS run_name, o_orderstatus AS status, round(o_totalprice::DOUBLE, 2) AS wall_seconds FROM orders""")
def s7(spark, sf):
    path = fresh(spark)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    grids.write_table(orders.select(F.col("o_orderkey").alias("run_name"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice").cast("double"), 2).alias("wall_seconds")), path)
    return spark.read.schema("run_name long, status string, wall_seconds double").csv(path, header=True)


@query("s8_text_to_cells", E_ + "SELECT scene, r, c, CASE WHEN dem % 7 <> 0 THEN dem END AS v FROM fine")
def s8(spark, sf):
    """Rows as lines of text, with the sentinel for nodata, written as text and read back as cells."""
    path = fresh(spark)
    rows = grids.to_rows(dem_cells(spark, sf).fillna(grids.NODATA, subset=["v"]), "v")
    line = F.array_join(F.transform("values", lambda v: v.cast("string")), ",")
    rows.select(F.concat_ws(";", "scene", "r", line).alias("value")).write.text(path)
    parts = F.split("value", ";")
    lines = spark.read.text(path).select(parts[0].alias("scene"), parts[1].cast("int").alias("r"), parts[2].alias("line"))
    return grids.normalised(grids.from_text(lines))


@query("s9_rows_and_back", E_ + "SELECT scene, r, len(list(dem)) AS n, sum(dem * (c + 1)) AS weighted FROM fine GROUP BY ALL")
def s9(spark, sf):
    back = grids.from_rows(grids.to_rows(emb(spark, sf), "dem"), "dem")
    return back.groupBy("scene", "r").agg(F.count("dem").alias("n"), F.sum(F.col("dem") * (F.col("c") + 1)).alias("weighted"))


@query("s10_empty_like", E_ + "SELECT scene, r, c, CASE WHEN c % 2 = 0 THEN dem ELSE 5.0 END AS v FROM fine")
def s10(spark, sf):
    fine = emb(spark, sf)
    shape = fine.agg(F.max("r") + 1, F.max("c") + 1).first()
    full = grids.empty_like(spark, "emb", shape[0], shape[1], 5.0)
    return full.join(fine.filter("c % 2 = 0"), list(KEY), "left").select(*KEY, F.coalesce("dem", "v").alias("v"))


@query("p1_wet_flag", E_ + "SELECT scene, br, bc, wse IS NOT NULL AS wet FROM coarse")
def p1(spark, sf):
    return water(emb(spark, sf)).select("scene", "br", "bc", cell.is_wet(F.col("wse")).alias("wet"))


@query("p2_wet_partial", E_ + "SELECT scene, r, c, wse2 FROM wp")
def p2(spark, sf):
    return res(spark, sf).select(*KEY, "wse2")


def expression(name: str, column, sql: str):
    """A query of one expression over dem, wse1 and wse2."""
    query(name, E_ + f"SELECT scene, r, c, {sql} AS v FROM wp")(lambda spark, sf: res(spark, sf).select(*KEY, column().alias("v")))


c_ = F.col
DELTA = "(wse1 - dem)"
expression("p3_depth", lambda: cell.depth(c_("wse2"), c_("dem")), "greatest(coalesce(wse2, dem) - dem, 0)")
expression("p4_depth_in_domain", lambda: cell.in_domain(cell.depth(c_("wse1"), c_("dem")), c_("c") > 3), "CASE WHEN c > 3 THEN greatest(coalesce(wse1, dem) - dem, 0) END")
expression("p5_raw_depth", lambda: cell.wet_depth(c_("wse1"), c_("dem")), "CASE WHEN wse1 IS NOT NULL THEN greatest(wse1 - dem, 0) END")
expression("p6_delta", lambda: cell.raw_depth(c_("wse1"), c_("dem")), DELTA)
expression("p7_terrain_cost", lambda: cell.terrain_cost(c_("wse1") - c_("dem"), 0.5), f"CASE WHEN {DELTA} IS NULL THEN NULL WHEN {DELTA} > 0 THEN 1.0::DOUBLE ELSE 1 + abs({DELTA}) * 0.5::DOUBLE END")
expression("p15_inundation", lambda: cell.inundation(c_("wse2")), "(wse2 IS NOT NULL)::INTEGER::DOUBLE")
expression("p27_threshold", lambda: cell.above(c_("wse1") - c_("dem"), 100.0), f"CASE WHEN {DELTA} >= 100 THEN {DELTA} END")
expression("p28_shared_valid", lambda: cell.shared_valid(c_("c") > 3, c_("wse1"), c_("wse2")).cast("int"), "(c > 3 AND wse1 IS NOT NULL AND wse2 IS NOT NULL)::INTEGER")
expression("p30_any_null", lambda: cell.any_null(c_("dem"), c_("wse1"), c_("wse2")).cast("int"), "(dem IS NULL OR wse1 IS NULL OR wse2 IS NULL)::INTEGER")
expression("p10_slope_power_decay", lambda: F.round(cell.slope_power_decay(F.abs("dem"), 0.25, 1.5), 6), "round(pow(abs(dem), 1.5) * 0.25, 6)")
expression("p9_slope_linear_decay", lambda: cell.slope_linear_decay(F.abs("dem"), 0.25), "abs(dem) * 0.25::DOUBLE")
expression("p26_error_gain", lambda: F.abs(c_("wse1") - c_("dem")) - F.abs(c_("wse2") - c_("dem")), f"abs({DELTA}) - abs(wse2 - dem)")


@query("p21_metres", E_ + "SELECT DISTINCT scene, r, round(0.01 * 6371000 * pi() / 180 * cos(radians(r / 10.0)), 6) AS x, round(0.02 * 6371000 * pi() / 180, 6) AS y FROM fine")
def p21(spark, sf):
    x, y = cell.metres(F.lit(0.01), F.lit(-0.02), F.col("r") / 10.0)
    return emb(spark, sf).select("scene", "r", F.round(x, 6).alias("x"), F.round(y, 6).alias("y")).distinct()


@query("p23_place", E_ + "SELECT scene, r, c, 100 + (c + 0.5) * 2::DOUBLE AS x, 50 - (r + 0.5) * 2::DOUBLE AS y FROM fine")
def p23(spark, sf):
    x, y = cell.place(F.col("r"), F.col("c"), *(F.lit(v) for v in (100.0, 50.0, 2.0, 2.0)))
    return emb(spark, sf).select(*KEY, x.alias("x"), y.alias("y"))


@query("p24_clip", E_ + "SELECT scene, (r - 10)::INTEGER AS r, (c - 5)::INTEGER AS c, dem FROM fine WHERE r BETWEEN 10 AND 29 AND c BETWEEN 5 AND 44")
def p24(spark, sf):
    fine = emb(spark, sf)
    grid = spark.createDataFrame([("emb", 0.0, 0.0, 1.0, 1.0)], "scene string, x0 double, y0 double, res_x double, res_y double")
    return grids.clip(fine, grid, 5.0, -30.0, 45.0, -10.0)


@query("p25_decimate", E_ + """, i AS (SELECT k::INTEGER AS k, round(k * ((SELECT max(r) FROM fine) / 15.0))::INTEGER AS r FROM range(16) t(k)),
j AS (SELECT k::INTEGER AS k, round(k * (63 / 9.0))::INTEGER AS c FROM range(10) t(k))
SELECT scene, i.k AS r, j.k AS c, dem FROM fine JOIN i ON fine.r = i.r JOIN j ON fine.c = j.c""")
def p25(spark, sf):
    fine = emb(spark, sf)
    return grids.decimate(fine, fine.agg(F.max("r")).first()[0] + 1, 64, 16, 10).select(*KEY, "dem")


@query("r1_bilinear_up", S_ + "SELECT scene, r, c, wse1 FROM res")
def r1(spark, sf):
    fine = scn(spark, sf)
    return resample.bilinear_up(fine, water(fine), F4, "wse", "wse1").select(*KEY, "wse1")


@query("r2_nearest_up", E_ + "SELECT f.scene, r, c, wse FROM fine f LEFT JOIN coarse q ON q.scene = f.scene AND br = r // 4 AND bc = c // 4")
def r2(spark, sf):
    fine = emb(spark, sf)
    return resample.nearest_up(fine, water(fine), F4, "wse", "wse").select(*KEY, "wse")


@query("r3_average_down", E_ + "SELECT scene, r // 4 AS br, c // 4 AS bc, avg(dem) AS dem FROM fine GROUP BY ALL")
def r3(spark, sf):
    return resample.average_down(emb(spark, sf), F4, "dem")


@query("r4_bilinear_down", E_ + """, k AS (
  SELECT scene, dem, r // 4 + i AS br, c // 4 + j AS bc, (1 - abs((r + 0.5) / 4 - (r // 4 + i) - 0.5)) AS wr, (1 - abs((c + 0.5) / 4 - (c // 4 + j) - 0.5)) AS wc
  FROM fine CROSS JOIN off)
SELECT q.scene, q.br, q.bc, sum(wr * wc * dem) / sum(wr * wc) AS dem FROM coarse q JOIN k ON k.scene = q.scene AND k.br = q.br AND k.bc = q.bc AND wr > 0 AND wc > 0 GROUP BY ALL""")
def r4(spark, sf):
    return resample.bilinear_down(emb(spark, sf), F4, "dem")


@query("r5_coarsen", E_ + "SELECT scene, r // 4 AS br, c // 4 AS bc, avg(dem) FILTER (dem % 5 <> 0) AS dem FROM fine GROUP BY ALL")
def r5(spark, sf):
    fine = emb(spark, sf).withColumn("dem", F.when(F.col("dem") % 5 == 0, grids.NODATA).otherwise(F.col("dem")))
    return resample.coarsen(fine, F4, "dem", grids.NODATA)


@query("r6_block_reduce", E_ + "SELECT scene, r // 4 AS br, c // 4 AS bc, max(dem) AS hi, median(dem) AS mid, CASE WHEN count(wse1) = count(*) THEN avg(wse1) END AS strict FROM res GROUP BY ALL")
def r6(spark, sf):
    return resample.block_reduce(res(spark, sf), F4, hi=F.max("dem"), mid=F.median("dem"), strict=resample.strict_mean("wse1"))


@query("r7_valid_up", E_ + "SELECT f.scene, r, c, wse IS NOT NULL AS ok FROM fine f LEFT JOIN coarse q ON q.scene = f.scene AND br = r // 4 AND bc = c // 4")
def r7(spark, sf):
    fine = emb(spark, sf)
    return resample.valid_up(fine, water(fine), F4, "wse", "ok").select(*KEY, "ok")


@query("r1_r3_r7_on_blocks", S_ + """SELECT r.scene, r.r, r.c, wse1, q.wse IS NOT NULL AS ok, avg(dem) OVER (PARTITION BY r.scene, r.r // 4, r.c // 4) AS mean
FROM res r LEFT JOIN coarse q ON q.scene = r.scene AND q.br = r.r // 4 AND q.bc = r.c // 4""")
def on_blocks(spark, sf):
    """Two resamplings and a reduction of fine cells that are moved once, to a table of blocks."""
    fine = scn(spark, sf)
    coarse, rows = water(fine), blocks.blocked(fine, F4)
    means = resample.average_down(rows, F4, "dem").withColumnRenamed("dem", "mean")
    rows = resample.valid_up(resample.bilinear_up(rows, coarse, F4, "wse", "wse1"), coarse, F4, "wse", "ok")
    return resample.nearest_up(rows, means, F4, "mean", "mean").select(*KEY, "wse1", "ok", "mean")


@query("r8_mosaic", E_ + "SELECT scene, r, c, coalesce(wse2, CASE WHEN c % 3 = 0 THEN -dem END, dem) AS v FROM wp")
def r8(spark, sf):
    rows = res(spark, sf)
    parts = [rows.select(*KEY, F.lit(p).alias("priority"), v.alias("v")) for p, v in enumerate((F.col("dem"), F.when(F.col("c") % 3 == 0, -F.col("dem")), F.col("wse2")))]
    return resample.mosaic(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("r8_mosaic_placed", E_ + """, l AS (
  SELECT scene, r, c + 5 AS c, dem AS v, 0 AS p FROM wp
  UNION ALL SELECT scene, r, c + 5, CASE WHEN c % 3 = 0 THEN -dem END, 1 FROM wp WHERE r >= 10 AND c >= 3
  UNION ALL SELECT scene, r + 2, c, wse2, 2 FROM wp)
SELECT scene, r, c, arg_max(v, p) FILTER (v IS NOT NULL) AS v FROM l GROUP BY ALL""")
def r8_placed(spark, sf):
    """The terrain, a part of it and water that is shifted to the south and west, each with its own place."""
    rows = res(spark, sf).select(*KEY, "dem", "wse2")
    part = F.when(F.col("c") % 3 == 0, -F.col("dem"))
    sheets = [
        rows.select("scene", F.lit("dem").alias("layer"), "r", "c", F.col("dem").alias("v")),
        rows.filter("r >= 10 AND c >= 3").select("scene", F.lit("part").alias("layer"), (F.col("r") - 10).alias("r"), (F.col("c") - 3).alias("c"), part.alias("v")),
        rows.select("scene", F.lit("water").alias("layer"), "r", "c", F.col("wse2").alias("v")),
    ]
    layers = sheets[0].unionByName(sheets[1]).unionByName(sheets[2])
    shift = F.expr("CASE layer WHEN 'dem' THEN named_struct('r', 0, 'c', 0, 'p', 0) WHEN 'part' THEN named_struct('r', 10, 'c', 3, 'p', 1) ELSE named_struct('r', 2, 'c', -5, 'p', 2) END")
    sizes = layers.groupBy("scene", "layer").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width")).withColumn("s", shift)
    located = sizes.select("scene", "layer", "height", "width", (100 + 2.5 * F.col("s.c")).alias("x0"), (50 - 2.5 * F.col("s.r")).alias("y0"), F.lit(2.5).alias("res_x"), F.lit(2.5).alias("res_y"), F.col("s.p").alias("priority"))
    return resample.mosaic_placed(layers, located)


@query("r9_bilinear_baseline", E_ + "SELECT scene, r, c, wse1 AS wse, greatest(coalesce(wse1, dem) - dem, 0) AS wsh FROM res")
def r9(spark, sf):
    fine = emb(spark, sf)
    return validation.bilinear_baseline(fine, water(fine), F4).select(*KEY, "wse", "wsh")


@query("bench_orders_average", """WITH o AS (SELECT o_orderkey // 256 AS r, o_orderkey % 256 AS c, round(o_totalprice)::DOUBLE AS dem FROM orders)
SELECT 'ord' AS scene, (r // 8)::INTEGER AS br, (c // 8)::INTEGER AS bc, avg(dem) AS dem FROM o GROUP BY ALL""")
def orders_average(spark, sf):
    return resample.average_down(grids.from_orders(spark.read.parquet(f"{sf}/orders.parquet")), 8, "dem")
