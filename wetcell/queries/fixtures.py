"""The grids that the queries run on, as DataFrames and as the first lines of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wetcell.plans.growth import Settings
from wetcell.sources import grids

F4 = 4
CAP = Settings(cap=2)
REACH = 8
SCENE_ROWS = 100


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scene of all vectors."""
    return grids.from_embeddings(vectors(spark, sf_dir))


def scn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells as scenes of 100 rows."""
    return grids.from_embeddings(vectors(spark, sf_dir), SCENE_ROWS)


def water(fine: DataFrame, f: int = F4) -> DataFrame:
    return grids.coarse_water(fine, f)


def fixture_sql(scenes: bool) -> str:
    """fine(scene, r, c, dem), coarse(scene, br, bc, wse), res(..., wse1), wp(..., wse2)."""
    scene, row = (f"'s' || (vec_id // {SCENE_ROWS})", f"vec_id % {SCENE_ROWS}") if scenes else ("'emb'", "vec_id")
    return f"""
WITH RECURSIVE fine AS (
  SELECT {scene} AS scene, ({row})::INTEGER AS r, (unnest(range(len(embedding))))::INTEGER AS c, round(unnest(embedding)::DOUBLE * 1000) + 0.0 AS dem
  FROM embeddings),
coarse AS (
  SELECT scene, br, bc, CASE WHEN (br // 5 + bc // 4) % 2 = 0 THEN floor(total / 16.0) END AS wse
  FROM (SELECT scene, r // 4 AS br, c // 4 AS bc, sum(dem) AS total FROM fine GROUP BY ALL)),
off AS (SELECT * FROM (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j)),
corner AS (
  SELECT f.*, q.wse, greatest(0, 1 - abs((r + 0.5) / 4 - (r // 4 + i) - 0.5)) * greatest(0, 1 - abs((c + 0.5) / 4 - (c // 4 + j) - 0.5)) AS w
  FROM fine f CROSS JOIN off JOIN coarse q ON q.scene = f.scene AND q.br = f.r // 4 + i AND q.bc = f.c // 4 + j WHERE q.wse IS NOT NULL),
mean AS (SELECT scene, r, c, sum(w * wse) / sum(w) AS wse1 FROM corner WHERE w > 0 GROUP BY ALL),
res AS (
  SELECT f.*, CASE WHEN q.wse IS NOT NULL THEN m.wse1 END AS wse1 FROM fine f
  LEFT JOIN mean m USING (scene, r, c) LEFT JOIN coarse q ON q.scene = f.scene AND q.br = f.r // 4 AND q.bc = f.c // 4),
wp AS (SELECT *, CASE WHEN wse1 > dem THEN wse1 END AS wse2 FROM res),
near AS (
  SELECT scene, r, c, min(row(greatest(abs(sr - r), abs(sc - c)), (sr - r) * (sr - r) + (sc - c) * (sc - c), sr, sc, v)) AS n
  FROM wp JOIN (SELECT scene, r AS sr, c AS sc, wse2 AS v FROM wp WHERE wse2 IS NOT NULL) s USING (scene)
  WHERE abs(sr - r) <= 8 AND abs(sc - c) <= 8 GROUP BY ALL),
grown AS (
  SELECT w.*, n[1]::DOUBLE AS away, coalesce(n[1] / 4 < 2, false) AS within, n[5] AS fill,
    CASE WHEN wse2 IS NOT NULL THEN wse2 WHEN n[1] / 4 < 2 AND n[5] - n[1] * 0.001 > dem THEN n[5] - n[1] * 0.001 END AS wse3
  FROM wp w LEFT JOIN near USING (scene, r, c)),
reach AS (
  SELECT scene, r, c FROM grown WHERE wse2 IS NOT NULL
  UNION
  SELECT g.scene, g.r, g.c FROM reach p JOIN grown g ON g.scene = p.scene AND abs(g.r - p.r) + abs(g.c - p.c) = 1 AND g.r BETWEEN p.r - 1 AND p.r + 1 AND g.c BETWEEN p.c - 1 AND p.c + 1
  WHERE g.wse3 IS NOT NULL),
final AS (SELECT g.*, CASE WHEN p.r IS NOT NULL THEN wse3 END AS wse4 FROM grown g LEFT JOIN reach p USING (scene, r, c))
"""


EMB_SQL = fixture_sql(False)
SCN_SQL = fixture_sql(True)
#: the same with two fine cells along a coarse one; the pattern of dry blocks is as it was
SCN2_SQL = SCN_SQL.replace("bc // 4", "bc // :").replace("// 4", "// 2").replace("// :", "// 4").replace("/ 4 - (", "/ 2 - (").replace("n[1] / 4", "n[1] / 2").replace("/ 16.0", "/ 4.0")
