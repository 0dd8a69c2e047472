"""SQL of the iterative operators: pieces of a WITH RECURSIVE that go after the fixtures' tables (fine, coarse, off, wp, ...)."""

from __future__ import annotations

import math

GRAIN = 16777216  # steps of least cost are whole numbers of 1 / GRAIN


def near(name: str, metric: str, cap: float, cells: str = "wp") -> str:
    """near_{name}: n, the nearest wet cell (measure, squared distance, row, column, value) of cells within a cap at f = 4."""
    measure = {"chessboard": "greatest(abs(sr - r), abs(sc - c))", "taxicab": "abs(sr - r) + abs(sc - c)", "euclidean": "(sr - r) * (sr - r) + (sc - c) * (sc - c)"}[metric]
    reach = math.ceil(cap * 4)
    return f""", near_{name} AS (
  SELECT scene, r, c, min(row({measure}, (sr - r) * (sr - r) + (sc - c) * (sc - c), sr, sc, v)) AS n
  FROM {cells} JOIN (SELECT scene, r AS sr, c AS sc, wse2 AS v FROM {cells} WHERE wse2 IS NOT NULL) s USING (scene)
  WHERE abs(sr - r) <= {reach} AND abs(sc - c) <= {reach} GROUP BY ALL)
"""


def grown(name: str, metric: str = "chessboard", cap: float = 2, cells: str = "wp") -> str:
    """grown_{name}: cells with away, within, fill and wse3 of the neutral method."""
    away = "sqrt(n[1]::DOUBLE)" if metric == "euclidean" else "n[1]::DOUBLE"
    return near(name, metric, cap, cells) + f""", grown_{name} AS (
  SELECT w.*, {away} AS away, coalesce({away} / 4 < {cap}, false) AS within, n[5] AS fill,
    CASE WHEN wse2 IS NOT NULL THEN wse2 WHEN {away} / 4 < {cap} AND n[5] - {away} * 0.001::DOUBLE > dem THEN n[5] - {away} * 0.001::DOUBLE END AS wse3
  FROM {cells} w LEFT JOIN near_{name} USING (scene, r, c))
"""


def isolated(name: str, cells: str) -> str:
    """final_{name}: cells with wse4, the parts of wse3 that touch wse2."""
    return f""", held_{name} AS MATERIALIZED (SELECT scene, r, c, wse2, wse3 FROM {cells}),
keep_{name} AS (
  SELECT scene, r, c FROM held_{name} WHERE wse2 IS NOT NULL
  UNION
  SELECT g.scene, g.r, g.c FROM keep_{name} p JOIN off ON abs(i) + abs(j) = 1 JOIN held_{name} g ON g.scene = p.scene AND g.r = p.r + i AND g.c = p.c + j WHERE g.wse3 IS NOT NULL),
final_{name} AS (SELECT g.*, CASE WHEN p.r IS NOT NULL THEN g.wse3 END AS wse4 FROM {cells} g LEFT JOIN keep_{name} p USING (scene, r, c))
"""


def downscaled(name: str, metric: str = "chessboard", cap: float = 2, cells: str = "wp") -> str:
    return grown(name, metric, cap, cells) + isolated(name, f"grown_{name}")


def allocated(name: str, cells: str, *, node: bool = False) -> str:
    """{name}: scene, r, c and k (cost in grains, source row, source column) of the cells (scene, r, c, cost, src) that a
    source reaches: labels fall until none falls. {name}_e has the steps."""
    step = "b.cost" if node else "(a.cost + b.cost) / 2 * CASE WHEN i <> 0 AND j <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END"
    moves = "abs(i) + abs(j) = 1" if node else "(i <> 0 OR j <> 0)"
    return f""", {name}_g AS MATERIALIZED (SELECT scene, r, c, cost::DOUBLE AS cost, src FROM ({cells}) WHERE cost >= 0 AND cost < 'inf'::DOUBLE),
{name}_e AS MATERIALIZED (
  SELECT a.scene, a.r, a.c, b.r AS nr, b.c AS nc, round_even({step} * {GRAIN}, 0)::BIGINT AS step
  FROM {name}_g a JOIN off ON {moves} JOIN {name}_g b ON b.scene = a.scene AND b.r = a.r + i AND b.c = a.c + j),
{name}(scene, r, c, k) USING KEY (scene, r, c) AS (
  SELECT scene, r, c, row(0::BIGINT, r, c) AS k FROM {name}_g WHERE src
  UNION
  SELECT n.scene, n.r, n.c, n.k
  FROM (SELECT e.scene, e.nr AS r, e.nc AS c, min(row(l.k[1] + e.step, l.k[2], l.k[3])) AS k FROM {name} l JOIN {name}_e e ON e.scene = l.scene AND e.r = l.r AND e.c = l.c GROUP BY ALL) n
  LEFT JOIN recurring.{name} o ON o.scene = n.scene AND o.r = n.r AND o.c = n.c WHERE o.k IS NULL OR n.k < o.k)
"""


def backlinks(name: str) -> str:
    """{name}_b: scene, r, c, pr, pc: of the cells before that give the label, the first one."""
    return f""", {name}_b AS (
  SELECT l.scene, l.r, l.c, p[1] AS pr, p[2] AS pc FROM {name} l LEFT JOIN (
    SELECT t.scene, t.r, t.c, min(row(f.r, f.c)) AS p FROM {name} f JOIN {name}_e e ON e.scene = f.scene AND e.r = f.r AND e.c = f.c
    JOIN {name} t ON t.scene = e.scene AND t.r = e.nr AND t.c = e.nc
    WHERE e.step > 0 AND t.k[1] = f.k[1] + e.step AND t.k[2] = f.k[2] AND t.k[3] = f.k[3] GROUP BY ALL) USING (scene, r, c))
"""


def valued(name: str, cells: str, value: str, out: str) -> str:
    """{name}_v: scene, r, c, {out} (the source's value) and {out}_cost."""
    return f""", {name}_v AS (SELECT l.scene, l.r, l.c, s.{value} AS {out}, l.k[1]::DOUBLE / {GRAIN} AS {out}_cost FROM {name} l JOIN {cells} s ON s.scene = l.scene AND s.r = l.k[2] AND s.c = l.k[3])
"""


def bilinear(name: str, cells: str, coarse: str, value: str, out: str) -> str:
    """{name}: cells with {out}, resampled from {coarse}.{value} at f = 4."""
    return f""", {name}_m AS (
  SELECT f.scene, f.r, f.c, sum(w * v) / sum(w) AS m FROM (
    SELECT f.scene, f.r, f.c, q.{value} AS v, greatest(0, 1 - abs((f.r + 0.5) / 4 - (f.r // 4 + i) - 0.5)) * greatest(0, 1 - abs((f.c + 0.5) / 4 - (f.c // 4 + j) - 0.5)) AS w
    FROM fine f CROSS JOIN off JOIN {coarse} q ON q.scene = f.scene AND q.br = f.r // 4 + i AND q.bc = f.c // 4 + j WHERE q.{value} IS NOT NULL) f WHERE w > 0 GROUP BY ALL),
{name} AS (
  SELECT f.*, CASE WHEN q.{value} IS NOT NULL THEN m.m END AS {out} FROM {cells} f LEFT JOIN {name}_m m USING (scene, r, c)
  LEFT JOIN {coarse} q ON q.scene = f.scene AND q.br = f.r // 4 AND q.bc = f.c // 4)
"""


#: full: the coarse surface filled by the nearest wet cell; risen: cells with surface; paid_v: fill by the terrain's cost
TERRAIN = """, full_ AS (SELECT k.scene, k.br, k.bc, (SELECT min(row(greatest(abs(s.br - k.br), abs(s.bc - k.bc)), (s.br - k.br) * (s.br - k.br) + (s.bc - k.bc) * (s.bc - k.bc), s.br, s.bc, s.wse))
  FROM coarse s WHERE s.scene = k.scene AND s.wse IS NOT NULL)[5] AS full FROM coarse k)
""" + bilinear("risen", "wp", "full_", "full", "surface") + allocated(
    "paid", "SELECT scene, r, c, CASE WHEN surface - dem > 0 THEN 1 ELSE 1 + abs(surface - dem) END AS cost, wse2 IS NOT NULL AS src FROM risen"
) + valued("paid", "wp", "wse2", "fill")


def penalised(name: str, decay: str) -> str:
    """final_{name}: the terrain-penalty method at cap 2; decay is an expression over away and accumulated (table acc)."""
    return f""", grown_{name} AS (
  SELECT w.scene, w.r, w.c, w.dem, w.wse1, w.wse2, g.away, g.within, p.fill, {decay} AS lowering,
    CASE WHEN w.wse2 IS NOT NULL THEN w.wse2 WHEN g.within AND p.fill - ({decay}) > w.dem THEN p.fill - ({decay}) END AS wse3
  FROM wp w JOIN grown g USING (scene, r, c) LEFT JOIN paid_v p USING (scene, r, c) LEFT JOIN acc a USING (scene, r, c))
""" + isolated(name, f"grown_{name}")


#: pairs: scene, run_name, r, c, obs, pred -> scores: scene, run_name, metric, value, all cells valid
SCORES = """, win AS (
  SELECT a.scene, a.run_name, a.r, a.c, avg(b.obs) AS x, avg(b.pred) AS y, avg(b.obs * b.obs) AS xx, avg(b.pred * b.pred) AS yy, avg(b.obs * b.pred) AS xy
  FROM pairs a JOIN pairs b ON a.scene = b.scene AND a.run_name = b.run_name AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 WHERE a.r BETWEEN 3 AND 96 AND a.c BETWEEN 3 AND 60 GROUP BY ALL),
span AS (SELECT scene, run_name, CASE WHEN max(obs) > min(obs) THEN max(obs) - min(obs) ELSE 1 END AS s FROM pairs GROUP BY ALL),
sim AS (SELECT scene, run_name, avg((2 * x * y + 0.0001 * s * s) * (2 * (xy - x * y) * 49 / 48 + 0.0009 * s * s) / ((x * x + y * y + 0.0001 * s * s) * ((xx - x * x + yy - y * y) * 49 / 48 + 0.0009 * s * s))) AS ssim
  FROM win JOIN span USING (scene, run_name) GROUP BY ALL),
one AS (SELECT scene, run_name, CASE WHEN avg((pred - obs) * (pred - obs)) < 1e-8 THEN 'inf'::DOUBLE ELSE 20 * log10(CASE WHEN max(obs) <= 0 THEN 1 ELSE max(obs) END) - 10 * log10(avg((pred - obs) * (pred - obs))) END AS psnr,
  sqrt(avg((pred - obs) * (pred - obs))) AS rmse, sqrt(avg((pred - obs) * (pred - obs)) FILTER (obs > 0.5)) AS rmse_wet, avg(abs(pred - obs)) AS mae, avg(pred - obs) AS bias,
  count(*) FILTER (obs >= 0.01 AND pred >= 0.01) / nullif(count(*) FILTER (obs >= 0.01 OR pred >= 0.01), 0) AS csi,
  avg((obs >= 0.01)::INTEGER) AS observed_wet_fraction, avg((pred >= 0.01)::INTEGER) AS predicted_wet_fraction, count(*)::DOUBLE AS valid_pixels FROM pairs GROUP BY ALL),
scores AS (UNPIVOT (SELECT * FROM one JOIN sim USING (scene, run_name)) ON COLUMNS(* EXCLUDE (scene, run_name)) INTO NAME metric VALUE value)
"""


#: the pluvial method with the depths' mode as filter depth, groups of two coarse cells and less taken off and put back
PLUVIAL = """, rained AS (SELECT scene, br, bc, wse + (br * 7 + bc * 3) % 11 * 8 AS wse FROM coarse),
deep AS (SELECT q.*, avg_, greatest(coalesce(wse, avg_) - avg_, 0) AS wsh FROM rained q
  JOIN (SELECT scene, r // 4 AS br, c // 4 AS bc, avg(dem) AS avg_ FROM fine GROUP BY ALL) USING (scene, br, bc)),
moded AS (SELECT scene, arg_max(w, row(n, -w)) + 0.01::DOUBLE AS depth FROM (SELECT scene, round(wsh, 3) AS w, count(*) AS n FROM deep GROUP BY ALL) GROUP BY scene),
prep AS (SELECT scene, br, bc, CASE WHEN wse IS NOT NULL THEN least(wsh, depth) ELSE 0 END AS blanket, CASE WHEN wsh > depth THEN wse - least(wsh, depth) END AS filtered FROM deep JOIN moded USING (scene)),
on_ AS MATERIALIZED (SELECT scene, br, bc FROM prep WHERE filtered IS NOT NULL),
plab AS (
  SELECT scene, br, bc, br * 1000 + bc AS first FROM on_
  UNION
  SELECT w.scene, w.br, w.bc, l.first FROM plab l JOIN off ON abs(i) + abs(j) = 1 JOIN on_ w ON w.scene = l.scene AND w.br = l.br + i AND w.bc = l.bc + j WHERE l.first < w.br * 1000 + w.bc),
few AS (SELECT scene, br, bc FROM (SELECT *, count(*) OVER (PARTITION BY scene, first) AS n FROM (SELECT scene, br, bc, min(first) AS first FROM plab GROUP BY ALL)) WHERE n <= 2),
ready AS (SELECT p.*, CASE WHEN f.br IS NULL THEN filtered END AS wse_in FROM prep p LEFT JOIN few f USING (scene, br, bc))
""" + bilinear("pres", "fine", "ready", "wse_in", "wse1") + ", pwp AS (SELECT *, CASE WHEN wse1 > dem THEN wse1 END AS wse2 FROM pres)\n" + downscaled("rain", cells="pwp") + """, back AS (
  SELECT f.scene, f.r, f.c, f.dem, wse4 AS wse_base, coalesce(wse4, CASE WHEN wse_in IS NULL AND filtered > dem THEN filtered END) AS wse
  FROM final_rain f LEFT JOIN ready q ON q.scene = f.scene AND q.br = f.r // 4 AND q.bc = f.c // 4)
""" + bilinear("over", "back", "ready", "blanket", "layer")
