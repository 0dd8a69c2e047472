"""Distance to the nearest wet cell, and what that cell holds (N1-N5).

Grids are cut into bands of rows. Within a row a cell's nearest wet cell is the left one of the two around it; among rows,
of a column's candidates only those count that are nearer along their row than every row between: the others are farther in
every metric. Each band sums up its candidates for the rows above and below it; a scan over the bands, by chunks of columns,
carries what can still win into every band, and a last pass over the cells picks among a band's own rows and what was
carried. Where a scene has more bands than STEP, runs of STEP bands are summed up as bands are, the scan goes over the runs
(again by runs while they are many) and then over the bands within each. The work doesn't grow with the distances. A task
holds a band of a scene, or the candidates of STEP bands in a chunk, however many rows the scene has. The scene's width is
told to each band in a table of bands and joined by band, so this holds with and without broadcasts; that table alone (a row
a band) is looked at by scene.
Ties: (distance, squared Euclidean distance, source row, source column).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wetcell.storage import durable

METRICS = ("chessboard", "taxicab", "euclidean")
ROWS, COLUMNS = 64, 128  # of a band, of a chunk
STEP = 128  # bands that a scan takes at once, 2 at least
_FAR = np.int64(2**62)
SUMS = "scene string, chunk int, band int, top int, bottom int, down binary, up binary"


def measured(metric: str, dr: Column, dc: Column) -> Column:
    """As a number that orders like the distance: squared for euclidean."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    if metric == "chessboard":
        return F.greatest(F.abs(dr), F.abs(dc))
    return F.abs(dr) + F.abs(dc) if metric == "taxicab" else dr * dr + dc * dc


def squared(dr: np.ndarray, dc: np.ndarray) -> np.ndarray:
    return dr * dr + dc * dc


#: The same for whole numbers that are not negative.
SIZES: dict[str, Callable] = {"chessboard": np.maximum, "taxicab": np.add, "euclidean": squared}


def entry_type(value: np.dtype) -> np.dtype:
    return np.dtype([("c", "<i4"), ("r", "<i4"), ("sc", "<i4"), ("v", value)])


class Band:
    """A band as dense arrays over the scene's columns. nearest: the column of each cell's nearest wet cell in its row, -1
    where there is none; value: what that one holds."""

    def __init__(self, rows: pa.Table):
        self.r, self.c = rows["r"].to_numpy().astype(np.int64), rows["c"].to_numpy().astype(np.int64)
        self.r0, self.c0 = int(self.r.min()), int(rows["low"][0].as_py())
        self.h, self.w = int(self.r.max()) - self.r0 + 1, int(rows["high"][0].as_py()) - self.c0 + 1
        v = rows["value"].combine_chunks()
        wet = v.is_valid().to_numpy(zero_copy_only=False)
        values = v.fill_null(0).to_numpy(zero_copy_only=False)
        y, x = self.r - self.r0, self.c - self.c0
        own, held = np.full((self.h, self.w), -1), np.zeros((self.h, self.w), values.dtype)
        own[y[wet], x[wet]], held[y[wet], x[wet]] = x[wet], values[wet]
        west = np.maximum.accumulate(own, axis=1)
        east = np.minimum.accumulate(np.where(own < 0, _FAR, own)[:, ::-1], axis=1)[:, ::-1]
        columns = np.arange(self.w)
        pick = np.where((west < 0) | (east - columns < columns - west), east, west)
        self.dry = pick >= _FAR
        pick = np.where(self.dry, 0, pick)
        self.value = np.take_along_axis(held, pick, axis=1)
        self.nearest = np.where(self.dry, -1, pick + self.c0)
        self.gap = np.where(self.dry, _FAR, np.abs(pick - columns))

    def candidates(self, down: bool) -> np.ndarray:
        """Of every column, the rows that are nearer along their row than all rows after them (down) or before them."""
        gap = self.gap[::-1] if down else self.gap
        best = np.minimum.accumulate(gap, axis=0)
        y, x = np.nonzero(gap < np.vstack([np.full((1, self.w), _FAR), best[:-1]]))
        y = self.h - 1 - y if down else y
        out = np.empty(len(y), entry_type(self.value.dtype))
        out["c"], out["r"], out["sc"], out["v"] = x + self.c0, y + self.r0, self.nearest[y, x], self.value[y, x]
        return out


def summing(columns: int):
    def sum_up(rows: pa.Table) -> pa.Table:
        """A band -> for each chunk of columns its rows and candidates for the bands after it (down) and before it (up)."""
        band, out = Band(rows), []
        for down in (True, False):
            found = band.candidates(down)
            chunk = found["c"] // columns
            order = np.argsort(chunk, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1)
            out.append({int(chunk[k[0]]): found[k].tobytes() for k in parts if len(k)})
        chunks = list(range(band.c0 // columns, (band.c0 + band.w - 1) // columns + 1))
        first = lambda name: pa.array([rows[name][0].as_py()] * len(chunks), rows[name].type)
        ends = [pa.array([x] * len(chunks), pa.int32()) for x in (band.r0, band.r0 + band.h - 1)]
        blobs = [pa.array([x.get(k, b"") for k in chunks], pa.binary()) for x in out]
        return pa.table([first("scene"), pa.array(chunks, pa.int32()), first("band"), *ends, *blobs], names=["scene", "chunk", "band", "top", "bottom", "down", "up"])

    return sum_up


def sided(bands: list[dict]) -> list[tuple[str, list[dict]]]:
    """Both ways through bands that are in order, with what a band has for those after it on the way."""
    return [("down", bands), ("up", bands[::-1])]


def carrying(metric: str, kind: np.dtype, columns: int):
    """Two functions: one sums up a run of bands like a band, one carries between the bands of a run."""
    size, entry = SIZES[metric], entry_type(kind)

    def least_by(column: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The least value of each column."""
        least = np.full(columns, _FAR)
        np.minimum.at(least, column, values)
        return least

    def merged(known: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Candidates of rows farther away and of nearer ones, without the farther ones that a nearer one beats."""
        gap = lambda x: np.abs(x["c"] - x["sc"]).astype(np.int64)
        return np.concatenate([known[gap(known) < least_by(new["c"] % columns, gap(new))[known["c"] % columns]], new])

    def winners(x: np.ndarray, near: int, far: int) -> np.ndarray:
        """Those that can be the best in one of the rows from near to far, counted from the candidates' side."""
        measures = [size] if metric != "taxicab" else [size, squared]  # equal sums stay equal, then squares decide
        for measure in measures:
            column, gap = x["c"] % columns, np.abs(x["c"] - x["sc"]).astype(np.int64)
            rows = np.abs(np.array([[near], [far]]) - x["r"]).astype(np.int64)
            if metric == "taxicab" and measure is size:
                x = x[rows[0] + gap == least_by(column, rows[0] + gap)[column]]
            else:
                x = x[measure(rows[0], gap) <= least_by(column, measure(rows[1], gap))[column]]
        return x

    def in_order(rows: pa.Table) -> list[dict]:
        return sorted(rows.to_pylist(), key=lambda x: x["band"])

    def sum_up(rows: pa.Table) -> pa.Table:
        """A run of a chunk's bands -> one band, numbered as the run."""
        bands, found = in_order(rows), {}
        for side, order in sided(bands):
            known = np.empty(0, entry)
            for x in order:
                known = merged(known, np.frombuffer(x[side], entry))
            found[side] = known.tobytes()
        one = {**bands[0], "band": bands[0]["run"], "bottom": bands[-1]["bottom"], **found}
        return pa.Table.from_pylist([one], rows.schema).drop_columns("run")

    def carry(rows: pa.Table, outer: pa.Table | None = None) -> pa.Table:
        """A run of a chunk's bands, and the candidates of others that can win in the run -> for each band the candidates of
        all others that can win in it."""
        bands = in_order(rows)
        found = {x["band"]: [] for x in bands}
        blobs = [] if outer is None else outer["carried"].to_pylist()
        known = np.concatenate([np.frombuffer(x, entry) for x in blobs] or [np.empty(0, entry)])
        start = {"down": known[known["r"] < bands[0]["top"]], "up": known[known["r"] > bands[-1]["bottom"]]}
        for side, order in sided(bands):
            known = start[side]
            for x in order:
                ends = (x["top"], x["bottom"]) if side == "down" else (x["bottom"], x["top"])
                found[x["band"]].append(winners(known, *ends))
                known = merged(known, np.frombuffer(x[side], entry))
        first = lambda name: pa.array([rows[name][0].as_py()] * len(bands), rows[name].type)
        blobs = pa.array([np.concatenate(found[x["band"]]).tobytes() for x in bands], pa.binary())
        return pa.table([first("scene"), first("chunk"), pa.array([x["band"] for x in bands], pa.int32()), blobs], names=["scene", "chunk", "band", "carried"])

    return sum_up, carry


def between(sums: DataFrame, most: int, metric: str, kind: np.dtype, columns: int, step: int) -> DataFrame:
    """sums: what bands have for others, at most `most` of them in a scene. scene, chunk, band, carried: the candidates of all
    other bands that can win in a band."""
    sum_up, carry = carrying(metric, kind, columns)
    out = "scene string, chunk int, band int, carried binary"
    if most <= step:
        return sums.groupBy("scene", "chunk").applyInArrow(lambda rows: carry(rows), out)
    key = ["scene", "chunk", "run"]
    sums = durable(sums.withColumn("run", F.expr(f"cast(floor(band / {step}) as int)")))  # read on both ways
    runs = sums.groupBy(key).applyInArrow(sum_up, SUMS)
    outer = between(runs, -(-(most - 1) // step) + 1, metric, kind, columns, step).withColumnRenamed("band", "run")
    return sums.groupBy(key).cogroup(outer.groupBy(key)).applyInArrow(lambda rows, outer: carry(rows, outer), out)


def picking(metric: str, reach: int | None, names: list[str], schema: pa.Schema):
    size = SIZES[metric]
    most = None if reach is None else int(size(np.int64(reach), np.int64(0)))

    def pick(rows: pa.Table, carried: pa.Table) -> pa.Table:
        """A band's cells with near, from its own rows and from what was carried."""
        if not rows.num_rows:
            return schema.empty_table()
        band = Band(rows)
        shape = (band.h, band.w)
        d, d2, sr, sc = (np.full(shape, _FAR) for _ in range(4))
        value = np.zeros(shape, band.value.dtype)

        def offer(at, far, far2, row, column, held) -> None:
            better = (far < d[at]) | (far == d[at]) & ((far2 < d2[at]) | (far2 == d2[at]) & (row < sr[at]))
            for old, new in ((d, far), (d2, far2), (sr, row), (sc, column), (value, held)):
                old[at] = np.where(better, new, old[at])

        x = np.concatenate([np.frombuffer(b.as_py(), entry_type(value.dtype)) for b in carried["carried"]] or [np.empty(0, entry_type(value.dtype))])
        x = x[np.argsort(x["c"], kind="stable")]
        starts = np.searchsorted(x["c"], x["c"], "left")
        place = np.arange(len(x)) - starts
        lines = np.arange(band.h)[:, None] + band.r0
        for k in range(int(place.max(initial=-1)) + 1):
            e = x[place == k]  # one a column
            dr, dc = np.abs(lines - e["r"]).astype(np.int64), np.abs(e["c"] - e["sc"]).astype(np.int64)[None, :]
            at = (slice(None), e["c"] - band.c0)
            offer(at, size(dr, dc), squared(dr, dc), e["r"][None, :].astype(np.int64), e["sc"][None, :], e["v"][None, :])
        gap = np.where(band.dry, 0, band.gap)
        for k in range(band.h):
            step = np.int64(k)
            if (d < size(step, np.int64(0))).all():
                break
            for to, source in {(slice(k, None), slice(0, band.h - k)), (slice(0, band.h - k), slice(k, None))} if k else [(slice(None), slice(None))]:
                dry, dc = band.dry[source], gap[source]
                offer((to,), np.where(dry, _FAR, size(step, dc)), squared(step, dc), np.broadcast_to(lines[source], dc.shape), band.nearest[source], band.value[source])
        y, x = band.r - band.r0, band.c - band.c0
        far, far2 = d[y, x], d2[y, x]
        got = far < _FAR if most is None else far <= most
        length = np.sqrt(far2.astype(float)) if metric == "euclidean" else far.astype(float)
        kinds = schema.field("near").type
        parts = {"d": length, "d2": far2, "sr": sr[y, x], "sc": sc[y, x], "v": value[y, x]}
        arrays = [pa.array(np.where(got, v, 0).astype(v.dtype), mask=~got).cast(kinds.field(n).type) for n, v in parts.items()]
        near = pa.StructArray.from_arrays(arrays, fields=[kinds.field(n) for n in parts], mask=pa.array(~got))
        return pa.table([*(rows[n].combine_chunks() for n in names), near], schema=schema)

    return pick


def searched(cells: DataFrame, value: str, metric: str, reach: int | None, *, rows: int = ROWS, columns: int = COLUMNS, step: int = STEP) -> DataFrame:
    """Adds near: d, d2, sr, sc, v. The cells are written first; value has to be a number."""
    if step < 2:
        raise ValueError(f"step {step}")
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    cells = durable(cells)
    kind = cells.schema[value].dataType
    near = T.StructType.fromDDL(f"near struct<d:double,d2:long,sr:int,sc:int,v:{kind.simpleString()}>")
    band = F.expr(f"cast(floor(r / {rows}) as int)").alias("band")
    ends = cells.groupBy("scene", band).agg(F.min("c").alias("low"), F.max("c").alias("high"))
    whole = Window.partitionBy("scene")
    bands = F.max("band").over(whole) - F.min("band").over(whole) + 1
    spans = durable(ends.select("scene", "band", F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"), bands.alias("bands")))
    most = spans.agg(F.max("bands")).first()[0] or 0
    spans, key = spans.drop("bands"), ["scene", "band"]  # joined by band, as the cells are grouped: a scene is never one task's
    slim = cells.select("scene", "r", "c", F.col(value).alias("value"), band).join(spans, key, "left")
    sums = slim.groupBy(key).applyInArrow(summing(columns), SUMS)
    dtype = np.dtype(to_arrow_schema(T.StructType([T.StructField("v", kind)])).field("v").type.to_pandas_dtype())
    carried = between(sums, most, metric, dtype, columns, step)
    own = {n: f"cell_{k}" for k, n in enumerate(cells.columns)}  # whatever their names, apart from those added here
    wide = cells.select(*(F.col(n).alias(o) for n, o in own.items()), "scene", "r", "c", F.col(value).alias("value"), band).join(spans, key, "left")
    kept = list(own.values())
    out = T.StructType([*(T.StructField(own[f.name], f.dataType) for f in cells.schema.fields), *near.fields])
    found = wide.groupBy(key).cogroup(carried.groupBy(key)).applyInArrow(picking(metric, reach, kept, to_arrow_schema(out)), out)
    return found.select(*(F.col(o).alias(n) for n, o in own.items()), "near")


def nearest_within(cells: DataFrame, value: str, reach: int, metric: str = "chessboard") -> DataFrame:
    """Adds near: (d, d2, sr, sc, v) of the nearest valid cell, null if its distance is over reach.
    d is the distance in cells; for euclidean d2 is exact and d its root. Cells have to be unique in scene, r, c."""
    return searched(cells, value, metric, reach)


def nearest(cells: DataFrame, value: str, metric: str = "chessboard", **options) -> DataFrame:
    """Without a bound. A scene without valid cells is left null."""
    return searched(cells, value, metric, None, **options)


def require_mask(cells: DataFrame, value: str) -> None:
    """Raises if a scene has no valid cell to fill from, or none to fill."""
    counts = cells.groupBy("scene").agg(F.count(value).alias("valid"), F.count(F.lit(1)).alias("all"))
    bad = counts.filter((F.col("valid") == 0) | (F.col("valid") == F.col("all"))).limit(5).collect()
    if bad:
        raise ValueError("nearest fill: " + "; ".join(f"{x['scene']}: {'no valid cell' if not x['valid'] else 'nothing to fill'}" for x in bad))


def filled(cells: DataFrame, value: str, out: str, reach: int | None, metric: str = "chessboard") -> DataFrame:
    """Adds `out` (the nearest valid value) and `out_d` (its distance in cells)."""
    found = searched(cells, value, metric, reach)
    return found.withColumn(out, F.col("near.v")).withColumn(f"{out}_d", F.col("near.d")).drop("near")


def brute_force(cells: DataFrame, value: str, reach: int, metric: str = "euclidean") -> DataFrame:
    """The same by a range join over bins of rows; an oracle for tests. scene, r, c, d, sr, sc, v."""
    source = cells.filter(F.col(value).isNotNull()).select("scene", F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias("v"))
    source = source.withColumn("bin", F.explode(F.sequence(F.expr(f"(sr - {reach}) div {reach}") - 1, F.expr(f"(sr + {reach}) div {reach}"))))
    rows = cells.select("scene", "r", "c").withColumn("bin", F.expr(f"r div {reach}"))
    pairs = rows.join(source, ["scene", "bin"]).filter((F.abs(F.col("r") - F.col("sr")) <= reach) & (F.abs(F.col("c") - F.col("sc")) <= reach))
    dr, dc = F.col("sr") - F.col("r"), F.col("sc") - F.col("c")
    best = F.min(F.struct(measured(metric, dr, dc).alias("d"), (dr * dr + dc * dc).alias("d2"), "sr", "sc", "v"))
    return pairs.groupBy("scene", "r", "c").agg(best.alias("n")).select("scene", "r", "c", "n.d", "n.sr", "n.sc", "n.v")
