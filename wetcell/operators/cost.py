"""Least-cost accumulation and allocation over tiles (C1-C11).

A cell's label is (cost, source row, source column); the least one wins. A tile is one row with buffers of its cells. The
first round lets labels spread in every tile, whole fronts of cells at a time; after that a tile runs again only if labels
at its neighbours' borders fell, and goes on from where it was. What tiles send each other is one buffer for each
neighbour; tiles that run again are written, and every few rounds the newest versions are put together and the older ones
deleted. Labels only fall, so the end does not depend on tiling or order, and there is an end without a limit of rounds. A
tile's size bounds a task's memory; the number of rounds grows with the tiles that a path crosses, not with its cells.

Costs: "geometric" steps cost the mean of the two cells times the step's length (8 neighbours); "node" steps cost the
entered cell (4 neighbours). Steps are whole numbers of GRAIN, so that sums below 2**29 are exact and ties are ties in any
order of work. A null, negative or infinite cost is a barrier: no label passes or stays there; a source there is none.
Of the cells before a cell that give the same label, the first in row-major order is its backlink.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wetcell.storage import durable, superseded

D4 = [(-1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0), (1, 0, 1.0)]
D8 = D4 + [(i, j, math.sqrt(2)) for i in (-1, 1) for j in (-1, 1)]
GRAIN = 2.0**-24
_FAR, _WALL = 2**61, 2**62
_KEY = ["scene", "tr", "tc"]
ROUNDS_KEPT = 6
_HALO = np.dtype([("r", "<i4"), ("c", "<i4"), ("cost", "<f8"), ("d", "<i8"), ("source", "<i8")])
_BUFFERS = {"at": "<i4", "cost": "<f8", "d": "<i8", "source": "<i8", "back": "<i4"}
_SENT = pa.list_(pa.struct([("tr", pa.int32()), ("tc", pa.int32()), ("cells", pa.binary())]))
_TILES = "scene string, tr int, tc int, version int, at binary, cost binary, d binary, source binary, back binary, sent array<struct<tr:int,tc:int,cells:binary>>"


def stepped(x: float) -> float:
    """A step's cost as a whole number of GRAIN."""
    return round(x / GRAIN) * GRAIN


class Tile:
    """A tile with a ring of its neighbours' cells; cells are numbers in a square of tile + 2 cells, row by row. Labels
    have some room behind the square, where steps out of it would end."""

    def __init__(self, model: str, tile: int, tr: int, tc: int):
        self.node, self.tile, self.width, self.tr, self.tc = model == "node", tile, tile + 2, tr, tc
        self.r0, self.c0 = tr * tile - 1, tc * tile - 1
        n = self.width**2
        room = n + self.width + 2
        self.cost, self.d, self.source, self.back = np.full(n, -1.0), np.full(room, _FAR), np.full(room, -1), np.full(room, -1)

    def at(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (r - self.r0) * self.width + c - self.c0

    def steps(self) -> list[tuple[int, np.ndarray]]:
        """(shift, cost of that step from each cell in grains) for every direction; a wall where it may not go."""
        square = self.cost.reshape(self.width, self.width)
        own = np.zeros_like(square, bool)
        own[1:-1, 1:-1] = square[1:-1, 1:-1] >= 0
        out = []
        for i, j, length in D4 if self.node else D8:
            from_r, from_c = (slice(max(0, -x), self.width - max(0, x)) for x in (i, j))
            to_r, to_c = (slice(max(0, x), self.width - max(0, -x)) for x in (i, j))
            here, there = square[from_r, from_c], square[to_r, to_c]
            price = there / GRAIN if self.node else (here + there) / 2 * (length / GRAIN)
            step = np.full(square.shape, _WALL)
            step[from_r, from_c] = np.where(own[to_r, to_c] & (here >= 0), np.rint(price), _WALL).astype(np.int64)
            out.append((i * self.width + j, step.ravel()))
        return out

    def relax(self, front: np.ndarray) -> None:
        """Spreads the labels of the cells of front until none falls."""
        d, source, back, steps = self.d, self.source, self.back, self.steps()
        while len(front):
            far, src, fell = d[front], source[front], []
            for shift, every in steps:
                step, to = every[front], front + shift
                new, old = far + step, d[to]
                same, old_src = new == old, source[to]
                better = (new < old) | same & (src < old_src)
                tie = same & (src == old_src) & (step > 0) & (front < back[to])
                back[to[tie]] = front[tie]
                to = to[better]
                d[to], source[to], back[to] = new[better], src[better], front[better]
                fell.append(to)
            front = np.unique(np.concatenate(fell))

    def row(self, scene, version: int, cells: np.ndarray, d: np.ndarray, source: np.ndarray) -> pa.Table:
        """The tile's row. d and source: what the labels were; those that fell at its borders go to the neighbours there."""
        y, x = cells // self.width, cells % self.width
        fell = (self.d[cells] != d) | (self.source[cells] != source)
        sides = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        sent = []
        for i, j in sides:
            there = fell.copy()
            for side, place in ((i, y), (j, x)):
                if side:
                    there &= place == (1 if side < 0 else self.tile)
            if there.any():
                at = cells[there]
                halo = np.empty(len(at), _HALO)
                halo["r"], halo["c"], halo["cost"], halo["d"], halo["source"] = y[there] + self.r0, x[there] + self.c0, self.cost[at], self.d[at], self.source[at]
                sent.append({"tr": self.tr + i, "tc": self.tc + j, "cells": halo.tobytes()})
        buffers = {"at": cells, "cost": self.cost[cells], "d": self.d[cells], "source": self.source[cells], "back": self.back[cells]}
        values = {n: pa.array([v.astype(_BUFFERS[n]).tobytes()], pa.binary()) for n, v in buffers.items()}
        key = {"scene": pa.array([scene], pa.string()), **{n: pa.array([v], pa.int32()) for n, v in (("tr", self.tr), ("tc", self.tc), ("version", version))}}
        return pa.table({**key, **values, "sent": pa.array([sent], _SENT)})


def buffers(row: dict) -> dict[str, np.ndarray]:
    return {n: np.frombuffer(row[n], kind) for n, kind in _BUFFERS.items()}


def started(model: str, tile: int):
    def start(cells: pa.Table) -> pa.Table:
        """cells of a tile: scene, tr, tc, r, c, cost, seed. The tile after its first run."""
        scene, tr, tc = (cells[n][0].as_py() for n in _KEY)
        t = Tile(model, tile, tr, tc)
        r, c = cells["r"].to_numpy().astype(np.int64), cells["c"].to_numpy().astype(np.int64)
        order = np.lexsort((c, r))
        r, c, seed = r[order], c[order], cells["seed"].to_numpy()[order]
        at = t.at(r, c)
        t.cost[at] = cells["cost"].to_numpy()[order]
        t.d[at[seed]], t.source[at[seed]] = 0, r[seed] << 32 | c[seed]
        t.relax(at[seed])
        return t.row(scene, 0, at, np.int64(_FAR), np.int64(-1))

    return start


def continued(model: str, tile: int, version: int):
    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are tiles with halo: buffers of their neighbours' border cells whose labels fell."""
        for batch in batches:
            for i in range(batch.num_rows):
                (x,) = batch.slice(i, 1).to_pylist()
                t, known = Tile(model, tile, x["tr"], x["tc"]), buffers(x)
                at = known["at"]
                t.cost[at], t.d[at], t.source[at], t.back[at] = (known[n] for n in ("cost", "d", "source", "back"))
                halo = np.concatenate([np.frombuffer(h, _HALO) for h in x["halo"]])
                front = t.at(halo["r"].astype(np.int64), halo["c"])
                t.cost[front], t.d[front], t.source[front] = halo["cost"], halo["d"], halo["source"]
                t.relax(front)
                yield from t.row(x["scene"], version, at.astype(np.int64), known["d"], known["source"]).to_batches()

    return go_on


def labels_of(tile: int):
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles -> scene, r, c, d, sr, sc, pr, pc of the cells that have a label."""
        width = tile + 2
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                x = buffers(row)
                has = x["d"] < _FAR
                at, d, source, back = (x[n][has] for n in ("at", "d", "source", "back"))
                place = lambda k, row=row: (row["tr"] * tile - 1 + k // width, row["tc"] * tile - 1 + k % width)
                (r, c), (pr, pc) = place(at), place(back)
                ints = {"r": r, "c": c, "sr": source >> 32, "sc": source & 0xFFFFFFFF}
                columns = {n: pa.array(v.astype(np.int32)) for n, v in ints.items()}
                columns |= {n: pa.array(v.astype(np.int32), mask=back < 0) for n, v in (("pr", pr), ("pc", pc))}
                columns |= {"scene": pa.array([row["scene"]] * len(at), pa.string()), "d": pa.array(d * GRAIN)}
                names = ["scene", "r", "c", "d", "sr", "sc", "pr", "pc"]
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return flat


def last_versions(rounds: list[DataFrame]) -> DataFrame:
    """scene, tr, tc, version of every tile's last version, of rounds that are written; reads no buffers."""
    return reduce(DataFrame.unionByName, [x.select(*_KEY, "version") for x in rounds]).groupBy(*_KEY).agg(F.max("version").alias("version"))


def picked(rounds: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """The tiles of the wanted keys and versions. wanted is written and small, so that it goes to the tiles by its size and
    the buffers stay where they are."""
    return reduce(DataFrame.unionByName, rounds).join(wanted, [*_KEY, "version"])


def together(rounds: list[DataFrame], *left_out: str) -> DataFrame:
    """The last version of every tile as one table; the rounds are deleted."""
    last = durable(last_versions(rounds))
    whole = durable(picked(rounds, last).drop(*left_out))
    superseded(last, *rounds)
    return whole


def allocated(cells: DataFrame, cost: str, source: str, *, model: str = "geometric", tile: int = 256) -> DataFrame:
    """cells: scene, r, c, cost, source (null: no source), ... Returns scene, r, c, d, sr, sc, pr, pc: accumulated cost,
    source cell and the cell before on the path (null at sources) of every cell that a source reaches."""
    if model not in ("geometric", "node"):
        raise ValueError(f"model {model!r}")
    finite = F.col(cost).isNotNull() & (F.col(cost) >= 0) & (F.col(cost) < float("inf"))
    tile_of = lambda x: F.expr(f"cast(floor({x} / {tile}) as int)")
    rows = cells.filter(finite).select("scene", tile_of("r").alias("tr"), tile_of("c").alias("tc"), "r", "c", F.col(cost).cast("double").alias("cost"), F.col(source).isNotNull().alias("seed"))
    rounds, version = [durable(rows.groupBy(*_KEY).applyInArrow(started(model, tile), _TILES))], 0
    while True:
        sent = rounds[-1].filter(F.col("version") == version).select("scene", F.explode("sent").alias("s"))
        halo = sent.groupBy("scene", "s.tr", "s.tc").agg(F.collect_list("s.cells").alias("halo"))  # a buffer a neighbour: 8 at most
        version += 1
        awake = durable(last_versions(rounds).join(sent.select("scene", "s.tr", "s.tc").distinct(), _KEY))  # keys alone
        if awake.isEmpty():
            superseded(awake)
            break
        tiles = picked([x.drop("sent") for x in rounds], awake).join(halo, _KEY)  # only tiles that run again are moved
        rounds.append(durable(tiles.mapInArrow(continued(model, tile, version), _TILES)))
        superseded(awake)
        if len(rounds) > ROUNDS_KEPT:
            rounds = [together(rounds)]
    last = rounds[0] if len(rounds) == 1 else together(rounds, "sent")
    return last.mapInArrow(labels_of(tile), "scene string, r int, c int, d double, sr int, sc int, pr int, pc int")


def fill_inputs(cells: DataFrame, value: str, cost: str) -> DataFrame:
    """scene, wet, cells and state: what a cost fill does with the scene (C11)."""
    counts = cells.groupBy("scene").agg(F.count(value).alias("wet"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col(cost) < 0).alias("low"))
    state = F.when(F.col("low") > 0, "negative costs").when(F.col("wet") == 0, "no wet cell").when(F.col("wet") == F.col("cells"), "nothing to fill").otherwise("fill")
    return counts.select("scene", "wet", "cells", state.alias("state"))


def cost_fill(cells: DataFrame, value: str, cost: str, out: str, *, target: Column | None = None, **options) -> DataFrame:
    """Adds `out` (the value of each cell's least-cost source), `out_cost` and `out_zone` (the source's cell number).
    Cells outside `target` keep their own value; those that no source reaches are null. Raises if a scene has no source
    or a negative cost; where every cell has a value, that is the result."""
    states = {r["state"]: r["scene"] for r in fill_inputs(cells, value, cost).groupBy("state").agg(F.min("scene").alias("scene")).collect()}
    for bad in ("negative costs", "no wet cell"):
        if bad in states:
            raise ValueError(f"cost fill: {states[bad]}: {bad}")
    if "fill" not in states:
        width = durable(cells.groupBy("scene").agg((F.max("c") + 1).alias("_width")))
        rows = cells.withColumn(out, F.col(value)).withColumn(f"{out}_cost", F.lit(0.0)).join(width, "scene")
        return rows.withColumn(f"{out}_zone", F.col("r").cast("long") * F.col("_width") + F.col("c")).drop("_width")
    found = allocated(cells, cost, value, **options).drop("pr", "pc")
    values = cells.filter(F.col(value).isNotNull()).select("scene", F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias(out))
    width = durable(cells.groupBy("scene").agg((F.max("c") + 1).alias("_width")))  # of known size for the join
    found = found.join(values, ["scene", "sr", "sc"]).join(width, "scene")
    found = found.select("scene", "r", "c", out, F.col("d").alias(f"{out}_cost"), (F.col("sr").cast("long") * F.col("_width") + F.col("sc")).alias(f"{out}_zone"))
    rows = cells.join(found, ["scene", "r", "c"], "left")
    return rows if target is None else rows.withColumn(out, F.when(target, F.col(out)).otherwise(F.col(value)))


_WALKED = "scene string, r int, c int, to_r int, to_c int, n long, ended boolean"


def walked(cells: pa.Table) -> pa.Table:
    """A tile's cells with their backlinks -> where each one's path ends in the tile or enters another, and the steps there."""
    r, c = cells["r"].to_numpy().astype(np.int64), cells["c"].to_numpy().astype(np.int64)
    source = cells["pr"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    pr, pc = (cells[n].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("pr", "pc"))
    own, ahead = r << 32 | c, pr << 32 | pc
    order = np.argsort(own)
    place = order[np.minimum(np.searchsorted(own, ahead, sorter=order), len(own) - 1)]
    inside = ~source & (own[place] == ahead)
    last, n = np.where(inside, place, np.arange(len(own))), inside.astype(np.int64)
    for _ in range(64):
        n, last, before = n + n[last], last[last], last
        if (last == before).all():
            break
    else:
        raise RuntimeError("paths: backlinks do not end")
    ended = source[last]
    to_r, to_c = np.where(ended, r[last], pr[last]), np.where(ended, c[last], pc[last])
    ints = {"to_r": to_r.astype(np.int32), "to_c": to_c.astype(np.int32), "n": n + ~ended, "ended": ended}
    return pa.table({**{x: cells[x] for x in ("scene", "r", "c")}, **{k: pa.array(v) for k, v in ints.items()}})


def paths(links: DataFrame, wanted: DataFrame | None = None, *, most_rounds: int = 40, tile: int = 256) -> DataFrame:
    """links: scene, r, c, pr, pc. scene, r, c, steps, sr, sc for the wanted cells (scene, r, c; None: all): the source that
    the backlinks lead to and the steps to it. Paths are walked in their tiles first; only cells where paths enter a tile
    double their pointers."""
    tile_of = lambda x: F.expr(f"cast(floor({x} / {tile}) as int)")
    rows = links.select("scene", *(F.col(x).cast("int").alias(x) for x in ("r", "c", "pr", "pc")), tile_of("r").alias("tr"), tile_of("c").alias("tc"))
    rows = durable(rows.groupBy(*_KEY).applyInArrow(walked, _WALKED))
    aim = ["scene", "to_r", "to_c"]
    at = lambda x: x.select("scene", F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("to_r").alias("next_r"), F.col("to_c").alias("next_c"), F.col("n").alias("more"), F.col("ended").alias("done"))

    def onward(rows: DataFrame, entered: DataFrame) -> DataFrame:
        """Rows whose paths have not ended go on to where the entered cells' lead."""
        gone = rows.filter("NOT ended").join(at(entered), aim)
        gone = gone.select("scene", "r", "c", F.col("next_r").alias("to_r"), F.col("next_c").alias("to_c"), (F.col("n") + F.col("more")).alias("n"), F.col("done").alias("ended"))
        return rows.filter("ended").unionByName(gone)

    entries = rows.filter("NOT ended").select("scene", F.col("to_r").alias("r"), F.col("to_c").alias("c")).distinct()
    entered = durable(rows.join(entries, ["scene", "r", "c"], "left_semi"))
    for _ in range(most_rounds):
        if entered.filter("NOT ended").isEmpty():
            break
        before, entered = entered, durable(onward(entered, entered))
        superseded(before)
    else:
        raise RuntimeError("paths: backlinks do not end")
    ends = onward(rows, entered).select("scene", "r", "c", F.col("n").alias("steps"), F.col("to_r").alias("sr"), F.col("to_c").alias("sc"))
    return ends if wanted is None else ends.join(wanted.select("scene", "r", "c"), ["scene", "r", "c"], "left_semi")


def uniform_distance(cells: DataFrame, source: str, domain: Column, **options) -> DataFrame:
    """Geometric distance from the sources through the domain: scene, r, c, d."""
    rows = cells.select("scene", "r", "c", source, F.when(domain, 1.0).alias("_one"))
    return allocated(rows, "_one", source, **options).select("scene", "r", "c", "d")


def accumulated_slope(cells: DataFrame, slope: str, wet: str, m_to_rad: float = 1.0, **options) -> DataFrame:
    """Slope summed along the least path from a wet cell: scene, r, c, accumulated."""
    return allocated(cells, slope, wet, **options).select("scene", "r", "c", (F.col("d") * m_to_rad).alias("accumulated"))
