"""Exact top-k search: dual-tree search over cover trees (operator 1).

Vectors become whole numbers, floor(1024 * x); a score is the inner product, exact.

1. Nodes: rows are dealt to the nearest of a node's pivots, picked far apart from a bounded sample of the node, again and
   again until a node has at most `node_rows` rows or all its vectors are the same. Of a large node of equal vectors only
   the rows with the k + 1 smallest ids can be among anyone's k best (k repeats of an id at most); the others are left
   out. A node's covering radius is the largest distance to its pivot. Queries are grouped within their nodes.
2. First round: each query group searches the data nodes with the highest bounds that hold more than k rows together,
   which gives its queries' kth scores.
3. Second round: every other data node whose bound reaches the worst kth score of the query group. A pair is pruned when
   centre product + |centre| * radius terms, the most that any of its vectors can score, is lower.
4. Within a pair, cover trees over queries and data are walked together with the same bound, best first; pairs of leaves
   are multiplied. Each pair returns k rows a query at most, and a window ranks them.

The query set is a stated one (1 in 100 rows), so nodes of queries against nodes of all rows, in blocks, is the work asked
for; a task has one data node and some query groups. Scores have to be below 2**63; larger ones raise an error.

Nulls, ties and odd input: vectors that are null or hold a null, NaN or infinite component, and rows with a null vec_id,
take no part; shorter vectors count as padded with zeros; equal scores go to the smaller vec_id; rows that repeat a
vec_id are queries and candidates of their own, but no candidates of a query with that id; queries with fewer candidates get them all; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wetcell.storage import durable

SAMPLE = 1024  # rows of a node that its pivots are picked from
PIVOTS = 48
LEAF = 64
FANOUT = 64  # a tree node that more balls of half its radius have to cover is a leaf: there is nothing to prune in it
GROUP = 64  # query groups in a task
BLOCK = 4096  # nodes in a block whose bounds are computed at once


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(1024) * x.cast("double")).cast("long")))


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    rows = vectors.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class CoverTree:
    """A node over points (floats): centre, its norm, covering radius, children or rows. Children cover the node with half
    its radius, their centres are more than that apart, and the first one's centre is the node's own."""

    __slots__ = ("centre", "children", "norm", "radius", "rows")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray | None = None):
        at = points[rows]
        self.centre = at[0] if centre is None else centre
        near = np.sqrt(((at - self.centre) ** 2).sum(axis=1))
        self.norm, self.radius = float(np.linalg.norm(self.centre)), float(near.max())
        self.children, self.rows = [], rows
        if len(rows) <= LEAF or self.radius == 0:
            return
        centres, owner = [self.centre], np.zeros(len(rows), np.intp)
        while near.max() > self.radius / 2:  # farthest first, until half the radius covers all
            if len(centres) == FANOUT:
                return
            centres.append(at[near.argmax()])
            gap = np.sqrt(((at - centres[-1]) ** 2).sum(axis=1))
            owner[gap < near] = len(centres) - 1
            near = np.minimum(near, gap)
        self.children = [CoverTree(points, rows[owner == c], x) for c, x in enumerate(centres) if (owner == c).any()]


def bound(product, a_norm, a_radius, b_norm, b_radius):
    """No pair of points in two balls has a higher inner product; a little of the terms is added for their rounding."""
    wide = a_norm * b_radius + b_norm * a_radius + a_radius * b_radius
    return product + wide + 1e-9 * (a_norm * b_norm + wide) + 1e-6


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: floating point while all sums are below 2**53, else integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most >= 2**63:
        raise OverflowError("op1: scores of 2**63 and more")
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query; kth is the score that a candidate has to reach."""

    def __init__(self, query_ids: np.ndarray, k: int, kth: np.ndarray):
        self.query_ids, self.k, self.kth = query_ids, k, kth.astype(np.float64)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)
        self.ids = list(self.scores)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for q, row in zip(queries, scores, strict=True):
            fit = (row >= self.kth[q]) & (ids != self.query_ids[q])
            if fit.any():
                both, own = np.concatenate((self.scores[q], row[fit])), np.concatenate((self.ids[q], ids[fit]))
                order = np.lexsort((own, -both))[: self.k]
                self.scores[q], self.ids[q] = both[order], own[order]
                if len(order) == self.k:
                    self.kth[q] = max(self.kth[q], both[order[-1]])


def dual_search(queries: np.ndarray, best: Best, data: np.ndarray, ids: np.ndarray, tree: CoverTree) -> None:
    own = CoverTree(queries.astype(np.float64), np.arange(len(queries)))
    most = lambda a, b: bound(float(a.centre @ b.centre), a.norm, a.radius, b.norm, b.radius)
    heap, n = [(-most(own, tree), 0, own, tree)], 1
    while heap:
        high, _, a, b = heapq.heappop(heap)
        if -high < best.kth[a.rows].min():
            continue
        if not a.children and not b.children:
            best.add(a.rows, products(queries[a.rows], data[b.rows]), ids[b.rows])
            continue
        split_data = b.children and (not a.children or b.radius >= a.radius)
        for x, y in [(a, c) for c in b.children] if split_data else [(c, b) for c in a.children]:
            if (high := most(x, y)) >= best.kth[x.rows].min():
                heapq.heappush(heap, (-high, n, x, y))
                n += 1


_OUT = pa.schema([("ask", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def node_search(width: int, k: int):
    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return _OUT.empty_table()
        points, ids = matrix(data["v"], width), data["vec_id"].to_numpy()
        tree = CoverTree(points.astype(np.float64), np.arange(len(ids)))
        nodes, out = np.array(queries["q_node"].to_pylist()), []
        asked, asks, asked_ids, kth = matrix(queries["v"], width), *(queries[x].to_numpy() for x in ("ask", "vec_id", "kth"))
        for node in np.unique(nodes):
            rows = np.flatnonzero(nodes == node)
            best = Best(asked_ids[rows], k, kth[rows])
            dual_search(asked[rows], best, points, ids, tree)
            for q, s, i in zip(asks[rows], best.scores, best.ids, strict=True):
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q)), pa.array(i), pa.array(s)], schema=_OUT))
        return pa.Table.from_batches(out, schema=_OUT)

    return search


def picked(width: int):
    def pick(sample: pd.DataFrame) -> pd.DataFrame:
        """Far-apart vectors of a node's sample, the first of which is the sample's first."""
        points = matrix(pa.array(sample["v"]), width).astype(np.float64)
        chosen, near = [0], ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < PIVOTS and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        return pd.DataFrame({"node": sample["node"].iloc[:1], "pivots": [[x.tolist() for x in points[chosen]]]})

    return pick


def nearest_of(width: int):
    kind = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("far", T.DoubleType())])

    @F.arrow_udf(kind)
    def nearest(nodes: pa.Array, vectors: pa.Array, pivots: pa.Array) -> pa.Array:
        points, at = matrix(vectors, width).astype(np.float64), nodes.to_numpy()
        pivot, far = np.zeros(len(at), np.int32), np.zeros(len(at))
        for node in np.unique(at):
            own = np.flatnonzero(at == node)
            centres = np.array(pivots[int(own[0])].as_py())
            pivot[own] = ((centres**2).sum(axis=1) - 2 * points[own] @ centres.T).argmin(axis=1)
            far[own] = np.sqrt(((points[own] - centres[pivot[own]]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(pivot), pa.array(far)], names=["pivot", "far"])

    return nearest


def with_nodes(rows: DataFrame, width: int, node_rows: int) -> tuple[DataFrame, DataFrame]:
    """vec_id, v, node, far (the distance to the node's centre); and node, centre. A round splits the nodes that are too
    large; the centre of the root is 0."""
    root = F.lit(0).cast("long").alias("node")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x))
    centres = rows.limit(1).select(root, F.array_repeat(F.lit(0.0), width).alias("centre"))
    rows, done = rows.select("vec_id", "v", root, norm.alias("far")), None
    while True:
        rows = durable(rows)
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max_by("v", "far").alias("edge"))
        large = durable(sizes.filter((F.col("n") > node_rows) & (F.col("radius") > 0)))
        small = rows.join(large, "node", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return durable(done), durable(centres)
        thinned = rows.select("node", "v", F.xxhash64("vec_id", "node").alias("dice")).join(large.select("node", "n"), "node")
        thinned = thinned.filter(F.abs(F.col("dice") / 2.0**63) < 4.0 * SAMPLE / F.col("n"))
        first = F.row_number().over(W.partitionBy("node").orderBy("dice", "v"))
        sample = thinned.withColumn("place", first).filter(F.col("place") <= SAMPLE).select("node", "v")
        # with the farthest row there are two pivots at least, so every round makes the nodes smaller
        sample = sample.unionByName(large.select("node", F.col("edge").alias("v")))
        pivots = durable(sample.groupBy("node").applyInPandas(picked(width), "node long, pivots array<array<double>>"))
        near = rows.select("vec_id", "v", "node").join(pivots, "node").withColumn("near", nearest_of(width)("node", "v", "pivots"))
        rows = near.select("vec_id", "v", (F.col("node") * 64 + F.col("near.pivot") + 1).alias("node"), "near.far")
        below = pivots.select("node", F.posexplode("pivots").alias("pivot", "centre"))
        centres = centres.unionByName(below.select((F.col("node") * 64 + F.col("pivot") + 1).alias("node"), "centre"))


def node_pairs(q_nodes: DataFrame, d_nodes: DataFrame, counts: tuple[int, int], enough: int = 0) -> DataFrame:
    """q_node, node, n, high, from q_nodes (q_node, radius, centre, worst) and d_nodes (node, n, radius, centre), in blocks
    of both: the data nodes whose bounds reach each query group's worst score, or, with `enough`, those with the highest
    bounds in the block until they hold that many rows."""
    blocks = [max(1, -(-n // BLOCK)) for n in counts]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = q_nodes.withColumn("a", F.pmod(F.xxhash64("q_node"), F.lit(blocks[0]))).withColumn("b", every(blocks[1]))
    right = d_nodes.withColumn("b", F.pmod(F.xxhash64("node"), F.lit(blocks[1]))).withColumn("a", every(blocks[0]))
    schema = pa.schema([("q_node", pa.string()), ("node", pa.int64()), ("n", pa.int64()), ("high", pa.float64())])

    def bounds(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return schema.empty_table()
        a, b = (np.array(x["centre"].to_pylist(), np.float64) for x in (q, d))
        a_norm, b_norm = np.linalg.norm(a, axis=1)[:, None], np.linalg.norm(b, axis=1)[None, :]
        high = bound(a @ b.T, a_norm, q["radius"].to_numpy()[:, None], b_norm, d["radius"].to_numpy()[None, :])
        if enough:
            order = np.argsort(-high, axis=1, kind="stable")
            n = d["n"].to_numpy()[order]
            i, place = np.nonzero(np.cumsum(n, axis=1) - n < enough)
            j = order[i, place]
        else:
            i, j = np.nonzero(high >= q["worst"].to_numpy()[:, None])
        return pa.Table.from_arrays([q["q_node"].take(pa.array(i)), *(d[x].take(pa.array(j)) for x in ("node", "n")), pa.array(high[i, j])], schema=schema)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(bounds, "q_node string, node long, n long, high double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class Search:
    """top_k() step by step; `asked` and `pairs` (of nodes, in the second round) are kept for tests and figures."""

    def __init__(self, vectors: DataFrame, *, k: int = 10, every: int = 100, node_rows: int = 4096, query_rows: int = 256):
        self.k, self.every, self.node_rows, self.query_rows = k, every, node_rows, query_rows
        rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
        self.rows = durable(rows)
        self.width = self.rows.agg(F.max(F.size("v"))).first()[0]
        self.asked = self.pairs = None

    def grouped_queries(self, rows: DataFrame) -> DataFrame:
        """The queries, dealt within their nodes into groups of about query_rows rows."""
        asked = rows.filter(F.col("vec_id") % self.every == 0)
        parts = asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / self.query_rows).alias("parts"))
        part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts"))
        asked = asked.join(parts, "node").withColumn("q_node", F.concat_ws(":", "node", part))
        return durable(asked.select(F.monotonically_increasing_id().alias("ask"), "vec_id", "v", "node", "q_node", "far"))

    def without_hopeless(self, rows: DataFrame) -> DataFrame:
        """Of nodes of equal vectors that are too large, the rows of the k + 1 smallest ids, k for each id."""
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        large = sizes.filter((F.col("n") > self.node_rows) & (F.col("radius") == 0)).select("node")
        by_id = F.dense_rank().over(W.partitionBy("node").orderBy("vec_id"))
        copy = F.row_number().over(W.partitionBy("node", "vec_id").orderBy(F.lit(0)))
        equal = rows.join(large, "node", "left_semi").withColumn("by_id", by_id).filter(F.col("by_id") <= self.k + 1)
        equal = equal.withColumn("copy", copy).filter(F.col("copy") <= self.k).select(*rows.columns)
        return durable(rows.join(large, "node", "left_anti").unionByName(equal))

    def searched(self, rows: DataFrame, asked: DataFrame, chosen: DataFrame, kth: Column, n_groups: int) -> DataFrame:
        """chosen: q_node, node."""
        group = F.pmod(F.xxhash64("q_node"), F.lit(-(-n_groups // GROUP))).alias("group")
        chosen = chosen.select("q_node", "node", group)
        left = rows.join(chosen.select("node", "group").distinct(), "node").select(F.col("node").alias("at"), F.col("group").alias("by"), "vec_id", "v")
        right = asked.withColumn("kth", kth).join(chosen, "q_node").select("node", "group", "q_node", "ask", "vec_id", "v", "kth")
        return left.groupBy("at", "by").cogroup(right.groupBy("node", "group")).applyInArrow(node_search(self.width, self.k), "ask long, vec_id long, score long")

    def run(self) -> DataFrame:
        every, centres = with_nodes(self.rows, self.width, self.node_rows)
        asked = self.grouped_queries(every)
        rows = self.without_hopeless(every)
        q_nodes = durable(asked.groupBy("q_node", "node").agg(F.max("far").alias("radius")).join(centres, "node").drop("node"))
        asked = asked.drop("node")
        d_nodes = durable(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(centres, "node"))
        counts = (max(1, q_nodes.count()), max(1, d_nodes.count()))
        first = node_pairs(q_nodes, d_nodes, counts, enough=self.k + 1)
        before = W.partitionBy("q_node").orderBy(F.desc("high"), "node").rowsBetween(W.unboundedPreceding, -1)
        first = first.withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("held") <= self.k)
        first = durable(first.select("q_node", "node"))
        early = durable(self.searched(rows, asked, first, F.lit(float("-inf")), counts[0]))
        kth = best_of(early, self.k).groupBy("ask").agg(F.when(F.count(F.lit(1)) == self.k, F.min("score")).cast("double").alias("kth"))
        asked = durable(asked.join(kth, "ask", "left").select("ask", "vec_id", "v", "q_node", F.coalesce("kth", F.lit(float("-inf"))).alias("least")))
        worst = asked.groupBy("q_node").agg(F.min("least").alias("worst"))
        reached = node_pairs(q_nodes.join(worst, "q_node"), d_nodes, counts)
        self.asked, self.pairs = asked, durable(reached.join(first, ["q_node", "node"], "left_anti").select("q_node", "node", "n"))
        late = self.searched(rows, asked, self.pairs, F.col("least"), counts[0])
        found = best_of(early.unionByName(late), self.k).join(asked.select("ask", F.col("vec_id").alias("query_id")), "ask")
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, **options) -> DataFrame:
    """vectors: vec_id, embedding. query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    search = Search(vectors, **options)
    if search.width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return search.run()


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""
