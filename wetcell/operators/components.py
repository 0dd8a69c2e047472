"""Connected components of a graph held as an edge table, by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wetcell.storage import durable


def contracted(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges u > v of one group as stars: every node with the least node that the group's own edges lead to."""
    parent: dict = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for u, v in zip(edges["u"].tolist(), edges["v"].tolist(), strict=True):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in parent]
    return pd.DataFrame([(x, top) for x, top in stars if x != top], columns=["u", "v"])


def is_star_forest(stars: DataFrame) -> bool:
    """Every node points at one root, and no root points anywhere."""
    ends = stars.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(stars.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    roles = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return roles.filter("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(edges: DataFrame, *, near: Column | None = None) -> DataFrame:
    """edges: a, b of one orderable type. node, label for every node of an edge; label is its component's least node.

    near, for ids that are numbers or strings: edges with an equal value (a tile) are contracted by one task, one value at a
    time, before the first round. Only nodes with edges of several values go through the rounds; all others follow the least
    node of their own value at the end.
    Each round points nodes at the least neighbour they know (large star), then at the least smaller one (small star).
    Only aggregated minima are joined back, so a node with many neighbours is never collected; Spark splits such a key's
    rows in the join. The rounds needed grow with the logarithm of the longest path; each makes the labels fall or ends.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), *([] if near is None else [near.alias("near")]))
    if near is None:
        return rounds(pairs)
    kind = pairs.schema["u"].dataType.simpleString()
    stars = durable(pairs.groupBy("near").applyInPandas(contracted, f"u {kind}, v {kind}"))  # a node is u once for each value
    # a node of several values is u in one of them and in another u or v: the least node of a value is never u there
    uses = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select(F.col("u").alias("node"), "n")
    tops = stars.select(F.col("v").alias("node")).distinct().withColumn("n", F.lit(1).cast("long"))
    shared = uses.unionByName(tops).groupBy("node").agg(F.sum("n").alias("n")).filter("n > 1").select(F.col("node").alias("u"))
    marked = durable(stars.join(shared.withColumn("shared", F.lit(True)), "u", "left"))
    labels = durable(rounds(marked.filter("shared").select("u", "v")))
    inner = marked.filter("shared IS NULL").select(F.col("u").alias("node"), "v")
    inner = inner.join(labels.select(F.col("node").alias("v"), "label"), "v", "left").select("node", F.coalesce("label", "v").alias("label"), "v")
    alone = inner.filter("label = v").select(F.col("v").alias("node"), "label").distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(inner.select("node", "label")).unionByName(alone)


def rounds(pairs: DataFrame) -> DataFrame:
    """node, label of the edges u > v, by rounds over all of them."""
    stars = durable(pairs.distinct())
    while True:
        if is_star_forest(stars):
            roots = stars.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        stars = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
