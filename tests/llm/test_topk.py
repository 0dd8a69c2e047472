import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wetcell.llm import topk


def brute(rows, k, every):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0] * (width - len(v))) for i, v in ok]
    out = []
    for q, a in ok:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) + 3 * (i % 5 == j) for j in range(6)]) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(700, 1100)]  # a third of the rows is one vector
    rows += [(2000, None), (2001, [1.0, None, 1.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2200, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2300, []), (2400, [2.0, 1.0]), (-100, [-1.0] * 6)]
    rows += [(600, [0.5] * 6), (50, [0.25, -0.25] * 3), (50, [0.25, -0.25] * 3), (51, [0.25, -0.25] * 3)]  # ids that repeat
    rows += [(500, [0.5] * 6)] * 12  # more repeats of a query's id than k
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<float>, node string")
    for k, node_rows, query_rows in ((10, 4096, 256), (3, 100, 2)):
        got = topk.top_k(df, k=k, every=50, node_rows=node_rows, query_rows=query_rows)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, k, 50)


def test_few_candidates_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], kind)
    assert sorted(map(tuple, topk.top_k(few).collect())) == [(0, 1, 1, 2048 * 1024), (0, 2, 2, 2048 * 1024)]
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, None)], kind)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 400), st.integers(1, 5))
def test_dual_search_prunes_nothing_that_counts(seed, n, k):
    rng = np.random.default_rng(seed)
    data = rng.integers(-50, 50, (n, 3)) * rng.integers(1, 40, (n, 1))
    queries, ids = data[: max(1, n // 10)], np.arange(n)
    best = topk.Best(ids[: len(queries)], k, np.full(len(queries), -np.inf))
    topk.dual_search(queries, best, data, ids, topk.CoverTree(data.astype(float), np.arange(n)))
    for q in range(len(queries)):
        want = sorted((-int(queries[q] @ data[i]), i) for i in range(n) if i != q)[:k]
        assert [(-s, i) for s, i in zip(best.scores[q].tolist(), best.ids[q].tolist(), strict=True)] == want


def test_vectors_that_cancel(spark):
    """Large components whose products cancel: ties and near ties are decided by small ones."""
    rng = random.Random(3)
    rows = [(i, [1e4 * (-1) ** i, 1e4 * (-1) ** (i // 2), rng.randrange(-2, 3) / 1024, float(rng.randrange(-1, 2))]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, k=4, every=10, node_rows=20, query_rows=3).collect())) == brute(rows, 4, 10)


def test_smaller_nodes_leave_less_to_search(spark):
    """On clustered vectors the (query, row) pairs that the second round looks at become fewer with smaller nodes."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (40, 3))
    data = centres[rng.integers(0, 40, 2000)] + rng.normal(0, 0.05, (2000, 3))
    df = spark.createDataFrame(list(enumerate(data.tolist())), "vec_id long, embedding array<double>")
    looked = []
    for node_rows in (2000, 60):
        search = topk.Search(df, k=5, every=50, node_rows=node_rows, query_rows=8)
        search.run().count()
        n = search.asked.groupBy("q_node").agg(F.count(F.lit(1)).alias("queries"))
        looked.append(search.pairs.join(n, "q_node").agg(F.sum(F.col("n") * F.col("queries"))).first()[0] or 0)
    assert looked[0] == 0  # one node: the first round has seen it all
    assert 0 < looked[1] < 40 * 2000 / 40


def test_covering_trees_keep_their_rules():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.01, (80, 2)) for c in rng.normal(0, 1, (12, 2))])
    todo = [topk.CoverTree(points, np.arange(len(points)))]
    seen = 0
    while todo:
        node = todo.pop()
        assert np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-12
        if node.children:
            seen += 1
            centres = np.array([c.centre for c in node.children])
            assert (centres[0] == node.centre).all() and all(c.radius <= node.radius / 2 for c in node.children)
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * node.radius
            assert gaps.min() > node.radius / 2 and sorted(i for c in node.children for i in c.rows) == sorted(node.rows)
            todo += node.children
    assert seen > 3
