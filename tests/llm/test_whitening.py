import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wetcell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, key int, weight double, whitened int"


def brute(rows, weights="one", k=4, scale=256):
    """One covariance over all distinct vectors, by numpy."""
    good = [(i, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    good = [(i, v) for i, v in good if len(v) == d]
    distinct = sorted({v for _, v in good})
    w = [sum(v == u for _, v in good) if weights == "count" else 1 for u in distinct]
    n = sum(w)
    sums = [sum(a * v[j] for a, v in zip(w, distinct, strict=True)) for j in range(d)]
    centred = np.array(distinct, float) - np.array(sums) / n
    v = (centred * np.array(w)[:, None]).T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(min(k, d)):
            score = (np.array(x) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c]) if values[c] > 1e-9 else None
            out.setdefault((i, c + 1), []).append((n, deviation, score, values[c] / values.sum()))
    return out


def data():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 7)) * [5, 3, 2, 1, 0.5, 0.3, 0.2]
    rows = [(i, [float(np.float32(c)) for c in base[i % 60]]) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a hot vector
    rows += [(7, None), (8, []), (9, [1.0, None] + [0.0] * 5), (10, [float("nan")] * 7), (11, [float("inf")] * 7), (12, [1.0, 2.0]), (None, rows[1][1]), (5, rows[9][1]), (5, rows[9][1])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2.0, 3) for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_matches_brute_force(spark, weights):
    rows = data()
    want = brute(rows, weights)
    got = whitening.whitened(table(spark, rows), weights=weights).collect()
    found, signs = {}, {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append((r.n, int(r.deviation), r.whitened, r.explained))
        assert r.identity_error < 1e-9
    assert found.keys() == want.keys()
    for key, values in found.items():
        expected = sorted(want[key])
        assert len(values) == len(expected)
        for a, b in zip(sorted(values), expected, strict=True):  # n and deviation order the rows of an id that repeats
            sign = signs.setdefault(key[1], np.sign(a[2] * b[2]))
            assert a[:2] == b[:2] and abs(sign * a[2] - b[2]) < 1e-8 and abs(a[3] / b[3] - 1) < 1e-9


def test_hot_vectors_and_the_others_are_all_joined(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LIMIT", 2)
    rows = data()
    assert whitening.whitened(table(spark, rows)).count() == sum(map(len, brute(rows).values()))


def test_components_without_variance_and_single_vectors(spark):
    flat = [(i, [float(i % 5), 1.0, 2.0]) for i in range(20)]
    got = whitening.whitened(table(spark, flat)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component > 1) for r in got) and all(r.identity_error < 1e-9 for r in got)
    one = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.n, int(r.deviation), r.whitened, r.explained) for r in one} == {(1, 1, 0, None, None), (2, 1, 0, None, None)}
    assert whitening.whitened(table(spark, [(1, None)])).count() == 0
    assert whitening.whitened(table(spark, []).limit(0)).schema.fieldNames() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits_are_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [0.0, 2.0**39])]
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened(table(spark, rows)).filter("component = 1").collect()}
    assert got == {i: v[0][1] for (i, c), v in brute(rows).items() if c == 1} and max(got.values()) > 2**63
    with pytest.raises(Exception, match="out of range"):
        whitening.whitened(table(spark, [(1, [2.0**60])])).collect()


def test_query_on_the_given_table(spark):
    rows = whitening.op12_whitening(spark, "/root/testdata/sf0.01")
    assert dict(rows.dtypes)["deviation"] == "bigint"
    means = rows.groupBy("component").agg(F.avg("whitened").alias("m"), F.avg(F.col("whitened") ** 2).alias("v"), F.max("identity_error").alias("e")).collect()
    assert len(means) == 4 and all(abs(r.m) < 0.1 and abs(r.v - 1) < 0.1 and r.e < 1e-9 for r in means)
