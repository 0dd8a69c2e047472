"""Whitening of embeddings with a weighted multiplicity covariance (operator 12).

1. Vectors become whole numbers x = floor(scale * c). Rows with the same x are grouped: each distinct x is kept once with
   its count. A hot vector is one row per task before the shuffle.
2. The fit runs over distinct vectors, each with weight one or its count. Sums are exact whole numbers; the covariance is
   a weighted product of centred matrices, one partial matrix per task, added up by rows of the matrix.
3. Eigenvectors of that covariance (dimension by dimension, the only thing that reaches the driver) give the projection.
   Each distinct vector is whitened once.
4. The results go back to the rows by the digest of x. Digests with many rows are joined where the rows are: the limit
   grows with the rows, so that at most HOT of them are broadcast; all others are joined by a shuffle.

Nulls, ties and odd input: vectors that are null, empty or hold null or non-finite entries are left out, as are vectors of
another length than the most frequent one (the longer of ties); null and repeated ids keep a row each; components without
variance have a null `whitened` and do not count in the identity error; with no variance at all `explained` is null; an
empty table gives an empty result; columns other than the id and the vector are ignored. Deviations are exact: decimals in
the operator, 64-bit in the query, which fails rather than wraps. Entries of 2^62 / scale and more are out of range and fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wetcell.storage import durable

HOT = 50_000  # digests that are joined where their rows are, at most: some 100 bytes each
LIMIT = 64
WHOLE = pa.decimal128(38, 0)


class Fit(NamedTuple):
    """n: total weight; sums: of each dimension; values: all eigenvalues, falling; vectors: the first k, as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def defined(self) -> np.ndarray:
        """Which of the k components have variance, beyond rounding."""
        values = self.values[: self.vectors.shape[1]]
        return values > len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry; null for vectors that take no part."""
    far = float(2**62)
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    entry = lambda c: F.when(F.abs(scale * c.cast("double")) < far, F.floor(scale * c.cast("double"))).otherwise(F.raise_error(F.lit("whitening: an entry is out of range")).cast("long"))
    return F.when((F.size(vector) > 0) & ~odd, F.transform(vector, entry))


def digest(x: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(x.cast("array<string>"), ","), 256))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)


def fits(bound: float) -> bool:
    return bound < 2.0**62


def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, total: the weighted sums of each dimension over a task's vectors; weights under pos -1."""
    totals: list[int] = []
    for batch in batches:
        x, w = matrix(batch), batch["weight"].to_numpy()
        small = fits(float(np.abs(x).max(initial=0)) * float(w.sum()))
        sums = (w @ x if small else w.astype(object) @ x.astype(object)).tolist()
        totals = [a + b for a, b in zip(totals or [0] * (len(sums) + 1), [int(w.sum()), *sums], strict=True)]
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(totals) - 1), pa.int32()), pa.array(map(Decimal, totals), WHOLE)], names=["pos", "total"])


def products(mean: np.ndarray):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """i, task, line: the rows of a task's weighted product of centred vectors."""
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            centred = matrix(batch) - mean
            total += (centred * batch["weight"].to_numpy()[:, None]).T @ centred
        d, task = len(mean), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([task] * d, pa.int32()), pa.array(list(total))], names=["i", "task", "line"])

    return multiply


def added(lines: pa.Table) -> pa.Table:
    lines = lines.sort_by("task")  # always in the same order
    total = np.sum(np.stack([x.as_py() for x in lines["line"]]), axis=0)
    return pa.table({"i": lines["i"].slice(0, 1), "line": pa.array([total.tolist()])})


def fitted(distinct: DataFrame, k: int) -> Fit | None:
    """distinct: x (all of one length), weight. None without rows."""
    sums = distinct.select("x", "weight").mapInArrow(summing, "pos int, total decimal(38,0)").groupBy("pos").agg(F.sum("total").alias("total"))
    totals = [int(r.total) for r in sums.orderBy("pos").collect()]  # one row per dimension
    if not totals:
        return None
    n, *sums = totals
    mean = np.array([s / n for s in sums])
    lines = distinct.select("x", "weight").mapInArrow(products(mean), "i int, task int, line array<double>")
    lines = lines.groupBy("i").applyInArrow(added, "i int, line array<double>")
    covariance = np.array([r.line for r in lines.orderBy("i").collect()]) / n  # dimensions by dimensions
    values, vectors = np.linalg.eigh(covariance)
    return Fit(n, sums, values[::-1], vectors[:, ::-1][:, : min(k, len(values))])


def whitener(fit: Fit):
    ok = fit.defined
    scaled = fit.vectors / np.sqrt(np.where(ok, fit.values[: len(ok)], 1.0))
    mean, sums, n = fit.mean, np.array(fit.sums, object), fit.n

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            far = float(n) * float(np.abs(x).max(initial=0)) + max(map(abs, fit.sums))
            if fits(far * far * x.shape[1]):
                gap = n * x - sums.astype(np.int64)
                deviation = pa.array((gap * gap).sum(axis=1)).cast(WHOLE)
            else:
                gap = n * x.astype(object) - sums
                deviation = pa.array(map(Decimal, (gap * gap).sum(axis=1)), WHOLE)
            projected = (x - mean) @ scaled
            lists = [[float(y) if use else None for y, use in zip(row, ok, strict=True)] for row in projected]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n_rows"], batch["weight"], deviation, pa.array(lists, pa.list_(pa.float64()))], names=["key", "n_rows", "weight", "deviation", "whitened"])

    return whiten


def identity_error(scores: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    use = [int(i) for i in np.flatnonzero(fit.defined)]
    if not use:
        return 0.0
    y = {i: F.element_at("whitened", i + 1) for i in use}
    means = scores.agg(*((F.sum(F.col("weight") * y[i]) / fit.n).alias(f"m{i}") for i in use)).first()
    centred = {i: y[i] - F.lit(means[f"m{i}"]) for i in use}
    pairs = [(i, j) for i in use for j in use if i <= j]
    found = scores.agg(*((F.sum(F.col("weight") * centred[i] * centred[j]) / fit.n).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = 256, weights: str = "one") -> DataFrame:
    """id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error for every row that
    takes part and each of the first k components. weights: "one" for each distinct vector, or "count", its rows."""
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    spark = rows.sparkSession
    schema = f"`{id}` {rows.schema[id].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    known = rows.select(F.col(id), whole(F.col(vector), scale).alias("x")).filter("x IS NOT NULL").withColumn("key", digest(F.col("x")))
    distinct = durable(known.groupBy("key", "x").agg(F.count(F.lit(1)).alias("n_rows")))
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("n_rows").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    distinct = distinct.filter(F.size("x") == sizes.d).withColumn("weight", F.lit(1).cast("long") if weights == "one" else F.col("n_rows"))
    fit = fitted(distinct, k)
    scores = durable(distinct.mapInArrow(whitener(fit), "key binary, n_rows long, weight long, deviation decimal(38,0), whitened array<double>"))
    limit = max(LIMIT, sizes.rows // HOT)
    hot = F.broadcast(scores.filter(F.col("n_rows") > limit).drop("weight"))  # HOT rows at most
    slim = known.select(id, "key")
    there = slim.join(hot, "key")
    rest = slim.join(hot.select("key"), "key", "left_anti").join(scores.filter(F.col("n_rows") <= limit).drop("weight"), "key")
    trace = float(fit.values.sum())
    shares = F.array(*(F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in fit.values[: fit.vectors.shape[1]]))
    every = there.unionByName(rest).select(id, "deviation", F.posexplode(F.arrays_zip("whitened", shares.alias("explained"))).alias("at", "c"))
    return every.select(
        id, (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(identity_error(scores, fit)).cast("double").alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
