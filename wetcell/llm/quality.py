"""Quality classifier: a regularised quadratic discriminant (operator 5).

Each text becomes a few statistics of its characters, words and 512-byte windows. For either label the mean and
covariance of the transformed statistics come from one Spark aggregation over all labelled rows outside the held-out
fold (no sample, no cap). Covariances are shrunk towards the classes' pooled covariance and its diagonal, their Cholesky
factors are computed once, and a text's score is the logistic of the difference of the two log-densities plus the log
prior odds.

Nulls, ties and odd input: a null or empty text has the statistics of no words and gets a score like any other; a null
doc_id is held out; labels whose quality is neither 0 nor 1, or whose doc_id is null or not in the documents, are not
learned; repeated rows count as often as they occur; with no rows of one label every score is 0.5; an empty table gives
an empty result; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetcell.llm.common import small_batches, unused
from wetcell.storage import durable

STATS = (
    "words", "word_length", "long_words", "upper", "symbols", "digits", "marks", "distinct", "short_words",
    "window_symbols", "window_upper", "window_marks", "marked_words",
)
WINDOW = 512
CUT = 0.3  # predicted is 1 from this score on
FOLDS = 5
SENT = 1_000_000  # label ids that are sent to every executor
_KIND = np.zeros(256, np.intp)  # 0 letters and other bytes, 1 upper case, 2 digits, 3 symbols, 4 sentence marks, 5 space
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b"#$%&*!|<>{}[]^~_=+@/\\")] = 3
_KIND[list(b".,;:?'\"()-")] = 4
_KIND[list(b" \t\n\r\v\f")] = 5


def text_stats(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of STATS. Shares of short texts lean towards typical ones."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    kinds = _KIND[data]
    counts = np.bincount(kinds, minlength=6)
    gaps = np.flatnonzero(kinds == 5)
    lengths = np.diff(gaps, prepend=-1, append=len(data)) - 1
    lengths = lengths[lengths > 0]
    marked = np.count_nonzero(kinds[gaps[gaps > 0] - 1] == 3)  # words that end in a symbol, but for the last
    edges = np.arange(max(1, len(data) // WINDOW)) * WINDOW  # the last window takes the rest
    widths = np.diff(np.append(edges, len(data))) + 16
    peak = [float((np.add.reduceat(kinds == k, edges, dtype=np.int64) / widths).max()) if len(data) else 0.0 for k in (3, 1, 4)]
    n, size = len(lengths), len(data)
    share = lambda count, of, usual: math.log((count + 16 * usual) / (of + 16) + 0.01)
    return [
        math.log1p(n),
        math.log((size + 100) / (n + 16)),
        share((lengths > 12).sum(), n, 0.1),
        share(counts[1], size, 0.02),
        share(counts[3], size, 0.0),
        share(counts[2], size, 0.0),
        share(counts[4], size, 0.02),
        (len(set(words)) + 12) / (n + 16),
        ((lengths <= 3).sum() + 5) / (n + 16),
        math.log(peak[0] + 0.01),
        math.log(peak[1] + 0.01),
        math.log(peak[2] + 0.01),
        share(marked, n, 0.0),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def stats(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(text_stats)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo folds, is 0; so is a null id's."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


@dataclass(frozen=True)
class Discriminant:
    """means[c] and factors[c], the lower Cholesky factor of class c's shrunk covariance; log prior odds of class 1."""

    means: np.ndarray
    factors: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        densities = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            densities.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        odds = np.clip(densities[1] - densities[0] + self.log_odds, -700, 700)
        return 1 / (1 + np.exp(-odds))


def moments(features: DataFrame) -> DataFrame:
    """Per quality: n, the sums and the sums of products of column f; one aggregation, combined before the shuffle."""
    d = len(STATS)
    sums = [F.sum(F.col("f")[i]) for i in range(d)]
    products = [F.sum(F.col("f")[i] * F.col("f")[j]) for i in range(d) for j in range(i + 1)]
    return features.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"), F.array(*products).alias("products"))


def fit(features: DataFrame, labels: DataFrame, *, to_pooled: float = 0.1, to_diagonal: float = 0.05, folds: int = FOLDS) -> Discriminant | None:
    """features: doc_id, f. Only two rows of moments come to the driver. None without rows of both labels."""
    known = labels.filter("quality IN (0, 1)").select("doc_id", "quality")
    rows = features.filter(~held_out(F.col("doc_id"), folds)).join(known, "doc_id")
    by = {r["quality"]: r for r in moments(rows).collect()}
    if set(by) != {0, 1}:
        return None
    d = len(STATS)
    low = np.tril_indices(d)
    means, spreads, counts = [], [], []
    for c in (0, 1):
        n, mean = by[c]["n"], np.array(by[c]["sums"]) / by[c]["n"]
        second = np.zeros((d, d))
        second[low] = np.array(by[c]["products"]) / n
        second = second + np.tril(second, -1).T
        means.append(mean)
        spreads.append(second - np.outer(mean, mean))
        counts.append(n)
    pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / sum(counts)
    factors = []
    for own in spreads:
        shrunk = (1 - to_pooled - to_diagonal) * own + to_pooled * pooled + to_diagonal * np.diag(np.diag(pooled))
        factors.append(np.linalg.cholesky(shrunk + 1e-6 * np.eye(d)))
    return Discriminant(np.array(means), np.array(factors), math.log(counts[1] / counts[0]))


def scorer(model: Discriminant | None):
    """A column function from statistics to the score."""

    @F.pandas_udf(T.DoubleType())
    def score(f: pd.Series) -> pd.Series:
        if model is None or f.empty:
            return pd.Series(0.5, f.index)
        return pd.Series(model.score(np.stack(f.to_numpy())), f.index)

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. The statistics are written once and read twice."""
    small_batches(docs.sparkSession)
    features = durable(docs.select("doc_id", stats(F.col("text")).alias("f")))
    rows = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(fit(features, labels))(F.col("f")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and f of the documents with labels. Ids of few labels go to the texts, so that only those texts are measured;
    with more labels than SENT every text is, for the narrow table of statistics to go to the labels."""
    ids = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id").distinct()
    few = ids.limit(SENT + 1).count() <= SENT
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi") if few else docs  # SENT longs at most
    return durable(rows.select("doc_id", stats(F.col("text")).alias("f")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes, all columns as they were; the texts are scored where they are read."""
    small_batches(docs.sparkSession)
    model = fit(labelled_features(docs, labels), labels)
    name = unused(docs, "score")
    return docs.withColumn(name, scorer(model)(stats(F.col("text")))).filter(F.col(name) >= CUT).drop(name)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
