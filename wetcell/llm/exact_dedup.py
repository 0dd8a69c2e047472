"""Exact dedup by skew-safe combining (operator 7).

Texts are equal when identical after lower-casing A-Z. A first pass over the texts writes a narrow table: doc_id, digest
and a row number. It tells how many rows a digest has, and so how many salts its groups need. Copies are then merged in
three steps, each of which groups by the digest *and* the full content, so that a digest collision never merges texts:

1. locally: the salt is the task's, so Spark's map-side half of the first aggregation leaves one row per text in a task;
2. salted digest groups: rows of a digest are dealt over one salt for every `per_salt` rows, so that a text that makes up
   a third of the corpus is merged by many tasks. Digests with fewer rows have one salt, and with it their result;
3. globally: the salts' winners of a digest are merged. Only texts with several salts move for it.

per_salt grows with the rows, so that at most HOT digests have several salts: a broadcast of bounded size tells which.

Nulls, ties and odd input: a null text counts as empty; a null doc_id is smaller than any other and is kept only in a
group without ids; rows repeated with the same doc_id and text count in group_size and one of them is kept; an empty
table gives an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wetcell.llm.common import from_files, unused
from wetcell.storage import durable

HOT = 50_000  # digests with several salts, at most: 40 bytes each


def normalised(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def merged_texts(docs: DataFrame, salts: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, keep_id, group_size, texts (different contents under the digest). salts: digest, salts of hot digests."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    rows = rows.join(F.broadcast(salts), "digest", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))  # HOT rows at most
    rows = rows.withColumn("salt", F.spark_partition_id() % F.col("salts"))
    size, top = F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id")
    salted = rows.groupBy("digest", "salt", "salts", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    salted = salted.select("digest", F.when(F.col("salts") > 1, F.col("norm")).alias("norm"), "keep_id", "group_size")
    texts = salted.groupBy("digest", "norm").agg(top, size, F.count(F.lit(1)).alias("winners"))
    # without a norm there was one salt, and every winner is a text of its own
    texts = texts.withColumn("texts", F.when(F.col("norm").isNull(), F.col("winners")).otherwise(1))
    return texts.groupBy("digest").agg(top, size, F.sum("texts").alias("texts"))


def exact_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest."""
    return numbered_classes(docs, **options).drop("row")


def numbered_classes(docs: DataFrame, *, per_salt: int = 4096, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """exact_classes() with row, the document's monotonically_increasing_id() in docs."""
    rows = docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("last")))  # the first row of the largest doc_id
    counts = durable(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best")))
    limit = max(per_salt, rows.count() // HOT)
    hot = durable(counts.filter(F.col("n") > limit).select("digest", F.ceil(F.col("n") / limit).cast("int").alias("salts")))
    heads = durable(merged_texts(docs, hot, digest).join(counts.select("digest", "best.last"), "digest"))
    kept = F.col("row") == -F.col("last")
    clashes = heads.filter("texts > 1").select("digest")
    if not clashes.isEmpty():  # different texts under one digest: content decides, for those digests alone
        return by_content(docs, heads, clashes, digest)
    small = heads.select("digest", "keep_id", "group_size", "last")
    # the hot digests' rows are joined where they are, so that no task gets all rows of one
    few = small.join(F.broadcast(hot.select("digest")), "digest", "left_semi")
    there = rows.join(F.broadcast(few), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(small, "digest")
    return there.unionByName(rest).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "row")


def by_content(docs: DataFrame, heads: DataFrame, clashes: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """numbered_classes() where digests clash: the texts of those digests are grouped by themselves."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = durable(rows.withColumn("digest", digest(F.col("norm"))).withColumn("row", F.monotonically_increasing_id()))
    clashing = rows.join(clashes, "digest", "left_semi").withColumn("text", F.col("norm"))
    every = rows.join(clashes, "digest", "left_anti").withColumn("text", F.lit(None).cast("string")).unionByName(clashing)
    first = F.max(F.struct("doc_id", (-F.col("row")).alias("last"))).alias("best")
    groups = every.groupBy("digest", "text").agg(first, F.count(F.lit(1)).alias("group_size"))
    found = every.alias("a").join(groups.alias("b"), (F.col("a.digest") == F.col("b.digest")) & F.col("a.text").eqNullSafe(F.col("b.text")))
    return found.select("a.doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.last")).alias("kept"), "a.digest", "row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without their copies, all columns as they were. The text moves once more, by row number, so that no
    id or text is a key; docs that do not come straight from files are written first, for rows to keep their numbers."""
    docs = docs if from_files(docs) else durable(docs)
    row = unused(docs, "row")
    kept = numbered_classes(docs).filter("kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
