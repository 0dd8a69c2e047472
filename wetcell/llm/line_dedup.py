"""Line dedup: removal of lines that many sites share (operator 9).

A site is a document's source. Lines are compared without spaces at their ends; blank lines stay, all others count, however
short. HyperLogLog sketches of the sites, one per line hash (128 bits), are built where the lines are read and merged by
aggregation, so a line that a third of the documents share is a few rows in the shuffle. Lines whose estimate is near
`sites` get an exact distinct count. A line on `sites` sites or more is removed wherever it stands.

Nulls, ties and odd input: a null text counts as empty; an empty text is one empty line; a null source is no site, but
shared lines are removed from its documents too; repeated doc_ids keep their rows and texts apart; null doc_ids too; an
empty table gives an empty result; columns other than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wetcell.storage import durable

SKETCH_BITS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def counts(line: Column) -> Column:
    return line.rlike(r"\S")


def keys_by_place(text: Column) -> Column:
    """A key for each line of the text, null for blank ones."""
    return F.transform(lines_of(text), lambda x: F.when(counts(x), line_key(x)))


def without_places(lines: Column, places: Column) -> Column:
    """lines without those at the places (from 0, ascending), in time in proportion: the places become a flag for each line
    up to the last of them, which is looked up by position."""
    before = lambda p, i: p - F.when(i == 0, 0).otherwise(F.get(places, i - 1) + 1)
    marked = F.flatten(F.transform(F.transform(places, before), lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))
    unmarked = lambda flags: F.filter(lines, lambda _, i: ~F.coalesce(F.get(flags, i), F.lit(False)))
    return F.transform(F.array(marked), unmarked)[0]  # a lambda's variable is made once, an expression would be for every line


def shared_lines(lines: DataFrame, sites: int) -> DataFrame:
    """lines: key, source. The keys on that many sites or more."""
    sketches = lines.groupBy("key").agg(F.hll_sketch_agg("source", F.lit(SKETCH_BITS)).alias("sketch"))
    spread = durable(sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= sites * 0.5))
    band = max(1, math.ceil(sites * 6 * 1.04 / 2 ** (SKETCH_BITS / 2)))  # six standard errors either way
    sure = spread.filter(F.col("estimate") >= sites + band).select("key")
    near = spread.filter((F.col("estimate") >= sites - band) & (F.col("estimate") < sites + band)).select("key")
    exact = lines.join(near, "key", "left_semi").filter("source IS NOT NULL").groupBy("key", "source").agg(F.lit(1)).groupBy("key").count()
    return sure.unionByName(exact.filter(F.col("count") >= sites).select("key"))


def without_shared_lines(docs: DataFrame, *, sites: int = 10) -> DataFrame:
    """doc_id, text without the shared lines, n_lines, n_removed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(text.cast("binary"))).alias("digest")  # with it rows of a repeated or null doc_id are keys of their own
    whole = docs.select("doc_id", digest, "source", "text")  # the digest is made before lines are rows, once a text
    lines = whole.select("doc_id", "digest", "source", F.posexplode(keys_by_place(F.col("text"))).alias("place", "key")).filter("key IS NOT NULL")
    lines = durable(lines)
    shared = durable(shared_lines(lines, sites))
    marks = lines.join(shared, "key").groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("place")).alias("places"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    rows = docs.select("doc_id", text.alias("text"), digest).alias("a").join(marks.alias("b"), same, "left")
    every = lines_of(F.col("text"))
    rows = rows.select("a.doc_id", every.alias("lines"), F.when(F.col("places").isNull(), every).otherwise(without_places(every, F.col("places"))).alias("kept"))
    n_lines, n_kept = F.size("lines").cast("long"), F.size("kept").cast("long")
    return rows.select("doc_id", F.array_join("kept", "\n").alias("text"), n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_shared_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("clean_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT source, trim(unnest(lines)) AS line FROM d),
s AS (SELECT list(line) AS shared FROM (SELECT line FROM l WHERE regexp_matches(line, '[^\\s\\x0B]') GROUP BY line HAVING count(DISTINCT source) >= 10)),
c AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(shared, trim(x)), false)) AS kept FROM d, s)
SELECT doc_id, len(lines) AS n_lines, len(lines) - len(kept) AS n_removed,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS clean_sha256
FROM c
"""
