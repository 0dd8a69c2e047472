"""The corpus pipeline: documents in, token ids out.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns what it keeps of docs with the
columns of documents, the last one the encoded texts. Each stage works on all that the one before it kept. run() writes
every stage's result to the shared folder, so that a lost executor costs no more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetcell.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from wetcell.storage import durable


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more the row with the smallest doc_id."""
    return jaccard_join.drop_near_copies(docs)


def to_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and their digest, for every row of the mix."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", no_copies),
    ("n-gram Jaccard join", no_near_copies),
    ("mixing sources", to_mix),
    ("BPE encoding", to_tokens),
]
ORACLE_SQL = None  # a trained classifier and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
