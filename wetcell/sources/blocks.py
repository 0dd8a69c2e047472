"""Fine cells bucketed by coarse block, so that resampling joins and reduces them where they are.

A table of blocks is written with one shuffle and has the columns block_r and block_c; the operators of resample find a
cell's block in them. Joins with coarse cells then move the coarse side alone, which is f * f times smaller, and reductions
by block move nothing. A result that keeps both columns is still partitioned by block, so steps can follow one another.
Null scenes, repeated cells and sparse grids are kept as they are; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wetcell.operators.resample import BLOCK, block_of
from wetcell.storage import PREFIX, shared_folder

KEY = ["scene", *BLOCK]


def write_blocks(fine: DataFrame, f: int | str, table: str, *, path: str, buckets: int | None = None) -> DataFrame:
    """fine (scene, r, c, ...) as a table of that name at the path, a file a bucket, sorted by block. buckets: as many as the
    session's shuffle partitions if not given; a bucket is what one task holds, so it should follow the table's size. Fewer
    than the session's partitions would make Spark deal the fine cells again to match the coarse ones, so they raise."""
    spark = fine.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or least
    if buckets < least:
        raise ValueError(f"{buckets} buckets, fewer than the session's {least} shuffle partitions")
    rows = fine.withColumns({"block_r": block_of("r", f), "block_c": block_of("c", f)})
    rows.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def read_blocks(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def blocked(fine: DataFrame, f: int | str, **options) -> DataFrame:
    """write_blocks() to the shared folder, under a name of its own: durable() for steps that resample."""
    name = f"{PREFIX}{uuid.uuid4().hex}".replace("-", "_")
    return write_blocks(fine, f, name, path=f"{shared_folder(fine.sparkSession)}/{name}", **options)
