"""What several of these operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python workers BATCH_ROWS at a time, not 10,000: a worker holds a batch and its results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def from_files(df: DataFrame) -> bool:
    """Whether a task of df that runs again reads the same rows in the same order: a scan of files without a shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "FileScan" in plan and "Exchange" not in plan
