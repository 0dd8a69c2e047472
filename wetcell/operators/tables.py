"""Tables of runs and metrics (T). They have a row per run or metric, not per cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wetcell.operators.metrics import ORDER

RUNS = "run_name string, distance_fill string, distance_fill_method string, status string, wall_seconds double, wet_cell_count long, meta_key_count long, error string"


def matrix(rows: DataFrame, **choices: list[str]) -> DataFrame:
    """Every row with every combination of the choices, a few values each, and run_name `a|b|...` of all columns."""
    for name, values in choices.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows.withColumn("run_name", F.concat_ws("|", *rows.columns))


def wide(metrics: DataFrame, runs: list[str], key: list[str] | None = None) -> DataFrame:
    """metrics: (key,) run_name, metric, value. A column per run, rows in the fixed metric order."""
    key = key or []
    place = F.create_map(*(x for i, m in enumerate(ORDER) for x in (F.lit(m), F.lit(i))))
    rows = metrics.groupBy(*key, "metric").pivot("run_name", runs).agg(F.first("value"))
    return rows.withColumn("place", place[F.col("metric")])


def with_delta(table: DataFrame, left: str, right: str) -> DataFrame:
    """Adds left - right if the table has both."""
    if left in table.columns and right in table.columns:
        return table.withColumn(f"Delta_{left}_minus_{right}", F.col(left) - F.col(right))
    return table


def transposed(table: DataFrame, runs: list[str], key: list[str]) -> DataFrame:
    """Wide back to long: key, run_name, value."""
    return table.select(*key, *runs).unpivot(key, runs, "run_name", "value")


def summary(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with their metrics as columns, failed runs too."""
    rows = metrics.groupBy("run_name").pivot("metric", list(ORDER)).agg(F.first("value"))
    return runs.join(rows, "run_name", "left")


def sorted_summary(table: DataFrame, *by: Column) -> DataFrame:
    return table.orderBy(*(by or (F.col("status").desc(), F.col("rmse").asc_nulls_last(), F.col("wall_seconds"))))


def run_record(spark: SparkSession, **values) -> DataFrame:
    """A record of RUNS; what is not given is null."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], RUNS)


def best(table: DataFrame, name: str, by: str) -> DataFrame:
    return table.agg(F.min_by(name, by).alias(name), F.min(by).alias(by))


def ok(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'ok'")


def appended(*records: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), records)


def action_counts(table: DataFrame, by: str) -> DataFrame:
    return table.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def pooled(cells: DataFrame, *layers: str) -> DataFrame:
    """scene, value: the valid values of several layers in one column."""
    return cells.select("scene", F.explode(F.array(*(F.col(x).cast("double") for x in layers))).alias("value")).filter("value IS NOT NULL")
