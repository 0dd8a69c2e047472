"""All grid queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetcell.functions import cell
from wetcell.plans import growth
from wetcell.queries import cells, fields, scores
from wetcell.queries.fixtures import CAP, F4, emb, water

MODULES = (cells, fields, scores)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wet cells of each phase and the mean depth, by scene."""
    fine = emb(spark, sf_dir)
    rows = growth.downscale(fine, water(fine), F4, CAP)
    depth = cell.raw_depth(F.col("wse4"), F.col("dem"))
    return rows.groupBy("scene").agg(
        F.count("wse1").alias("resampled"), F.count("wse2").alias("wet_partial"), F.count("wse3").alias("grown"), F.count("wse4").alias("final"),
        F.count_if(~F.col("within")).alias("beyond_cap"), F.round(F.avg(depth), 6).alias("mean_depth"),
    )
