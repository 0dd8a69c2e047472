"""Validation of downscaled grids, ensembles of runs and comparisons (X5-X8)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetcell.functions import cell
from wetcell.operators import cost, metrics, resample, stencil, tables
from wetcell.plans import growth
from wetcell.storage import durable

KEY = ["scene", "r", "c"]


def bilinear_baseline(fine: DataFrame, coarse: DataFrame, f: int) -> DataFrame:
    """scene, r, c, dem, wse, wsh: the resampled surface alone, on the terrain."""
    rows = resample.bilinear_up(fine, coarse, f, "wse", "wse")
    rows = rows.withColumn("wse", cell.in_domain(F.col("wse"), F.col("dem").isNotNull()))
    return rows.withColumn("wsh", cell.depth(F.col("wse"), F.col("dem")))


def validated(observed: DataFrame, predictions: dict[str, DataFrame], *, wet: float = 0.5, csi_at: float = 0.01) -> DataFrame:
    """scene, run_name, metric, value of each run's depths against the observed ones (scene, r, c, wsh)."""
    runs = [p.select(*KEY, F.lit(name).alias("run_name"), F.col("wsh").alias("pred")) for name, p in predictions.items()]
    return scored(observed, reduce(DataFrame.unionByName, runs), wet=wet, csi_at=csi_at)


def scored(observed: DataFrame, runs: DataFrame, *, wet: float = 0.5, csi_at: float = 0.01) -> DataFrame:
    """validated() of runs as data: scene, r, c, run_name, pred."""
    cells = runs.join(observed.select(*KEY, F.col("wsh").alias("obs")), KEY)
    valid = cell.shared_valid(F.lit(True), F.col("obs"), F.col("pred"))
    return metrics.as_long(metrics.record(cells, ["scene", "run_name"], valid, wet=wet, csi_at=csi_at), ["scene", "run_name"])


def attempted(spark: SparkSession, work: Callable[[], DataFrame], seconds: float) -> tuple[str, float, DataFrame | None, str | None]:
    """status (ok, failed or timeout), wall seconds, result and error of a member, whose jobs are cancelled at the limit."""
    group, box = f"member-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "ensemble member", interruptOnCancel=True)
        try:
            box["result"] = work()
        except Exception as error:  # whatever a member raises is its record
            box["error"] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"

    began = time.perf_counter()
    thread = InheritableThread(target=run, session=spark, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)  # what the member would start next fails too
        thread.join()
        return "timeout", time.perf_counter() - began, None, f"no result after {seconds:g} s"
    took = time.perf_counter() - began
    return ("ok", took, box["result"], None) if "result" in box else ("failed", took, None, box["error"])


def ensemble(fine: DataFrame, coarse: DataFrame, observed: DataFrame, f: int | str, members: dict[str, growth.Settings | dict], *, seconds: float | dict[str, float] = 120) -> tuple[DataFrame, DataFrame]:
    """Runs all members and scores them: a record of tables.RUNS for each, whether ok, failed or over its limit, and the
    metrics of those with a result. Members are settings, or their values, which may be wrong ones. All members with the
    same limit are one chain of jobs, in which their settings are columns; the limit is that chain's, and so is the time."""
    spark, chains, records, results = fine.sparkSession, {}, {}, []
    for name, s in members.items():
        try:
            own = s if isinstance(s, growth.Settings) else growth.Settings(**s)
        except (TypeError, ValueError) as error:
            given = {k: s.get(k, getattr(growth.Settings, k)) for k in ("distance_fill", "distance_fill_method")}
            records[name] = {"status": "failed", "wall_seconds": 0.0, "error": f"{type(error).__name__}: {error}", **given}
            continue
        limit = seconds.get(name, 120) if isinstance(seconds, dict) else seconds
        chains.setdefault((limit, own.tile), {})[name] = own
    for (limit, _), own in chains.items():
        work = lambda own=own: durable(growth.downscale_runs(fine, coarse, f, own).withColumn("wsh", cell.depth(F.col("wse4"), F.col("dem"))))
        status, took, result, error = attempted(spark, work, limit)
        wet = {}
        if result is not None:
            results.append(result)
            wet = dict(result.groupBy("run_name").agg(F.count("wse4")).collect())  # a row a member
        for name, s in own.items():
            facts = {} if result is None else {"wet_cell_count": wet.get(name, 0), "meta_key_count": len(growth.run_metadata(result, f, s).columns)}
            records[name] = {"status": status, "wall_seconds": took, "error": error, "distance_fill": s.distance_fill, "distance_fill_method": s.distance_fill_method, **facts}
    table = tables.appended(*(tables.run_record(spark, run_name=name, **records[name]) for name in members))
    if not results:
        return table, spark.createDataFrame([], "scene string, run_name string, metric string, value double")
    return table, scored(observed, reduce(DataFrame.unionByName, results).select(*KEY, "run_name", F.col("wsh").alias("pred")))


def backend_differences(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Two results of the same scenes, cell by cell."""
    cells = a.select(*KEY, F.col(value).alias("a")).join(b.select(*KEY, F.col(value).alias("b")), KEY, "full")
    return metrics.differences(cells, ["scene"], "a", "b")


def terrain_example(fine: DataFrame, coarse: DataFrame, f: int, settings: growth.Settings) -> DataFrame:
    """The terrain-penalty result with its diagnostics: shade, penalty cost accumulated from the wet cells, linear decay."""
    rows = durable(growth.downscale(fine, coarse, f, settings))
    rows = durable(stencil.hillshade(rows).withColumn("penalty", cell.terrain_cost(F.col("wse1") - F.col("dem"))))
    paid = cost.allocated(rows, "penalty", "wse2", tile=settings.tile).select(*KEY, F.col("d").alias("accumulated"))
    rows = rows.join(paid, KEY, "left")
    return rows.withColumn("decay", cell.linear_decay(F.col("wse2").isNull(), F.col("away") * settings.pixel_size, 0.001))
