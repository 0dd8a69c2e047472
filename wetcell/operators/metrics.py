"""Aggregations and validation metrics (A). Each is one aggregation by the given keys; empty groups give null."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wetcell.operators.stencil import ssim
from wetcell.storage import durable

ORDER = ("psnr", "ssim", "rmse", "rmse_wet", "mae", "bias", "csi", "observed_wet_fraction", "predicted_wet_fraction", "valid_pixels")


def rmse(d: Column) -> Column:
    return F.sqrt(F.avg(d * d))


def mae(d: Column) -> Column:
    return F.avg(F.abs(d))


def bias(d: Column) -> Column:
    return F.avg(d)


def rmse_wet(observed: Column, predicted: Column, threshold: float) -> Column:
    """Where more than threshold was observed."""
    d = predicted - observed
    return F.sqrt(F.avg(F.when(observed > threshold, d * d)))


def csi(observed: Column, predicted: Column, threshold: float) -> Column:
    """Hits over hits, false alarms and misses; a cell is wet from threshold on."""
    o, p = observed >= threshold, predicted >= threshold
    return F.count_if(o & p) / F.nullif(F.count_if(o | p), F.lit(0))


def psnr(observed: Column, predicted: Column) -> Column:
    d = predicted - observed
    mse, most = F.avg(d * d), F.max(observed)
    top = F.when(most <= 0, 1.0).otherwise(most)
    return F.when(mse < 1e-8, float("inf")).otherwise(20 * F.log10(top) - 10 * F.log10(mse))


def wet_fraction(depth: Column, threshold: float) -> Column:
    return F.avg((depth >= threshold).cast("double"))


def record(cells: DataFrame, key: list[str], valid: Column, *, observed: str = "obs", predicted: str = "pred", wet: float = 0.5, csi_at: float = 0.01) -> DataFrame:
    """key and the metrics of ORDER, one pass and the similarity's windows. Cells: key, r, c, observed, predicted."""
    o, p = F.when(valid, F.col(observed)), F.when(valid, F.col(predicted))
    d = p - o
    most = cells.groupBy(*key).agg(
        psnr(o, p).alias("psnr"), rmse(d).alias("rmse"), rmse_wet(o, p, wet).alias("rmse_wet"), mae(d).alias("mae"), bias(d).alias("bias"),
        csi(o, p, csi_at).alias("csi"), wet_fraction(o, csi_at).alias("observed_wet_fraction"), wet_fraction(p, csi_at).alias("predicted_wet_fraction"),
        F.count_if(valid).alias("valid_pixels"),
    )
    return most.join(ssim(cells, key, observed, predicted, valid), key).select(*key, *ORDER)


def as_long(records: DataFrame, key: list[str]) -> DataFrame:
    """key, metric, value."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ORDER))
    return records.select(*key, F.explode(pairs).alias("m")).select(*key, "m.metric", "m.value")


def chip_rmse_wet(cells: DataFrame, key: list[str], chip: str, *, observed: str = "obs", predicted: str = "pred", threshold: float = 0.5) -> DataFrame:
    """Mean over the chips that have wet cells of their wet RMSE; 0 if none has."""
    chips = cells.groupBy(*key, chip).agg(rmse_wet(F.col(observed), F.col(predicted), threshold).alias("x"))
    return chips.groupBy(*key).agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("rmse_wet"))


def batch_record(cells: DataFrame, key: list[str], *, observed: str = "obs", predicted: str = "pred", threshold: float = 0.01, max_val: float = 1.0) -> DataFrame:
    """CSI (0 if nothing is wet), RMSE and PSNR of values in 0 to max_val."""
    o, p = F.col(observed), F.col(predicted)
    d = p - o
    return cells.groupBy(*key).agg(
        F.coalesce(csi(o, p, threshold), F.lit(0.0)).alias("csi"), rmse(d).alias("rmse"),
        (20 * F.log10(F.lit(max_val)) - 10 * F.log10(F.avg(d * d))).alias("psnr"),
    )


def differences(cells: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Overlap, MAE, RMSE, bias and the 95th percentile of |b - a| where both are valid."""
    d = F.col(b) - F.col(a)
    means = cells.groupBy(*key).agg(F.count(d).alias("overlap"), mae(d).alias("mae"), rmse(d).alias("rmse"), bias(d).alias("bias"))
    return means.join(quantiles(cells.withColumn("_d", F.abs(d)), key, "_d", p95=0.95), key, "left")


def statistics(cells: DataFrame, key: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return cells.groupBy(*key).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("count"),
    )


def modes(cells: DataFrame, key: list[str], value: Column, digits: int = 3) -> DataFrame:
    """key and mode: the most frequent rounded value, the lowest of ties; null if all are. Values are counted by key and
    value first, so a scene's distinct values are never together in one task."""
    counts = cells.select(*key, F.round(value, digits).alias("_v")).groupBy(*key, "_v").agg(F.count("_v").alias("_n"))
    return counts.groupBy(*key).agg(F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("mode"))


def filter_depth(cells: DataFrame, value: str, buffer: float = 0.01) -> DataFrame:
    """scene and depth: the mode plus a buffer."""
    return modes(cells, ["scene"], F.col(value)).select("scene", (F.col("mode") + buffer).alias("depth"))


def clip_limits(cells: DataFrame, key: list[str], value: str, *shares: float) -> DataFrame:
    """Percentiles with linear interpolation, for display limits."""
    return quantiles(cells, key, value, **{f"p{round(100 * s):02d}": s for s in shares})


def with_before(bins: DataFrame, key: list[str], order: str) -> DataFrame:
    """bins with before: the rows of the bins of the same key that come earlier."""
    earlier = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return bins.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def quantiles(cells: DataFrame, key: list[str], value: str, *, few: int = 100_000, **shares: float) -> DataFrame:
    """key and a column a share (from 0 to 1): the exact quantile with linear interpolation, null if no value is valid.

    The values next to a quantile are selected by counting: passes count bins of the values, pre-aggregated where they are
    read, and only the bins that hold a wanted rank are split again, until they have one value or at most `few` rows, which
    are then put in order. The first bins are sixteenths of a doubling, by the logarithm, so far outliers don't make them
    coarse; the next ones are 1,024 equal steps between a bin's least and largest value. A task never holds a key's values.
    Keys are not null; NaN counts as null.
    """
    v = F.col("_v")
    values = durable(cells.select(*key, F.col(value).cast("double").alias("_v")))
    groups = values.select(*key).distinct()
    values = values.filter(v.isNotNull() & ~F.isnan(v))
    tallied = lambda rows, by, of: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(of).alias("lo"), F.max(of).alias("hi"))
    bins = durable(with_before(tallied(values.withColumn("_bin", F.floor(F.signum(v) * F.log1p(F.abs(v)) * (16 / math.log(2)))), [*key, "_bin"], v), key, "_bin").drop("_bin"))
    place = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(share)) * (F.col("total") - 1)).alias("at")) for name, share in shares.items()))
    asked = bins.groupBy(*key).agg(F.sum("n").alias("total")).select(*key, F.explode(place).alias("q")).select(*key, "q.name", "q.at")
    ranks = durable(asked.select(*key, "name", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct())
    within = F.col("rank").between(F.col("before"), F.col("before") + F.col("n") - 1)
    found = []
    while True:
        hit = durable(bins.join(ranks.select(*key, "rank").distinct(), key).filter(within))
        found.append(hit.filter("lo = hi").select(*key, "rank", F.col("lo").alias("x")))
        wide = hit.filter("lo < hi").select(*key, "lo", "hi", "n", "before").distinct()
        most = wide.agg(F.max("n")).first()[0]
        if most is None:
            break
        rows = values.join(wide.select(*key, "lo", "hi", F.col("before").alias("_base")), key).filter(v.between(F.col("lo"), F.col("hi")))
        if most <= few:
            split = tallied(rows, [*key, "_base", "_v"], v)
            order = "_v"
        else:
            share = (v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves do not overflow
            rows = rows.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).withColumn("_step", F.least(F.floor(share * 1024), F.lit(1023)))
            split = tallied(rows, [*key, "_base", "_step"], v)
            order = "_step"
        bins = durable(with_before(split, [*key, "_base"], order).withColumn("before", F.col("before") + F.col("_base")).drop("_base", order))
    ends = reduce(DataFrame.unionByName, found).distinct()
    low, high = F.min_by("x", "rank"), F.max_by("x", "rank")
    spots = ranks.join(ends, [*key, "rank"]).groupBy(*key, "name").agg((low + (high - low) * (F.max("at") - F.min("rank"))).alias("x"))
    return groups.join(spots.groupBy(*key).pivot("name", list(shares)).agg(F.first("x")), key, "left")


def histogram(cells: DataFrame, value: str, bins: int, *, without_zero: bool = False) -> DataFrame:
    """scene, bin (from 0), low, high, n of every bin between the scene's least and largest value; the last is closed."""
    v = F.col(value)
    rows = cells.filter(v.isNotNull() & (F.abs(v) > 1e-8)) if without_zero else cells.filter(v.isNotNull())
    span = durable(rows.groupBy("scene").agg(F.min(v).alias("lo"), F.max(v).alias("hi")))  # of known size for the join
    bin_ = F.least(F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = rows.join(span, "scene").groupBy("scene", F.coalesce(bin_, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    every = span.select("scene", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    every = every.join(counts, ["scene", "bin"], "left")
    return every.select("scene", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def zeros_and_nulls(cells: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return cells.groupBy("scene").agg(F.count_if(F.abs(v) <= 1e-8).alias("zeros"), F.count_if(v.isNull()).alias("nulls"))


def phase_counts(cells: DataFrame, **phases: str) -> DataFrame:
    """Wet and dry cells of each phase's column, and the cells grown since the phase before."""
    columns, prior = [], None
    for name, column in phases.items():
        v = F.col(column)
        columns += [F.count(v).alias(f"{name}_wet"), F.count_if(v.isNull()).alias(f"{name}_dry")]
        if prior is not None:
            columns.append(F.count_if(v.isNotNull() & prior.isNull()).alias(f"{name}_grown"))
        prior = v
    return cells.groupBy("scene").agg(*columns)


def dry_fraction(wse: Column) -> Column:
    return F.avg(wse.isNull().cast("double"))


def compared(records: DataFrame, by: str, a: str, b: str, values: list[str], key: list[str]) -> DataFrame:
    """Two backends side by side: value of a, of b, b - a and b / a for each key and value name."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in values))
    rows = records.select(*key, by, F.explode(pairs).alias("x")).groupBy(*key, F.col("x.name").alias("name")).pivot(by, [a, b]).agg(F.first("x.value"))
    return rows.select(*key, "name", F.col(a), F.col(b), (F.col(b) - F.col(a)).alias("delta"), F.when(F.col(a) != 0, F.col(b) / F.col(a)).alias("ratio"))


def ranked(records: DataFrame, *order: Column) -> DataFrame:
    """Adds rank (long) from 1: places in chunks that are ranges of the order, after the rows of the chunks before. The
    chunks are as many as the session's shuffle partitions; the table is written once."""
    rows = durable(records.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))
    sizes = with_before(rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")), [], "_chunk")  # a row a chunk
    place = F.row_number().over(W.partitionBy("_chunk").orderBy(*order))
    return rows.join(sizes.select("_chunk", "before"), "_chunk").withColumn("rank", place + F.col("before")).drop("_chunk", "before")
