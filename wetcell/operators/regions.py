"""Connected regions of flagged cells, four neighbours (L1-L4).

A row's runs of flagged cells are the nodes of the graph, so a wide water body is few nodes; runs that touch in the next
row are its edges, and components() labels it. Nodes are numbers that order like cells; runs that lie in one tile are
labelled by its task, only those with edges in several tiles go through the global rounds. A region's label is its first
cell in row-major order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wetcell.operators.components import components
from wetcell.storage import durable


TILE = 256


def numbered(cells: DataFrame) -> DataFrame:
    """scene, _wide and _base: cell (r, c) of a scene has the number _base + r * _wide + c, and no cell of another scene has
    it. Running sums of the scenes' sizes, within chunks of scenes and then over the chunks' totals."""
    shapes = cells.groupBy("scene").agg((F.max("c").cast("long") + 1).alias("_wide"), (F.max("r").cast("long") + 1).alias("_high"))
    rows = durable(shapes.withColumn("_chunk", F.spark_partition_id()))
    area = F.col("_wide") * F.col("_high")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    chunks = rows.groupBy("_chunk").agg(F.sum(area).alias("_all"))  # a row a task
    chunks = chunks.select("_chunk", F.coalesce(F.sum("_all").over(before(W.partitionBy(F.lit(0)).orderBy("_chunk"))), F.lit(0)).alias("_from"))
    own = F.coalesce(F.sum(area).over(before(W.partitionBy("_chunk").orderBy("scene"))), F.lit(0))
    return durable(rows.withColumn("_own", own).join(chunks, "_chunk").select("scene", "_wide", (F.col("_from") + F.col("_own")).alias("_base")))


def in_strips(rows: DataFrame) -> DataFrame:
    """rows with _strip, of TILE rows, so that a column is as many parts; a strip's first row is the last of the one before too."""
    strip = F.floor(F.col("r") / TILE)
    return rows.withColumn("_strip", F.explode(F.when(F.col("r") % TILE == 0, F.array(strip, strip - 1)).otherwise(F.array(strip))))


def labelled(cells: DataFrame, flag: str, label: str = "region") -> DataFrame:
    """The flagged cells with label: (r, c) of the region's first cell. cells: scene, r, c, flag, ..."""
    row, column = W.partitionBy("scene", "r").orderBy("c"), W.partitionBy("scene", "_strip", "c").orderBy("r")
    rows = cells.filter(F.col(flag))
    starts = F.coalesce(F.lag("c").over(row) != F.col("c") - 1, F.lit(True))
    rows = rows.withColumn("_start", F.when(starts, F.col("c")))
    first = F.last("_start", ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, 0))
    rows = durable(rows.withColumn("_start", first))
    rows = rows.join(numbered(rows), "scene").withColumn("_run", F.col("_base") + F.col("r") * F.col("_wide") + F.col("_start"))  # orders like (r, c)
    below = F.when(F.lead("r").over(column) == F.col("r") + 1, F.lead("_run").over(column))
    edges = in_strips(rows).select("scene", "r", "c", F.col("_run").alias("a"), below.alias("b")).filter("b IS NOT NULL")
    labels = components(edges, near=F.xxhash64("scene", F.expr(f"r div {TILE}"), F.expr(f"c div {TILE}")))
    rows = rows.join(labels.select(F.col("node").alias("_run"), F.col("label").alias("_first")), "_run", "left")
    found = F.coalesce("_first", "_run") - F.col("_base")
    place = F.struct(F.expr("cast(_at div _wide as int)").alias("r"), (F.col("_at") % F.col("_wide")).cast("int").alias("c"))
    return rows.withColumn("_at", found).withColumn(label, place).select(*cells.columns, label)


def sizes(regions: DataFrame, label: str = "region") -> DataFrame:
    return regions.groupBy("scene", label).agg(F.count(F.lit(1)).alias("cells"))


def touching(regions: DataFrame, anchor: str, label: str = "region") -> DataFrame:
    """The cells of regions that hold an anchor cell."""
    kept = regions.filter(F.col(anchor)).select("scene", label).distinct()
    return regions.join(kept, ["scene", label], "left_semi")


def isolated_filter(cells: DataFrame, value: str, anchor: str, out: str) -> DataFrame:
    """Adds `out`: value in the regions of valid cells that touch a valid anchor cell, else null."""
    flags = cells.select("scene", "r", "c", F.col(value).isNotNull().alias("_on"), F.col(anchor).isNotNull().alias("_anchor"))
    kept = touching(labelled(flags, "_on", "_region"), "_anchor", "_region").select("scene", "r", "c", F.lit(True).alias("_kept"))
    return cells.join(kept, ["scene", "r", "c"], "left").withColumn(out, F.when(F.col("_kept"), F.col(value))).drop("_kept")


def isolated_counts(cells: DataFrame, value: str, anchor: str) -> DataFrame:
    """Regions and cells before and after the isolated filter, by scene."""
    flags = cells.select("scene", "r", "c", F.col(value).isNotNull().alias("_on"), F.col(anchor).isNotNull().alias("_anchor"))
    by_region = labelled(flags, "_on").groupBy("scene", "region").agg(F.count(F.lit(1)).alias("n"), F.bool_or("_anchor").alias("kept"))
    return by_region.groupBy("scene").agg(
        F.count(F.lit(1)).alias("regions_before"), F.count_if("kept").alias("regions_after"),
        F.sum("n").alias("cells_before"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("cells_after"),
    )


def small_groups(cells: DataFrame, flag: str, most: int, out: str = "small", *, required: bool = True) -> DataFrame:
    """Adds `out`: whether the cell is in a region of at most `most` cells. required: raises if all regions of a scene are."""
    regions = durable(labelled(cells.select("scene", "r", "c", flag), flag, "_region"))
    few = sizes(regions, "_region").filter(F.col("cells") <= most)
    large = regions.join(few, ["scene", "_region"], "left_anti").select("scene").distinct()
    if required and not regions.select("scene").distinct().join(large, "scene", "left_anti").isEmpty():
        raise ValueError(f"all groups of a scene have at most {most} cells")
    marks = regions.join(few, ["scene", "_region"], "left_semi").select("scene", "r", "c", F.lit(True).alias(out))
    return cells.join(marks, ["scene", "r", "c"], "left").withColumn(out, F.coalesce(out, F.lit(False)))
