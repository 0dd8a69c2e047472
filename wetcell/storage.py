"""Tables written between the steps of a job, so that a lost executor costs no more than one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "wetcell-"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary folder serves on
    one machine (tests); on a cluster its executors could not see it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix=PREFIX)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/{PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.durable_path = path
    return back


def superseded(*frames: DataFrame) -> None:
    """Delete what durable() wrote for frames that nothing reads any more, such as the rounds before the last."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
