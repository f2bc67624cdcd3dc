"""The folder that driver and executors share, and tables written to it once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without one
    gets a temporary folder, a cluster must have it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="depthbook-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends here.

    The parquet files survive a lost executor, are read as often as needed and never
    recomputed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
