"""Tables computed once and kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without that setting gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` checkpointed there: what is made from it is not made from its sources again, whichever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
