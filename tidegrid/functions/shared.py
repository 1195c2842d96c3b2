"""Tables between the rounds of an iterative job, written where driver and executors both see them."""

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_path(spark, name: str) -> str:
    """A new place below spark.checkpoint.dir; in local mode without that setting, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidegrid-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The table written to spark.checkpoint.dir and read again, which ends its lineage; in local mode without that setting, to a temporary folder."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
