"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Spark's setting to delete a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Separators of words in the wide sense: ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: lineage ends here and no later step computes it twice."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the shuffle files go when the table is written, not when the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As materialise(), dealt into buckets by a key without a shuffle, so that joins on the key leave this table where it is."""
    spark, path, own = df.sparkSession, new_path(df.sparkSession, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(own)
    out = spark.table(own)
    out._written_at, out._named = path, own
    return out


def forget(df: DataFrame) -> None:
    """Deletes what materialise() wrote for a table that no later plan reads."""
    spark = df.sparkSession
    if hasattr(df, "_named"):
        spark.sql(f"drop table {df._named}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """Evaluates value once, whatever the optimizer does with the projection it stands in."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
