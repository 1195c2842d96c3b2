"""Order-dependent operations on long streams without one task for a whole stream.

A stream is cut into chunks by position; each chunk gets the rows it needs of
its neighbours, so windows partition by chunk.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def with_halo(df: DataFrame, before: int, after: int = 0, pos: str = "n", chunk: int = CHUNK) -> DataFrame:
    """Each row under every chunk whose span, widened by the halo, holds it; own marks the chunk that it belongs to.

    The halo may not be wider than a chunk. pos is a dense position.
    """
    c = F.floor(F.col(pos) / chunk).cast("long")
    first = F.floor((F.col(pos) - after) / chunk).cast("long")
    last = F.floor((F.col(pos) + before) / chunk).cast("long")
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("own", F.col("chunk") == c)


def lagged(df: DataFrame, columns: dict[str, Column], pos: str = "n", chunk: int = CHUNK) -> DataFrame:
    """Adds columns of the row before; null for a stream's first row."""
    w = Window.partitionBy("chunk").orderBy(pos)
    out = with_halo(df, 1, 0, pos, chunk)
    for name, col in columns.items():
        out = out.withColumn(name, F.lag(col).over(w))
    return out.where("own").drop("chunk", "own")


def runs(df: DataFrame, key: str, pos: str, value: Column, least: int, chunk: int = CHUNK) -> DataFrame:
    """Runs of equal values of at least so many rows in each stream: key, start, length, value.

    Runs are cut at chunks and put together again: what a chunk begins with
    belongs to the last run that began before it, which one row a chunk tells. So
    no task has a stream. Nulls equal each other.
    """
    w = Window.partitionBy(key, "chunk").orderBy(pos)
    x = with_halo(df.select(key, pos, value.alias("v")), 1, 0, pos, chunk)
    x = x.withColumn("new", F.lag(F.lit(True)).over(w).isNull() | ~F.lag("v").over(w).eqNullSafe(F.col("v"))).where("own")
    began = F.when(F.col("new"), F.col(pos))
    parts = x.withColumn("start", F.last(began, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = parts.groupBy(key, "chunk", "start").agg(F.count("*").alias("length"), F.first("v").alias("value"))
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = parts.groupBy(key, "chunk").agg(F.max("start").alias("last")).withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    whole = parts.join(edges, [key, "chunk"]).withColumn("start", F.coalesce("start", "carried"))
    return whole.groupBy(key, "start").agg(F.sum("length").alias("length"), F.first("value").alias("value")).where(F.col("length") >= least)


def running(df: DataFrame, key: str, pos: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the sum of a value over the stream up to and with this row: sums in chunks, and one row a chunk that tells what came before."""
    x = df.withColumn("__chunk", F.floor(F.col(pos) / chunk)).withColumn("__one", value)
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(key, "__chunk").agg(F.sum("__one").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    own = Window.partitionBy(key, "__chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("__here", F.sum("__one").over(own)).join(sums, [key, "__chunk"])
    return x.withColumn(name, F.col("__here") + F.col("__before")).drop("__chunk", "__one", "__here", "__before")


def counted(df: DataFrame, key: str, pos: str, flag: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds how many rows of the stream up to and with this one have the flag."""
    return running(df, key, pos, F.when(flag, 1).otherwise(0).cast("long"), name, chunk)
