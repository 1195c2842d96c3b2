"""Overlap joins of intervals and the union of intervals."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_pairs(boxes: DataFrame, key: str, width: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes (id, start, stop) of one key that overlap, found by the bins of a given width that both touch.

    A pair is reported in the first bin that both are in, so once. Keys with
    many boxes are spread over their bins.
    """
    b = boxes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    left = b.select(key, "bin", *(F.col(c).alias(f"{c}_a") for c in ("id", "start", "stop", *extra)))
    right = b.select(key, "bin", *(F.col(c).alias(f"{c}_b") for c in ("id", "start", "stop", *extra)))
    met = left.join(right, [key, "bin"]).where((F.col("id_a") < F.col("id_b")) & (F.greatest("start_a", "start_b") < F.least("stop_a", "stop_b")))
    return met.where(F.col("bin") == F.floor(F.greatest("start_a", "start_b") / width)).drop("bin")


def union_length(intervals: DataFrame, key: str) -> DataFrame:
    """key, covered: the length of the union of each key's intervals (start, stop)."""
    w = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(w), F.col("start"))
    return intervals.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach))).groupBy(key).agg(F.sum("new").alias("covered"))
