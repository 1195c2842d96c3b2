"""Line dedup by distinct-site spread.

For each line hash a HyperLogLog sketch of the sites merges by aggregation.
Lines whose estimate is clearly above or below the threshold are decided by it;
those near the threshold get an exact distinct count. Lines on too many sites
are boilerplate and are removed from all texts. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

LG_K = 12
#: Estimates within this share of the threshold, and one site at least, are counted exactly: five standard errors at LG_K.
BAND = 5 * 1.04 / 2 ** (LG_K / 2)


def line_keys(text: Column) -> Column:
    """The hash of each line's normal form, in order; null for blank lines. One pass of the pattern for the whole text."""
    normal = F.regexp_replace(ascii_lower(text), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(normal, "\n"), lambda x: F.when(~x.isin("", " "), F.xxhash64(F.trim(x))))


def facts(documents: DataFrame, site: str = "source") -> DataFrame:
    """md5, site, keys: one row per row with a text."""
    text = F.col("text")
    return documents.where(text.isNotNull()).select(F.md5(text.cast("binary")).alias("md5"), F.col(site).alias("site"), line_keys(text).alias("keys"))


def boilerplate(known: DataFrame, sites: int = 10) -> DataFrame:
    """line: the hashes of lines on at least so many distinct sites, from facts(). Null sites don't count.

    Tasks sketch the lines that they hold; the sketches of a line merge by
    aggregation, so a common line is one row a task when it is shuffled.
    """
    lines = known.where(F.col("site").isNotNull()).select("site", F.explode(F.array_distinct(F.array_compact("keys"))).alias("line"))
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
    often = materialise(spread.where(F.col("estimate") >= min(sites * (1 - BAND), sites - 1)), "line-spread")
    clear = F.col("estimate") > max(sites * (1 + BAND), sites + 1)
    near = often.where(~clear).select("line")
    exact = lines.join(near, "line").distinct().groupBy("line").count().where(F.col("count") >= sites).select("line")
    return often.where(clear).select("line").unionByName(exact)


def remove(documents: DataFrame, sites: int = 10, site: str = "source") -> DataFrame:
    """The documents with n_lines, n_removed and the text without boilerplate lines.

    Null texts stay null and have no lines; blank lines are kept and not
    counted. Repeated rows stay repeated. An empty table gives an empty result.
    Columns n_lines and n_removed of the input are replaced; other extra
    columns are kept.
    """
    known = materialise(facts(documents, site), "line-facts")
    gone = materialise(boilerplate(known, sites), "boilerplate").select("line", F.lit(True).alias("gone"))
    lines = known.dropDuplicates(["md5"]).select("md5", F.posexplode_outer("keys").alias("at", "line"))
    marks = lines.join(gone, "line", "left").groupBy(F.col("md5").alias("__md5")).agg(F.count("line").alias("__lines"), F.collect_list(F.when(F.col("gone"), F.col("at"))).alias("__drop"))
    out = documents.withColumn("__md5", F.md5(F.col("text").cast("binary"))).join(materialise(marks, "line-marks"), "__md5", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__drop", i)), "\n")
    out = out.withColumn("n_lines", F.coalesce("__lines", F.lit(0)).cast("long")).withColumn("n_removed", F.greatest(F.size("__drop"), F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col("n_removed") > 0, kept).otherwise(F.col("text"))).drop("__md5", "__drop", "__lines")
