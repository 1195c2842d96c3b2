"""Registered queries that read what the recording sink wrote from the test tables."""

from pyspark.sql import functions as F

from ..functions.shared import shared_path
from ..sources import recordings
from .catalogue import IQ, pairs, query, r


def taken(spark, d):
    """A folder of recordings of the complex stream, 16 bits a component, in parts of a few thousand samples."""
    recordings.register(spark)
    folder = shared_path(spark, "takes")
    pairs(spark, d).repartitionByRange(4, "n").write.format("recording").option("datatype", "ci16_le").option("rate", "48000").mode("append").save(folder)
    return recordings.described(recordings.listed(spark, folder)), folder


_STORED = "greatest(-32768, least(32767, round_even({0} * 32768, 0))) / 32768"


@query(f"with {IQ}, o as (select row_number() over (order by n) - 1 as n, i, q from iq) select n, {_STORED.format('i')} as i, {_STORED.format('q')} as q from o")
def recording_samples(spark, d):
    """Samples that went through the sink and back, all takes in one job and in one order."""
    found, _ = taken(spark, d)
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    order = recordings.numbered(found.select("path", "name", "samples")).select("path", "first")
    return recordings.samples(found, 700).join(order, "path").select((F.col("first") + F.col("n")).alias("n"), "i", "q")


@query(f"with {IQ} select 'SigMF' as container, 'ci16_le' as datatype, 48000.0::double as rate, count(*) as samples, 4 * count(*) as bytes from iq")
def recording_index(spark, d):
    """What the headers of a folder of recordings say, without their samples."""
    found, _ = taken(spark, d)
    return found.groupBy("container", "datatype", "rate").agg(F.sum("samples").alias("samples"), F.sum(F.col("samples") * 4).alias("bytes"))


@query(f"with {IQ}, o as (select row_number() over (order by n) - 1 as n, i, q from iq) select count(*) as samples, round(avg({_STORED.format('i')}), 6) + 0.0 as mean_i, round(avg({_STORED.format('q')}), 6) + 0.0 as mean_q from o where n >= 100")
def recording_region(spark, d):
    """One region of a raw file, by offset, read as the datatype given: all but the first hundred samples."""
    folder = shared_path(spark, "takes")
    recordings.register(spark)
    pairs(spark, d).coalesce(1).write.format("recording").option("datatype", "ci16_le").mode("append").save(folder)
    x = spark.read.format("recording").option("offset", "400").load(f"{folder}/take_00000.sigmf-meta")
    return x.agg(F.count("*").alias("samples"), r(F.avg("i")).alias("mean_i"), r(F.avg("q")).alias("mean_q"))
