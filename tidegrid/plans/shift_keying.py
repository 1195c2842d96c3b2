"""Registered queries of frequency-shift keying; their SQL knows what was sent."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import shift_keying
from .catalogue import USERS, query, r, users


@query(f"""
with {USERS}, p as (select rec_id, n, x, [2, 4, 8][rec_id % 2 + 1] as m, floor(x * 131)::bigint % [2, 4, 8][rec_id % 2 + 1] as p from u),
v as (select rec_id, m, p - (m - 1) / 2.0 as pos, 0.3 + 0.7 * (p - (m - 1) / 2.0) + 0.03 * sin(x * 50) as v from p),
f as (select rec_id, m, regr_intercept(v, pos) as centre, regr_slope(v, pos) as spacing from v group by all)
select rec_id, f.m::int as "order", round(centre, 6) + 0.0 as centre, round(spacing, 6) + 0.0 as spacing, round(avg(pow(v - centre - spacing * pos, 2)), 8) + 0.0 as variance from f join v using (rec_id) group by rec_id, f.m, centre, spacing""")
def level_fit(spark, d):
    """Values about two or four equally spaced levels: how many, where, how far from them?"""
    m = F.element_at(F.array(F.lit(2), F.lit(4)), (F.col("rec_id") % 2 + 1).cast("int"))
    p = F.floor(F.col("x") * 131) % m
    v = 0.3 + 0.7 * (p - (m - 1) / 2) + 0.03 * F.sin(F.col("x") * 50)
    rows = users(spark, d).groupBy("rec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", v.alias("v")))), lambda s: s["v"]).alias("v"))
    out = shift_keying.fitted_levels(rows, "rec_id", "v")
    return out.select("rec_id", "order", r(F.col("centre")).alias("centre"), r(F.col("spacing")).alias("spacing"), r(F.col("variance"), 8).alias("variance"))


@query(f"""
with {USERS}, s as (select rec_id, n, floor(x * 131)::bigint % [2, 4][rec_id % 2 + 1] as p, [0, 1, 3, 5, 6][rec_id % 5 + 1] as late from u)
select rec_id, [2, 4][rec_id % 2 + 1]::int as "order", string_agg(p::varchar, '' order by n) filter (n > 0 or late < 2) as symbols from s group by rec_id""")
def fsk_demodulate(spark, d):
    """Two or four tones of eight samples each, begun late: tones and their order."""
    m = F.element_at(F.array(F.lit(2), F.lit(4)), (F.col("rec_id") % 2 + 1).cast("int"))
    late = F.element_at(F.array(*map(F.lit, (0, 1, 3, 5, 6))), (F.col("rec_id") % 5 + 1).cast("int"))
    p = F.floor(F.col("x") * 131) % m
    tone = 0.01 + 0.06 * (p - (m - 1) / 2) + 0.002 * F.sin(F.col("x") * 50)
    s = users(spark, d).select("rec_id", tone.alias("f"), late.alias("late"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), F.col("n"))
    s = s.withColumn("t", 8 * F.col("n") + F.col("k")).withColumn("a", 2 * math.pi * F.sum("f").over(Window.partitionBy("rec_id").orderBy("t"))).where("t >= late")
    b = s.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("t", F.cos("a").alias("i"), F.sin("a").alias("q")))).alias("x"))
    b = b.select("rec_id", F.transform("x", lambda v: v["i"]).alias("i"), F.transform("x", lambda v: v["q"]).alias("q"), F.lit(0.125).alias("rate"))
    out = shift_keying.demodulate(b, "rec_id", "rate")
    return out.select("rec_id", "order", F.array_join(F.transform("symbols", lambda v: v.cast("string")), "").alias("symbols"))
