"""Registered queries of spectral lines; their SQL transforms by sums over all samples."""

import math

from pyspark.sql import functions as F

from ..operators import lines
from .catalogue import USERS, query, r, users

#: A stream for each user: the values as noise, and a turning tone.
_TONE = "(0.05 + (rec_id % 30) * 0.012)"


def toned(spark, d):
    turn = 2 * math.pi * (0.05 + (F.col("rec_id") % 30) * 0.012) * F.col("n")
    x = F.col("x") / 100
    return users(spark, d).select(F.col("rec_id").alias("rec"), "n", (x + 2 * F.cos(turn)).alias("i"), (0.3 * x + 2 * F.sin(turn)).alias("q"))


_TONED = f"{USERS}, x as (select rec_id as rec, n, value_i as i, value_q as q from (select rec_id, n, x / 100 + 2 * cos(2 * pi() * {_TONE} * n) as value_i, 0.3 * x / 100 + 2 * sin(2 * pi() * {_TONE} * n) as value_q from u))"


def lines_sql(source: str, low: float, high: float, most: int) -> str:
    """CTEs from x (rec, n, i, q), given in source, to found (rec, place, frequency, uncertainty, ratio)."""
    sums = ", ".join(f"sum(i * cos(a{k}) - q * sin(a{k})) as {k}r, sum(i * sin(a{k}) + q * cos(a{k})) as {k}i" for k in "abc")
    turns = ", ".join(f"-2 * pi() * (bin + {s}) / pow(2, m) * n as a{k}" for k, s in (("a", -0.5), ("b", 0.0), ("c", 0.5)))
    return f"""{source},
s as (select rec, count(*) as count, avg(i) as mi, avg(q) as mq, greatest(6, ceil(log2(2.0 * count(*)))::int) as m from x group by 1 having count(*) >= 16),
y as (select rec, n, i - mi as i, q - mq as q, count, m from x join s using (rec)),
bins as (select rec, count, m, unnest(range(-(1 << (m - 1)), 1 << (m - 1))) as bin from s),
t as (select rec, bins.count, bins.m, bin, sum(i * cos(2 * pi() * bin * n / pow(2, bins.m)) + q * sin(2 * pi() * bin * n / pow(2, bins.m))) as re, sum(q * cos(2 * pi() * bin * n / pow(2, bins.m)) - i * sin(2 * pi() * bin * n / pow(2, bins.m))) as im from bins join y using (rec) group by all),
p as (select *, re * re + im * im as power, (bin + (1 << (m - 1))) / 64.0 - 0.5 as place, (1 << m) // 64 - 1 as last from t),
md as (select rec, (bin + (1 << (m - 1))) // 64 as block, median(power) / ln(2) as mid from p group by all),
l as (select p.*, power / greatest(1e-300, a.mid * (1 - (place - floor(place))) + b.mid * (place - floor(place))) as ratio from p join md a on a.rec = p.rec and a.block = greatest(0, least(floor(place), last)) join md b on b.rec = p.rec and b.block = greatest(0, least(floor(place) + 1, last))),
b as (select * from l where bin between ceil({low} * pow(2, m)) and floor({high} * pow(2, m))),
k as (select *, max(ratio) over (partition by rec order by bin range between 4 preceding and 4 following) as top, floor({high} * pow(2, m)) - ceil({low} * pow(2, m)) + 1 as width from b),
pk as (select rec, count, m, bin, ratio, row_number() over (partition by rec order by ratio desc, bin) as place from k where ratio = top and ratio > ln(greatest(1.0, floor(width * count / pow(2, m))) * 100)),
z as (select rec, place, pk.m, pk.count, bin, ratio, {sums} from (select pk.*, n, i, q, {turns} from pk join (select rec, n, i, q from y) w using (rec) where place <= {most}) pk group by all),
g as (select rec, place, m, count, bin, ratio, ln(ar * ar + ai * ai + 1e-300) as a, ln(br * br + bi * bi + 1e-300) as b, ln(cr * cr + ci * ci + 1e-300) as c from z),
found as (select rec, place::int as place, (bin + greatest(-1.0, least(1.0, case when a - 2 * b + c < 0 then 0.25 * (a - c) / (a - 2 * b + c) else 0.0 end))) / pow(2, m) as frequency, sqrt(6.0 / ratio) / (2 * pi() * count) as uncertainty, ratio from g)"""


@query(f"with {lines_sql(_TONED, -0.5, 0.499, 8)} select rec, place, round(frequency, 5) + 0.0 as frequency, round(uncertainty, 6) + 0.0 as uncertainty, round(ratio, 3) + 0.0 as ratio from found")
def line_search(spark, d):
    """All significant lines of each user's stream."""
    out = lines.find(toned(spark, d), -0.5, 0.499)
    return out.select("rec", "place", r(F.col("frequency"), 5).alias("frequency"), r(F.col("uncertainty")).alias("uncertainty"), r(F.col("ratio"), 3).alias("ratio"))


_PULSED = f"{USERS}, x as (select rec, n, i * i + q * q as i, 0.0::double as q from (select rec_id as rec, n, (1 + 0.6 * cos(2 * pi() * n / (4 + rec_id % 5))) * cos(x) as i, (1 + 0.6 * cos(2 * pi() * n / (4 + rec_id % 5))) * sin(x) as q from u))"


@query(f"with {lines_sql(_PULSED, 0.01, 0.5, 1)} select rec, round(frequency, 5) + 0.0 as rate, round(uncertainty, 6) + 0.0 as uncertainty, round(ratio, 3) + 0.0 as ratio from found")
def symbol_rate(spark, d):
    """Streams of pulses with any phase, one in 4 to 8 samples: the line of their power."""
    size = 1 + 0.6 * F.cos(2 * math.pi * F.col("n") / (4 + F.col("rec_id") % 5))
    x = users(spark, d).select(F.col("rec_id").alias("rec"), "n", (size * F.cos("x")).alias("i"), (size * F.sin("x")).alias("q"))
    return lines.symbol_rates(x).select("rec", r(F.col("frequency"), 5).alias("rate"), r(F.col("uncertainty")).alias("uncertainty"), r(F.col("ratio"), 3).alias("ratio"))


_PHASE = "2 * pi() * ((0.01 + (rec_id % 9) * 0.01) * n + (floor(x * 7) % 4) / 4.0) + 0.2 * sin(x)"
_KEYED = f"{USERS}, w as (select rec_id as rec, n, cos({_PHASE}) as i, sin({_PHASE}) as q from u), w2 as (select rec, n, i * i - q * q as i, 2 * i * q as q from w), x as (select rec, n, i * i - q * q as i, 2 * i * q as q from w2)"


@query(f"with {lines_sql(_KEYED, -0.125, 0.125, 1)} select rec, round(frequency / 4, 5) + 0.0 as offset_, round(uncertainty / 4, 6) + 0.0 as uncertainty, round(ratio, 3) + 0.0 as ratio from found")
def carrier_offset(spark, d):
    """Four phases on a carrier that is off: the line of the fourth power."""
    turn = 2 * math.pi * ((0.01 + (F.col("rec_id") % 9) * 0.01) * F.col("n") + F.floor(F.col("x") * 7) % 4 / 4) + 0.2 * F.sin("x")
    x = users(spark, d).select(F.col("rec_id").alias("rec"), "n", F.cos(turn).alias("i"), F.sin(turn).alias("q"))
    return lines.carrier_offsets(x, 4).select("rec", r(F.col("frequency"), 5).alias("offset_"), r(F.col("uncertainty")).alias("uncertainty"), r(F.col("ratio"), 3).alias("ratio"))


_TONES = f"""{USERS}, sym as (select rec_id, n, x, floor(n / (4 + rec_id % 3)) as k from u),
lev as (select rec_id as rec, n, sum(0.15 * (2 * floor(((k * 7 + rec_id * 3 + floor(k / 3) * 5) % 4) / 2) - 1) + 0.003 * sin(x)) over (partition by rec_id order by n) as turns from sym),
w as (select rec, n, cos(2 * pi() * turns) as i, sin(2 * pi() * turns) as q from lev),
sc as (select rec, n, i, q, unnest([1, 2, 4, 8]) as scale from w),
lg as (select a.rec, a.n, a.scale, atan2(a.q * b.i - a.i * b.q, a.i * b.i + a.q * b.q) / (2 * pi() * a.scale) as f from sc a join w b on b.rec = a.rec and b.n = a.n - a.scale),
x as (select a.rec * 10 + a.scale as rec, a.n - 2 * a.scale as n, pow(a.f - b.f, 2) as i, 0.0::double as q from lg a join lg b on b.rec = a.rec and b.scale = a.scale and b.n = a.n - a.scale)"""


@query(f"""with {lines_sql(_TONES, 0.01, 0.5, 24)},
li as (select rec // 10 as rec, rec % 10 as scale, frequency, ratio from found),
hit as (select a.rec, a.scale, a.frequency, a.ratio, k, arg_min(b.ratio, (abs(b.frequency - k * a.frequency), b.ratio)) as more from (select *, unnest([2, 3, 4]) as k from li where frequency * scale * 3 <= 1) a join li b on b.rec = a.rec and b.scale = a.scale and abs(b.frequency - k * a.frequency) <= 0.002 * k * a.frequency group by all),
comb as (select rec, scale, frequency, ratio + sum(more) as strength from hit group by rec, scale, frequency, ratio),
kept as (select * from comb a where not exists (select 1 from comb b where b.rec = a.rec and abs(b.frequency - a.frequency) <= 1e-3 * a.frequency and (b.strength > a.strength or b.strength = a.strength and b.scale < a.scale))),
o as (select *, row_number() over (partition by rec order by strength desc, frequency) as place from kept)
select rec, place::int as place, round(frequency, 4) + 0.0 as rate, round(strength, 2) + 0.0 as strength from o where place <= 3""")
def shift_keying_rates(spark, d):
    """Two tones that change every 4 to 6 samples: rates whose multiples are lines of the edge energy too."""
    from pyspark.sql import Window

    k = F.floor(F.col("n") / (4 + F.col("rec_id") % 3))
    high = F.floor(((k * 7 + F.col("rec_id") * 3 + F.floor(k / 3) * 5) % 4) / 2)
    step = 0.15 * (2 * high - 1) + 0.003 * F.sin("x")
    turns = F.sum(step).over(Window.partitionBy("rec_id").orderBy("n"))
    x = users(spark, d).select(F.col("rec_id").alias("rec"), "n", (2 * math.pi * turns).alias("a"))
    out = lines.shift_keying_rates(x.select("rec", "n", F.cos("a").alias("i"), F.sin("a").alias("q")))
    return out.select("rec", "place", r(F.col("frequency"), 4).alias("rate"), r(F.col("strength"), 2).alias("strength"))
