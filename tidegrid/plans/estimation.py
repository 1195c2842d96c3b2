"""Registered queries of estimation and demodulation, each with SQL that another engine can run."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import complexmath as cx
from ..operators import ordered, spectrum
from .catalogue import IQ, PSD, pairs, query, r, real, table

_MEAN = "t as (select bin, avg(power) as power from p where bin > 0 group by bin)"


def mean_spectrum(spark, d):
    """The Welch spectrum without the bin of the mean: one row for each bin."""
    return spectrum.periodograms(real(spark, d), 64, 32).where("bin > 0").groupBy("bin").agg(F.avg("power").alias("power"))


@query(f"with {PSD}, {_MEAN}, nf as (select quantile_cont(power, 0.2) as n0 from t), e as (select power - n0 as x, n0 from t, nf) select round(sum(x) / (n0 * (sum(x) * sum(x) / sum(x * x))), 5) + 0.0 as snr, round(sum(x) * sum(x) / sum(x * x), 4) + 0.0 as width from e group by n0")
def psd_moment_snr(spark, d):
    """Signal power over the noise in the signal's own noise-equivalent width, from a spectrum's moments above a low percentile."""
    e = mean_spectrum(spark, d).withColumn("n0", F.percentile("power", F.lit(0.2)).over(Window.partitionBy())).withColumn("x", F.col("power") - F.col("n0"))
    m = e.groupBy("n0").agg(F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("ss"))
    return m.select(r(F.col("ss") / (F.col("n0") * F.col("s")), 5).alias("snr"), r(F.col("s") ** 2 / F.col("ss"), 4).alias("width"))


@query(f"with {PSD}, {_MEAN}, nf as (select quantile_cont(power, 0.2) as n0 from t), e as (select bin, greatest(power - n0, 0) as x from t, nf), c as (select sum(bin * x) / sum(x) as centre from e), kk as (select bin, x, abs(bin - centre) as far from e, c), ss as (select bin, sum(x) over (order by far, bin rows unbounded preceding) / sum(x) over () as share, row_number() over (order by far, bin) as k from kk), nn as (select min(k) filter (share >= 0.99) as k from ss) select min(bin) as low, max(bin) as high from ss, nn where ss.k <= nn.k")
def occupied_about_centroid(spark, d):
    """The bins nearest to the power centroid that hold 99 % of the power above the floor."""
    everything = Window.partitionBy()  # one row for each bin
    e = mean_spectrum(spark, d).withColumn("x", F.greatest(F.col("power") - F.percentile("power", F.lit(0.2)).over(everything), F.lit(0.0)))
    e = e.withColumn("far", F.abs(F.col("bin") - F.sum(F.col("bin") * F.col("x")).over(everything) / F.sum("x").over(everything)))
    near = everything.orderBy("far", "bin")
    e = e.withColumn("share", F.sum("x").over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("x").over(everything)).withColumn("k", F.row_number().over(near))
    e = e.withColumn("last", F.min(F.when(F.col("share") >= 0.99, F.col("k"))).over(everything))
    return e.where(F.col("k") <= F.col("last")).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))


@query(f"with {PSD}, {_MEAN}, l as (select bin, power, median(power) over (partition by (bin - 1) // 8) / ln(2) as level from t) select bin, round(power / level, 4) + 0.0 as ratio from l where power > 1.05 * level")
def local_level_peaks(spark, d):
    """Lines that stand above the level of their block of bins, which the median over ln 2 gives for noise."""
    level = F.median("power").over(Window.partitionBy(F.floor((F.col("bin") - 1) / 8))) / math.log(2)
    return mean_spectrum(spark, d).withColumn("level", level).where(F.col("power") > 1.05 * F.col("level")).select("bin", r(F.col("power") / F.col("level"), 4).alias("ratio"))


_SHAPE = "case when f <= 16 * (1 - beta) then 1.0 when f <= 16 * (1 + beta) then 0.5 * (1 + cos(pi() / (32 * beta) * (f - 16 * (1 - beta)))) else 0.0 end"


@query(f"with {PSD}, {_MEAN}, m as (select bin, power / max(power) over () as p from t), kk as (select bin::double as f, 10 * log10(greatest(p, 0.001)) as p, beta from m, (select unnest([0.2, 0.25, 0.35, 0.5])::double as beta)), e as (select beta, avg(pow(p - 10 * log10(greatest({_SHAPE}, 0.001)), 2)) as error from kk group by 1) select beta, round(error, 4) + 0.0 as error, error = min(error) over () as chosen from e")
def rolloff_ls(spark, d):
    """How far the spectrum in decibels is from the ideal shape of each roll-off."""
    m = mean_spectrum(spark, d).withColumn("p", F.col("power") / F.max("power").over(Window.partitionBy()))
    k = m.select(F.col("bin").cast("double").alias("f"), (10 * F.log10(F.greatest(F.col("p"), F.lit(0.001)))).alias("p"), F.explode(F.array(*map(F.lit, (0.2, 0.25, 0.35, 0.5)))).alias("beta"))
    f, beta = F.col("f"), F.col("beta")
    shape = F.when(f <= 16 * (1 - beta), 1.0).when(f <= 16 * (1 + beta), 0.5 * (1 + F.cos(math.pi / (32 * beta) * (f - 16 * (1 - beta))))).otherwise(0.0)
    e = k.groupBy("beta").agg(F.avg((F.col("p") - 10 * F.log10(F.greatest(shape, F.lit(0.001)))) ** 2).alias("error"))
    return e.select("beta", r(F.col("error"), 4).alias("error"), (F.col("error") == F.min("error").over(Window.partitionBy())).alias("chosen"))


_STEPS = f"{IQ}, d as (select a.n as n, atan2(b.i * a.q - b.q * a.i, b.i * a.i + b.q * a.q) / (2 * pi()) as step from iq a join iq b on b.n = a.n - 1)"


def steps(spark, d):
    s = ordered.lagged(pairs(spark, d), {"pi": F.col("i"), "pq": F.col("q")}, chunk=4096).where(F.col("pi").isNotNull())
    return s.select("n", cx.cycles(cx.product((F.col("i"), F.col("q")), cx.conjugate((F.col("pi"), F.col("pq"))))).alias("step"))


@query(f"with {_STEPS} select n // 500 as block, count(*) as samples, round(stddev_pop(step), 5) + 0.0 as spread, round(kurtosis_pop(step), 3) + 0.0 as kurtosis from d group by 1 having count(*) > 3")
def freq_kurtosis(spark, d):
    """How peaked the steps of phase are: flat for tones, 0 for noise."""
    g = steps(spark, d).groupBy(F.floor(F.col("n") / 500).alias("block")).agg(F.count("*").alias("samples"), F.stddev_pop("step").alias("s"), F.kurtosis("step").alias("k")).where("samples > 3")
    return g.select("block", "samples", r(F.col("s"), 5).alias("spread"), r(F.col("k"), 3).alias("kurtosis"))


@query(f"with {_STEPS}, e as (select n // 500 as block, stddev_pop(sqrt(i * i + q * q)) / avg(sqrt(i * i + q * q)) as cv from iq group by 1), f as (select n // 500 as block, stddev_pop(step) as fs, kurtosis_pop(step) as k from d group by 1 having count(*) > 3) select block, round(cv, 5) + 0.0 as cv, round(fs, 5) + 0.0 as fs, case when cv > 0.4 and fs < 0.2 then 'AM' when cv <= 0.4 and fs >= 0.2 and k > -1.3 then 'FM' else 'none' end as kind from e join f using (block)")
def analog_kind(spark, d):
    """Amplitude or frequency modulation: an envelope that moves while the frequency stands, or the reverse; both or neither is none."""
    block = F.floor(F.col("n") / 500).alias("block")
    env = F.sqrt(cx.power(F.col("i"), F.col("q")))
    e = pairs(spark, d).groupBy(block).agg((F.stddev_pop(env) / F.avg(env)).alias("cv"))
    f = steps(spark, d).groupBy(block).agg(F.stddev_pop("step").alias("fs"), F.kurtosis("step").alias("k"), F.count("*").alias("c")).where("c > 3")
    kind = F.when((F.col("cv") > 0.4) & (F.col("fs") < 0.2), "AM").when((F.col("cv") <= 0.4) & (F.col("fs") >= 0.2) & (F.col("k") > -1.3), "FM").otherwise("none")
    return e.join(f, "block").select("block", r(F.col("cv"), 5).alias("cv"), r(F.col("fs"), 5).alias("fs"), kind.alias("kind"))


@query("with x as (select user_id, [avg(value), median(value), max(value) / 2] as v from events group by 1) select user_id, round(list_median(v), 5) + 0.0 as value, round(1 / (1 + list_max(v) - list_min(v)), 6) + 0.0 as confidence from x")
def esn0_consensus(spark, d):
    """Three estimates of one thing: the middle one, and a confidence that falls with their spread."""
    x = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.array(F.avg("value"), F.median("value"), F.max("value") / 2)).alias("v"))
    return x.select("user_id", r(F.get("v", F.lit(1)), 5).alias("value"), r(1 / (1 + F.get("v", F.lit(2)) - F.get("v", F.lit(0)))).alias("confidence"))


_RATES = "(45.45), (50.0), (75.0), (100.0), (300.0), (512.0), (600.0), (1187.5), (1200.0), (2400.0), (4800.0), (9600.0), (18000.0), (19200.0), (72000.0), (270833.3333333333)"


@query(f"with k(known) as (values {_RATES}), c as (select event_id, value * 40 as rate, value * 40 * 0.002 as sigma from events), b as (select event_id, rate, known::double as known from c join k on abs(rate - known) <= greatest(3 * sigma, 0.001 * known)) select event_id, count(*) as matches, min(known) as known from b group by 1")
def rate_band_join(spark, d):
    """Measured rates within three standard errors of a rate that is in use: a join by log-sized bins, each rate in the bins its band touches."""
    known = [float(x.strip(" ()")) for x in _RATES.split("),")]
    width = math.log(1.02)
    k = spark.createDataFrame([(x,) for x in known], "known double")
    c = table(spark, d, "events").select("event_id", (F.col("value") * 40).alias("rate")).withColumn("far", F.col("rate") * 0.006)
    bin_of = lambda x: F.floor(F.log(F.greatest(x, F.lit(1e-9))) / width)
    c = c.withColumn("bin", F.explode(F.sequence(bin_of(F.col("rate") - 1.02 * F.col("far")), bin_of(F.col("rate") + 1.02 * F.col("far")))))
    b = c.join(F.broadcast(k.withColumn("bin", bin_of(F.col("known")))), "bin").where(F.abs(F.col("rate") - F.col("known")) <= F.greatest(F.col("far"), 0.001 * F.col("known")))
    return b.groupBy("event_id").agg(F.count("*").alias("matches"), F.min("known").alias("known"))


@query("with s as (select user_id, count(*) as n from events group by 1), b as (select user_id, n, 1.0 / n as width from s) select user_id, cast(greatest(1, floor(n / 6.0)) as bigint) as decimation, round(width, 8) + 0.0 as width from b")
def decimation_factor(spark, d):
    """How far a band of a given width (cycles a sample) may be decimated: 1 / (4 * 1.5 * width), at least 1."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.greatest(F.lit(1), F.floor(F.col("n") / 6)).cast("long").alias("decimation"), r(1 / F.col("n"), 8).alias("width"))


_Z = f"{IQ}, z as (select n, i - 0.5 as i, q - 0.5 as q from iq)"


def centred(spark, d):
    return pairs(spark, d).select("n", (F.col("i") - 0.5).alias("i"), (F.col("q") - 0.5).alias("q"))


@query(f"with {_Z} select n, deg::int as deg, round(case deg when 0 then i when 90 then -q when 180 then -i else q end, 6) + 0.0 as i, round(case deg when 0 then q when 90 then i when 180 then -q else -i end, 6) + 0.0 as q from z, (select unnest([0, 90, 180, 270]) as deg)")
def rotate_grid(spark, d):
    """Each symbol under the four rotations that a square grid can't tell apart."""
    z = centred(spark, d).withColumn("deg", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))))
    i, q, deg = F.col("i"), F.col("q"), F.col("deg")
    return z.select("n", "deg", r(F.when(deg == 0, i).when(deg == 90, -q).when(deg == 180, -i).otherwise(q)).alias("i"), r(F.when(deg == 0, q).when(deg == 90, i).when(deg == 180, -q).otherwise(-i)).alias("q"))


#: The fourth-order cumulants (|C40|, -C42) of unit-power symbols.
CUMULANTS = (("BPSK", 2.0, 2.0), ("QPSK", 1.0, 1.0), ("8PSK", 0.0, 1.0), ("16QAM", 0.68, 0.68), ("64QAM", 0.619, 0.619))
_THEORY = ", ".join(f"('{m}', {a}, {b})" for m, a, b in CUMULANTS)


@query(f"with {_Z}, m as (select avg(i * i - q * q) as a, avg(2 * i * q) as b, avg(i * i + q * q) as p, avg(pow(i * i + q * q, 2)) as pp, avg(pow(i * i - q * q, 2) - pow(2 * i * q, 2)) as re, avg(2 * (i * i - q * q) * 2 * i * q) as im from z), c as (select sqrt(pow((re - 3 * (a * a - b * b)) / (p * p), 2) + pow((im - 6 * a * b) / (p * p), 2)) as c40, -(pp - a * a - b * b - 2 * p * p) / (p * p) as c42 from m), t(modulation, t40, t42) as (values {_THEORY}), s as (select modulation, 1 / (1 + sqrt(pow(c40 - t40, 2) + pow(c42 - t42, 2))) as s from c, t) select modulation, round(s / sum(s) over (), 6) + 0.0 as score, rank() over (order by s desc)::int as rank from s")
def rank_by_cumulants(spark, d):
    """Modulations by the distance of measured fourth-order cumulants from theirs."""
    i, q = F.col("i"), F.col("q")
    x, y, p = i * i - q * q, 2 * i * q, cx.power(i, q)
    m = centred(spark, d).agg(F.avg(x).alias("a"), F.avg(y).alias("b"), F.avg(p).alias("p"), F.avg(p * p).alias("pp"), F.avg(x * x - y * y).alias("re"), F.avg(2 * x * y).alias("im"))
    a, b, pw = F.col("a"), F.col("b"), F.col("p") ** 2
    c40 = F.sqrt(((F.col("re") - 3 * (a * a - b * b)) / pw) ** 2 + ((F.col("im") - 6 * a * b) / pw) ** 2)
    c42 = -(F.col("pp") - a * a - b * b - 2 * pw) / pw
    theory = F.array(*(F.struct(F.lit(n).alias("modulation"), (1 / (1 + F.sqrt((c40 - u) ** 2 + (c42 - v) ** 2))).alias("s")) for n, u, v in CUMULANTS))
    s = m.select(F.explode(theory).alias("x")).select("x.*")
    return s.select("modulation", r(F.col("s") / F.sum("s").over(Window.partitionBy())).alias("score"), F.rank().over(Window.orderBy(F.desc("s"))).alias("rank"))


_E = "e as (select vec_id, unnest(range(len(embedding) // 4)) as symbol, embedding as v from embeddings), t as (select vec_id, symbol, abs(v[4 * symbol + 1])::double as e0, abs(v[4 * symbol + 2])::double as e1, abs(v[4 * symbol + 3])::double as e2, abs(v[4 * symbol + 4])::double as e3 from e)"


def tones(spark, d):
    """Four energies to a symbol."""
    e = table(spark, d, "embeddings").where(F.size("embedding") >= 4).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1)).alias("symbol"))
    return e.select("vec_id", F.col("symbol").cast("long").alias("symbol"), *(F.abs(F.get("embedding", F.col("symbol") * 4 + k)).cast("double").alias(f"e{k}") for k in range(4)))


@query(f"with {_E} select vec_id, symbol, round(greatest(e0, e1) - greatest(e2, e3), 6) + 0.0 as llr0, round(greatest(e0, e3) - greatest(e1, e2), 6) + 0.0 as llr1 from t")
def tone_energy_llr(spark, d):
    """Soft bits of tones with Gray labels: the best energy of a 0 less the best of a 1."""
    label = [p ^ (p >> 1) for p in range(4)]
    best = lambda j, bit: F.greatest(*(F.col(f"e{p}") for p in range(4) if label[p] >> (1 - j) & 1 == bit))
    return tones(spark, d).select("vec_id", "symbol", *(r(best(j, 0) - best(j, 1)).alias(f"llr{j}") for j in (0, 1)))


@query(f"with {_E} select vec_id, symbol, round(-(greatest(e0, e1) - greatest(e2, e3)), 6) + 0.0 as llr0, round(greatest(e0, e3) - greatest(e1, e2), 6) + 0.0 as llr1 from t")
def mirror_bit(spark, d):
    """A mirrored spectrum turns the order of the tones, which is the first bit of each label."""
    return tone_energy_llr(spark, d).withColumn("llr0", r(-F.col("llr0")))


@query("with f as (select event_id % 8 as place, avg(value) as p from events group by 1), a as (select list(p order by place) as p, arg_max(place, (p, -place))::int as k from f), n as (select k, p[(k + 7) % 8 + 1] as l, p[k + 1] as m, p[(k + 1) % 8 + 1] as r from a) select k, round(k + case when l - 2 * m + r < 0 then 0.5 * (l - r) / (l - 2 * m + r) else 0 end, 6) + 0.0 as peak from n")
def fold_profile(spark, d):
    """A stream folded on a period: the peak of its profile, between places by a parabola."""
    f = table(spark, d, "events").groupBy((F.col("event_id") % 8).alias("place")).agg(F.avg("value").alias("p"))
    a = f.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "p"))), lambda x: x["p"]).alias("p"), (-F.max(F.struct("p", (-F.col("place")).alias("k")))["k"]).cast("int").alias("k"))
    at = lambda d: F.get("p", (F.col("k") + d) % 8)
    left, mid, right = at(7), at(0), at(1)
    bend = left - 2 * mid + right
    return a.select("k", r(F.col("k") + F.when(bend < 0, 0.5 * (left - right) / bend).otherwise(0.0)).alias("peak"))


_TIMING = f"{IQ}, w as (select n // 256 as block, sum((i * i + q * q) * cos(2 * pi() * n / 4)) as re, -sum((i * i + q * q) * sin(2 * pi() * n / 4)) as im, count(*) as c from iq group by 1), b as (select block, -atan2(im, re) / (2 * pi()) as tau from w where c = 256)"


@query(f"with {_TIMING} select block, round(tau, 6) + 0.0 as tau from b")
def timing_block_phase(spark, d):
    """The symbol instant of each block, in symbols, from the line at the symbol rate in the power."""
    turn = 2 * math.pi * F.col("n") / 4
    p = cx.power(F.col("i"), F.col("q"))
    w = pairs(spark, d).groupBy(F.floor(F.col("n") / 256).alias("block")).agg(F.sum(p * F.cos(turn)).alias("re"), (-F.sum(p * F.sin(turn))).alias("im"), F.count("*").alias("c")).where("c = 256")
    return w.select("block", r(-F.atan2("im", "re") / (2 * math.pi)).alias("tau"))


@query(f"with {_TIMING}, u as (select block, tau, tau - lag(tau) over (order by block) as step from b), v as (select block, tau - sum(case when abs(step) > 0.5 then round(step) else 0 end) over (order by block rows unbounded preceding) as tau from u) select case when count(*) > 1 then round(regr_slope(tau, block), 6) + 0.0 end as drift, case when count(*) > 1 then round(regr_intercept(tau, block), 6) + 0.0 end as start, count(*) as blocks from v")
def timing_trend(spark, d):
    """The drift of the symbol instants: block phases unwrapped in chunks, and a straight line through them."""
    u = ordered.lagged(timing_block_phase(spark, d), {"before": F.col("tau")}, "block").withColumn("step", F.col("tau") - F.col("before")).withColumn("one", F.lit(0))
    turns = F.when(F.abs("step") > 0.5, F.round("step")).otherwise(0.0)
    v = ordered.running(u, "one", "block", turns, "turns").withColumn("tau", F.col("tau") - F.col("turns"))
    return v.agg(r(F.regr_slope("tau", "block")).alias("drift"), r(F.regr_intercept("tau", "block")).alias("start"), F.count("*").alias("blocks"))


@query(f"with {_Z}, f as (select n // 128 as block, pow(i * i - q * q, 2) - pow(2 * i * q, 2) as re, 2 * (i * i - q * q) * 2 * i * q as im from z) select block, round(atan2(-sum(im), -sum(re)) / 4, 6) + 0.0 as phase, round(sqrt(pow(sum(re), 2) + pow(sum(im), 2)) / count(*), 8) + 0.0 as strength from f group by 1")
def carrier_track(spark, d):
    """The carrier's phase of each block, up to a quarter turn, from the fourth power of its symbols."""
    i, q = F.col("i"), F.col("q")
    x, y = i * i - q * q, 2 * i * q
    f = centred(spark, d).groupBy(F.floor(F.col("n") / 128).alias("block")).agg(F.sum(x * x - y * y).alias("re"), F.sum(2 * x * y).alias("im"), F.count("*").alias("c"))
    return f.select("block", r(F.atan2(-F.col("im"), -F.col("re")) / 4).alias("phase"), r(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.col("c"), 8).alias("strength"))


_SINC = "case when abs(u) < 1e-12 then 1.0 else sin(pi() * u) / (pi() * u) end * (0.5 + 0.5 * cos(pi() * u / 8))"


@query(f"with t as (select k, (20 + k * 0.37)::double as pos from range(400) r(k)), n as (select k, pos, unnest(range(cast(floor(pos) as bigint) - 7, cast(floor(pos) as bigint) + 9)) as n from t), w as (select k, pos, n, pos - n as u from n where abs(pos - n) < 8), s as (select k, any_value(pos) as pos, sum(e.value * ({_SINC})) as x from w join events e on e.event_id = w.n group by 1) select k, round(pos, 6) + 0.0 as pos, round(x, 4) + 0.0 as x from s")
def sinc_interp(spark, d):
    """The stream between its samples: a windowed sinc over sixteen of them, met by an equality join on their numbers."""
    at = 20 + F.col("k") * 0.37
    t = spark.range(400).select(F.col("id").alias("k")).withColumn("at", at.cast("double"))
    w = t.withColumn("n", F.explode(F.sequence(F.floor("at") - 7, F.floor("at") + 8))).withColumn("u", F.col("at") - F.col("n")).where(F.abs("u") < 8)
    u = F.col("u")
    kernel = F.when(F.abs(u) < 1e-12, 1.0).otherwise(F.sin(math.pi * u) / (math.pi * u)) * (0.5 + 0.5 * F.cos(math.pi * u / 8))
    s = w.join(real(spark, d), "n").groupBy("k").agg(F.first("at").alias("at"), F.sum(F.col("x") * kernel).alias("x"))
    return s.select("k", r(F.col("at")).alias("pos"), r(F.col("x"), 4).alias("x"))


_DOWN = "with w as (select event_id as n, value * cos(2 * pi() * 0.1 * event_id) as re, -value * sin(2 * pi() * 0.1 * event_id) as im from events), h as (select j, 0.5 - 0.5 * cos(2 * pi() * (j + 0.5) / 16) as h from range(16) r(j)), k as (select w.n + 15 - j as m, re * h as re, im * h as im from w, h) select m // 4 as k, round(sum(re) / 8, 5) + 0.0 as re, round(sum(im) / 8, 5) + 0.0 as im from k where m % 4 = 0 group by 1 having count(*) = 16"


@query(_DOWN)
def down_convert(spark, d):
    """A band mixed to 0 Hz, filtered and decimated: each output adds sixteen weighted samples, and a sample goes only to the outputs that use it."""
    turn = 2 * math.pi * 0.1 * F.col("n")
    x = real(spark, d).select("n", (F.col("x") * F.cos(turn)).alias("re"), (-F.col("x") * F.sin(turn)).alias("im"))
    m = F.explode(F.sequence(F.ceil(F.col("n") / 4), F.floor((F.col("n") + 15) / 4)))
    k = x.withColumn("k", m).withColumn("h", 0.5 - 0.5 * F.cos(2 * math.pi * (F.col("n") + 15 - 4 * F.col("k") + 0.5) / 16))
    s = k.groupBy("k").agg(F.sum(F.col("re") * F.col("h")).alias("re"), F.sum(F.col("im") * F.col("h")).alias("im"), F.count("*").alias("c")).where("c = 16")
    return s.select("k", r(F.col("re") / 8, 5).alias("re"), r(F.col("im") / 8, 5).alias("im"))


@query("select event_id, round(value / 1000 * 2e6, 3) + 0.0 as hertz, round(value / 1000 * 2e6 / 8, 3) + 0.0 as baud from events")
def unit_conversion(spark, d):
    """Cycles and symbols a sample as Hz and Bd, at a known rate and decimation."""
    return table(spark, d, "events").select("event_id", r(F.col("value") / 1000 * 2e6, 3).alias("hertz"), r(F.col("value") / 1000 * 2e6 / 8, 3).alias("baud"))
