"""Registered queries over the test tables, each with SQL that another engine can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import complexmath as cx
from ..operators import bits, evidence, intervals, ordered, spectrum

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def real(spark: SparkSession, d: str) -> DataFrame:
    """The events as one real stream (n, x)."""
    return table(spark, d, "events").select(F.col("event_id").alias("n"), F.col("value").alias("x"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """The events as one complex stream (n, i, q): even values are i, odd ones q, at a full scale of 512."""
    x = real(spark, d).groupBy(F.floor(F.col("n") / 2).alias("n")).agg(F.max(F.when(F.col("n") % 2 == 0, F.col("x"))).alias("i"), F.max(F.when(F.col("n") % 2 == 1, F.col("x"))).alias("q"))
    return x.where(F.col("i").isNotNull() & F.col("q").isNotNull()).select("n", (F.col("i") / 512).alias("i"), (F.col("q") / 512).alias("q"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """One stream for each user (rec_id, n, x)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("rec_id"), (F.row_number().over(w) - 1).alias("n"), F.col("value").alias("x"))


IQ = "iq as (select a.event_id // 2 as n, a.value / 512 as i, b.value / 512 as q from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 2 = 0)"
USERS = "u as (select user_id as rec_id, row_number() over (partition by user_id order by ts, event_id) - 1 as n, value as x from events)"


def r(col, digits: int = 6):
    return F.round(col, digits) + F.lit(0.0)


# Samples and quality


@query(f"with {IQ} select n, i, q from iq")
def decode_iq_scale(spark, d):
    return pairs(spark, d)


@query(f"with {IQ} select n, q as i, i as q from iq")
def swap_iq(spark, d):
    return pairs(spark, d).select("n", F.col("q").alias("i"), F.col("i").alias("q"))


@query("select event_id // 1024 as chunk, min(event_id) as start, count(*) as length from events group by 1")
def chunk_ranges(spark, d):
    return real(spark, d).groupBy(F.floor(F.col("n") / 1024).alias("chunk")).agg(F.min("n").alias("start"), F.count("*").alias("length"))


@query(f"with {IQ} select round(20 * log10(sqrt(avg(i) * avg(i) + avg(q) * avg(q)) / sqrt(avg(i * i + q * q))), 6) + 0.0 as dc_db from iq")
def dc_offset(spark, d):
    m = pairs(spark, d).agg(F.avg("i").alias("i"), F.avg("q").alias("q"), F.avg(cx.power(F.col("i"), F.col("q"))).alias("p"))
    return m.select(r(20 * F.log10(F.sqrt(cx.power(F.col("i"), F.col("q"))) / F.sqrt("p"))).alias("dc_db"))


@query(f"with {IQ}, b as (select n // 512 as block, 10 * log10(sum(i * i) / sum(q * q)) as gain, sum(i * q) / sqrt(sum(i * i) * sum(q * q)) as rho from iq group by 1) select round(avg(gain), 6) + 0.0 as gain_db, round(stddev_samp(gain) / sqrt(count(*)), 6) + 0.0 as gain_error, round(avg(rho), 6) + 0.0 as rho from b")
def iq_imbalance_blocks(spark, d):
    i, q = F.col("i"), F.col("q")
    b = pairs(spark, d).groupBy(F.floor(F.col("n") / 512).alias("block")).agg((10 * F.log10(F.sum(i * i) / F.sum(q * q))).alias("gain"), (F.sum(i * q) / F.sqrt(F.sum(i * i) * F.sum(q * q))).alias("rho"))
    return b.agg(r(F.avg("gain")).alias("gain_db"), r(F.stddev_samp("gain") / F.sqrt(F.count("*"))).alias("gain_error"), r(F.avg("rho")).alias("rho"))


@query("with l as (select abs(value) as level, count(*) as n from events group by 1 order by 1 desc limit 2), s as (select max(level) as peak, arg_max(n, level) as peak_count, arg_min(n, level) as next_count, count(*) as levels from l) select round(peak, 6) + 0.0 as peak, peak_count, next_count, levels = 2 and peak_count >= 8 and peak_count >= 4 * next_count as clipped from s")
def clipping_plateau(spark, d):
    top = real(spark, d).groupBy(F.abs("x").alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).limit(2)
    s = top.agg(F.max("level").alias("peak"), F.max_by("n", "level").alias("peak_count"), F.min_by("n", "level").alias("next_count"), F.count("*").alias("levels"))
    return s.select(r(F.col("peak")).alias("peak"), "peak_count", "next_count", ((F.col("levels") == 2) & (F.col("peak_count") >= 8) & (F.col("peak_count") >= 4 * F.col("next_count"))).alias("clipped"))


@query(f"with {USERS}, m as (select rec_id, n, floor(x / 100) as v, case when floor(x / 100) is not distinct from lag(floor(x / 100)) over w then 0 else 1 end as new from u window w as (partition by rec_id order by n)), g as (select *, sum(new) over (partition by rec_id order by n rows unbounded preceding) as run from m) select rec_id, min(n) as start, count(*) as length, cast(any_value(v) as bigint) as value from g group by rec_id, run having count(*) >= 3")
def repeat_runs(spark, d):
    return ordered.runs(users(spark, d), "rec_id", "n", F.floor(F.col("x") / 100), 3).select("rec_id", F.col("start").cast("long").alias("start"), "length", "value")


@query("select count(*) filter (isnan(value) or isinf(value)) as nonfinite, count(*) as samples from events")
def nonfinite_count(spark, d):
    bad = F.isnan("x") | (F.abs("x") == F.lit(float("inf")))
    return real(spark, d).agg(F.count_if(bad).alias("nonfinite"), F.count("*").alias("samples"))


@query("with t as (select max(event_id) + 1 as total from events) select event_id * 16 // total as piece, count(*) as samples, round(avg(value), 6) + 0.0 as mean from events, t where event_id - ((event_id * 16 // total) * total + 15) // 16 < 64 group by 1")
def piece_sampling(spark, d):
    s = real(spark, d)
    total = s.agg((F.max("n") + 1).alias("total"))
    p = s.join(F.broadcast(total)).withColumn("piece", F.floor(F.col("n") * 16 / F.col("total")).cast("long"))
    start = F.floor((F.col("piece") * F.col("total") + 15) / 16)
    return p.where(F.col("n") - start < 64).groupBy("piece").agg(F.count("*").alias("samples"), r(F.avg("x")).alias("mean"))


@query("with c as (select event_type, count(*) as n from events group by 1) select round(-sum(n / t * log2(n / t)), 6) + 0.0 as bits from c, (select count(*) as t from events)")
def entropy_values(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row for each type
    return c.select((p * F.log2(p)).alias("h")).agg(r(-F.sum("h")).alias("bits"))


@query("select event_id % 2 as parity, round(avg(value), 6) + 0.0 as mean, round(var_pop(value), 4) + 0.0 as variance, round(kurtosis_pop(value), 4) + 0.0 as kurtosis from events group by 1")
def even_odd_moments(spark, d):
    return real(spark, d).groupBy((F.col("n") % 2).alias("parity")).agg(r(F.avg("x")).alias("mean"), r(F.var_pop("x"), 4).alias("variance"), r(F.kurtosis("x"), 4).alias("kurtosis"))


@query("with k as (select o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as step from orders) select o_custkey, count(*) as files, count(*) filter (step > 1) as gaps, cast(coalesce(sum(step - 1) filter (step > 1), 0) as bigint) as missing from k group by 1")
def sequence_gaps(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = table(spark, d, "orders").withColumn("step", F.col("o_orderkey") - F.lag("o_orderkey").over(w))
    return k.groupBy("o_custkey").agg(F.count("*").alias("files"), F.count_if(F.col("step") > 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0)).cast("long").alias("missing"))


# Spectra and detection

PSD = """
s as (select event_id as n, value as x from events),
f as (select n, x, unnest(range(greatest(0, cast(floor((n - 64) / 32.0) as bigint) + 1), n // 32 + 1)) as frame from s),
k as (select frame, n - frame * 32 as k, x from f),
b as (select k, bin, (0.5 - 0.5 * cos(2 * pi() * k / 64)) as w, bin * k / 64.0 as turn from range(64) t(k), range(33) u(bin)),
p as (select frame, bin, (pow(sum(x * w * cos(2 * pi() * turn)), 2) + pow(sum(x * w * sin(2 * pi() * turn)), 2)) / 24 as power from k join b using (k) group by 1, 2 having count(*) = 64),
g as (select frame // 16 as row, bin, avg(power) as power, avg(power) filter (frame % 2 = 0) as even, avg(power) filter (frame % 2 = 1) as odd, count(*) as k from p group by 1, 2)
"""


def grid(spark, d):
    return spectrum.spectrogram(real(spark, d), 64, 32, 16)


@query(f"with {PSD}, n as (select bin, median(even) as level from g group by bin) select g.row, g.bin, round(even / level, 3) + 0.0 as ratio, round(odd / level, 3) + 0.0 as odd_ratio from g join n using (bin) where even / level > 2.5")
def psd_floor_detect(spark, d):
    level = F.median("even").over(Window.partitionBy("bin"))
    g = grid(spark, d).withColumn("level", level)
    ratio = F.col("even") / F.col("level")
    return g.where(ratio > 2.5).select("row", "bin", r(ratio, 3).alias("ratio"), r(F.col("odd") / F.col("level"), 3).alias("odd_ratio"))


@query(f"with {PSD} select bin, round(avg(power), 3) + 0.0 as power, count(*) as frames from p group by bin")
def welch_psd(spark, d):
    return spectrum.periodograms(real(spark, d), 64, 32).groupBy("bin").agg(r(F.avg("power"), 3).alias("power"), F.count("*").alias("frames"))


@query(f"with {PSD} select row, bin, round(power, 3) + 0.0 as power, round(even, 3) + 0.0 as even, round(odd, 3) + 0.0 as odd, k from g")
def spectrogram_even_odd(spark, d):
    return grid(spark, d).select("row", "bin", *(r(F.col(c), 3).alias(c) for c in ("power", "even", "odd")), "k")


@query(f"with {PSD} select bin, round(sum(power * k) / sum(k), 3) + 0.0 as power, cast(sum(k) as bigint) as k from g group by bin")
def integrate_rows(spark, d):
    return spectrum.integrate(grid(spark, d)).select("bin", r(F.col("power"), 3).alias("power"), "k")


@query(f"with {PSD} select bin, round(median(power), 3) + 0.0 as level from g group by bin")
def noise_floor_median(spark, d):
    return spectrum.noise_floor(grid(spark, d)).select("bin", r(F.col("level"), 3).alias("level"))


@query(f"with {PSD} select row // 4 as row, bin, cast(max(least(255, greatest(0, round_even((10 * log10(power) - 20) / 40 * 255, 0)))) as int) as byte from g group by 1, 2")
def tile_maxpool(spark, d):
    return spectrum.tiles(grid(spark, d), 20, 60, 2)


@query("select lag, round(avg(a.value * b.value), 3) + 0.0 as r, count(*) as pairs from events a, (select unnest([0, 1, 2, 3, 5, 8, 13, 21]) as lag) l join events b on b.event_id = a.event_id + lag group by lag")
def autocorr_lags(spark, d):
    return spectrum.autocorrelation(real(spark, d), [0, 1, 2, 3, 5, 8, 13, 21]).select("lag", r(F.col("r"), 3).alias("r"), "pairs")


BOXES = "b as (select event_id as id, user_id, floor(epoch(ts))::bigint as start, floor(epoch(ts))::bigint + 1800 as stop, value as low, value + 10 as high from events)"


def boxes(spark, d):
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", t.alias("start"), (t + 1800).alias("stop"))


@query(f"with {BOXES} select x.user_id, x.id as id_a, y.id as id_b, least(x.stop, y.stop) - greatest(x.start, y.start) as seconds from b x join b y on x.user_id = y.user_id and x.id < y.id and greatest(x.start, y.start) < least(x.stop, y.stop)")
def overlap_len(spark, d):
    m = intervals.overlap_pairs(boxes(spark, d), "user_id", 7200)
    return m.select("user_id", "id_a", "id_b", intervals.overlap(F.col("start_a"), F.col("stop_a"), F.col("start_b"), F.col("stop_b")).alias("seconds"))


@query(f"with {BOXES}, m as (select *, max(stop) over (partition by user_id order by start, stop rows between unbounded preceding and 1 preceding) as reach from b) select user_id, cast(sum(greatest(0, stop - greatest(start, coalesce(reach, start)))) as bigint) as covered from m group by 1")
def interval_union_share(spark, d):
    return intervals.union_length(boxes(spark, d), "user_id")


# Estimation


@query(f"with {IQ}, m as (select avg(i * i + q * q) as m2, avg((i * i + q * q) * (i * i + q * q)) as m4 from iq) select round(m2, 6) + 0.0 as m2, round(m4, 6) + 0.0 as m4, round(case when 2 * m2 * m2 > m4 then sqrt(2 * m2 * m2 - m4) end, 6) + 0.0 as signal from m")
def m2m4_snr(spark, d):
    p = cx.power(F.col("i"), F.col("q"))
    m = pairs(spark, d).agg(F.avg(p).alias("m2"), F.avg(p * p).alias("m4"))
    s = 2 * F.col("m2") ** 2 - F.col("m4")
    return m.select(r(F.col("m2")).alias("m2"), r(F.col("m4")).alias("m4"), r(F.when(s > 0, F.sqrt(s))).alias("signal"))


@query(f"with {IQ} select round(avg(i * i - q * q), 6) + 0.0 as c20_re, round(avg(2 * i * q), 6) + 0.0 as c20_im, round(avg(i * i + q * q), 6) + 0.0 as c21, round(avg((i * i + q * q) * (i * i + q * q)) - pow(avg(i * i - q * q), 2) - pow(avg(2 * i * q), 2) - 2 * pow(avg(i * i + q * q), 2), 6) + 0.0 as c42 from iq")
def cumulants(spark, d):
    i, q = F.col("i"), F.col("q")
    p = cx.power(i, q)
    m = pairs(spark, d).agg(F.avg(i * i - q * q).alias("a"), F.avg(2 * i * q).alias("b"), F.avg(p).alias("p"), F.avg(p * p).alias("pp"))
    c42 = F.col("pp") - F.col("a") ** 2 - F.col("b") ** 2 - 2 * F.col("p") ** 2
    return m.select(r(F.col("a")).alias("c20_re"), r(F.col("b")).alias("c20_im"), r(F.col("p")).alias("c21"), r(c42).alias("c42"))


@query(f"with {IQ} select a.n as n, round(atan2(b.i * a.q - b.q * a.i, b.i * a.i + b.q * a.q) / (2 * pi()), 6) + 0.0 as step from iq a join iq b on b.n = a.n - 1")
def discriminator_steps(spark, d):
    s = ordered.lagged(pairs(spark, d), {"pi": F.col("i"), "pq": F.col("q")}, chunk=4096).where(F.col("pi").isNotNull())
    z = cx.product((F.col("i"), F.col("q")), cx.conjugate((F.col("pi"), F.col("pq"))))
    return s.select("n", r(cx.cycles(z)).alias("step"))


@query(f"with {IQ} select round(stddev_pop(sqrt(i * i + q * q)) / avg(sqrt(i * i + q * q)), 6) + 0.0 as cv, round(kurtosis_pop(sqrt(i * i + q * q)), 4) + 0.0 as kurtosis from iq")
def envelope_cv(spark, d):
    e = F.sqrt(cx.power(F.col("i"), F.col("q")))
    return pairs(spark, d).agg(r(F.stddev_pop(e) / F.avg(e)).alias("cv"), r(F.kurtosis(e), 4).alias("kurtosis"))


@query(f"with {PSD}, t as (select bin, avg(power) as power from p where bin > 0 group by bin), c as (select bin, sum(power) over (order by bin) / sum(power) over () as share from t) select min(bin) filter (share > 0.005) as low, min(bin) filter (share >= 0.995) as high from c")
def occupied_bw(spark, d):
    t = spectrum.periodograms(real(spark, d), 64, 32).where("bin > 0").groupBy("bin").agg(F.avg("power").alias("power"))
    everything = Window.partitionBy()  # one row for each bin
    c = t.withColumn("share", F.sum("power").over(everything.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("power").over(everything))
    return c.agg(F.min(F.when(F.col("share") > 0.005, F.col("bin"))).alias("low"), F.min(F.when(F.col("share") >= 0.995, F.col("bin"))).alias("high"))


# Symbols and bits


@query(f"with {IQ}, z as (select n, i - 0.5 as i, q - 0.5 as q from iq), k as (select n, p, (i - c) * (i - c) + (q - s) * (q - s) as dist from z, (values (0, 0.7, 0.7), (1, -0.7, 0.7), (2, 0.7, -0.7), (3, -0.7, -0.7)) t(p, c, s)) select n, round(min(dist) filter (p % 2 = 1) - min(dist) filter (p % 2 = 0), 12) + 0.0 as llr0, round(min(dist) filter (p >= 2) - min(dist) filter (p < 2), 12) + 0.0 as llr1 from k group by n")
def nearest_point_llr(spark, d):
    points = [(0, 0.7, 0.7), (1, -0.7, 0.7), (2, 0.7, -0.7), (3, -0.7, -0.7)]
    i, q = F.col("i") - 0.5, F.col("q") - 0.5
    dist = {p: cx.power(i - c, q - s) for p, c, s in points}
    best = lambda keep: F.least(*(v for p, v in dist.items() if keep(p)))
    return pairs(spark, d).select("n", r(best(lambda p: p % 2 == 1) - best(lambda p: p % 2 == 0), 12).alias("llr0"), r(best(lambda p: p >= 2) - best(lambda p: p < 2), 12).alias("llr1"))


SIGNS = "v as (select vec_id, list_transform(embedding, lambda x: case when x < 0 then 1 else 0 end) as b from embeddings)"


def signs(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x < 0, 1).otherwise(0)).alias("b"))


def text_of(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), "")


def permutation(name: str, size: int, source, sql: str):
    def run(spark, d):
        return signs(spark, d).select("vec_id", text_of(bits.permuted(F.col("b"), size, source)).alias("bits"))

    QUERIES[name] = run
    ORACLES[name] = f"with {SIGNS} select vec_id, array_to_string([b[(j // {size}) * {size} + ({sql}) + 1] for j in range((len(b) // {size}) * {size})], '') as bits from v"


permutation("deinterleave_block", 32, bits.block(4, 8), "((j % 32) % 8) * 4 + (j % 32) // 8")
permutation("deinterleave_helical", 32, bits.helical(4, 8), "(((j % 32) + (j % 32) // 8) % 8) * 4 + (j % 32) // 8")
permutation("deinterleave_qpp", 40, bits.quadratic(40, 3, 10), "(3 * (j % 40) + 10 * (j % 40) * (j % 40)) % 40")


def lag_query(name: str, lags: tuple[int, ...]):
    def run(spark, d):
        return signs(spark, d).select("vec_id", text_of(bits.xor_lags(F.col("b"), lags)).alias("bits"))

    term = "b[i]"
    for x in lags:
        term = f"xor({term}, case when i > {x} then b[i - {x}] else 0 end)"
    QUERIES[name] = run
    ORACLES[name] = f"with {SIGNS} select vec_id, array_to_string([{term} for i in range(1, len(b) + 1)], '') as bits from v"


lag_query("descramble_selfsync", (12, 17))
lag_query("nrzi", (1,))
lag_query("conv_reencode", (2, 3, 5, 6))


@query("select vec_id, round(sum(greatest(-1.5, least(1.5, x))), 4) + 0.0 as total from (select vec_id, unnest(embedding)::double as x from embeddings) group by 1")
def llr_sanitise(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return x.groupBy("vec_id").agg(r(F.sum(bits.sanitised(F.col("x"), 1.5)), 4).alias("total"))


@query(f"with {SIGNS}, f as (select vec_id, len, p, avg(bit) as share, count(*) as n from (select vec_id, unnest([5, 7, 8]) as len, b from v) s, lateral (select unnest(b) as bit, generate_subscripts(b, 1) - 1 as pos) t, lateral (select pos % len as p) w group by 1, 2, 3), m as (select vec_id, len, sum(share * n) / sum(n) as mean from f group by 1, 2) select vec_id, len, round(case when mean > 0 and mean < 1 then sum(n * pow(share - mean, 2)) / (mean * (1 - mean)) else 0 end, 4) + 0.0 as contrast from f join m using (vec_id, len) group by vec_id, len, mean")
def fold_contrast(spark, d):
    x = signs(spark, d).select("vec_id", F.explode(F.array(F.lit(5), F.lit(7), F.lit(8))).alias("len"), "b").select("vec_id", "len", F.posexplode("b").alias("pos", "bit"))
    f = x.groupBy("vec_id", "len", (F.col("pos") % F.col("len")).alias("p")).agg(F.avg("bit").alias("share"), F.count("*").alias("n"))
    s = f.groupBy("vec_id", "len").agg((F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("share") ** 2).alias("a"), F.sum(F.col("n") * F.col("share")).alias("b"), F.sum("n").alias("n"))
    m = F.col("mean")
    return s.select("vec_id", "len", r(F.when((m > 0) & (m < 1), (F.col("a") - 2 * m * F.col("b") + F.col("n") * m * m) / (m * (1 - m))).otherwise(0.0), 4).alias("contrast"))


@query(f"with {SIGNS}, s as (select vec_id, array_to_string(b, '') as t from v) select vec_id, case when contains(t, '111111') then null else replace(t, '111110', '11111') end as bits from s")
def hdlc_destuff(spark, d):
    return signs(spark, d).select("vec_id", bits.destuffed(text_of(F.col("b"))).alias("bits"))


@query(f"with {SIGNS}, s as (select vec_id, array_to_string(b, '') as t from v) select vec_id, i as pos, bit_count(xor(w, 90))::int as errors from (select vec_id, i, list_sum([(substr(t, i + k + 1, 1)::int) << (7 - k) for k in range(8)])::int as w from (select vec_id, t, unnest(range(len(t) - 7)) as i from s)) where bit_count(xor(w, 90)) <= 1 or bit_count(xor(w, 90)) >= 7")
def sync_hits(spark, d):
    x = signs(spark, d).where(F.size("b") >= 8).select("vec_id", "b", F.explode(F.sequence(F.lit(0), F.size("b") - 8)).alias("pos"))
    word = F.aggregate(F.slice("b", F.col("pos") + 1, 8), F.lit(0), lambda a, b: 2 * a + b)
    e = F.bit_count(word.bitwiseXOR(F.lit(90)))
    return x.select("vec_id", F.col("pos").cast("long").alias("pos"), e.alias("errors")).where((F.col("errors") <= 1) | (F.col("errors") >= 7))


# Evidence


@query("""
with t as (select user_id, event_id, value / 500000 as p, count(*) over (partition by user_id) as m, row_number() over (partition by user_id order by value / 500000, event_id) - 1 as k from events),
a as (select *, 0.01 / (m - k) as raw, p <= 0.01 / (m - k) as ok from t)
select user_id, event_id, round(case when coalesce(bool_and(ok) over (partition by user_id order by k rows between unbounded preceding and 1 preceding), true) then raw else 0 end, 9) + 0.0 as threshold,
       bool_and(ok) over (partition by user_id order by k rows unbounded preceding) as passed from a
""")
def holm_thresholds(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 500000).alias("p"))
    return evidence.holm(t, "user_id", "p", "event_id", 0.01).select("user_id", "event_id", r(F.col("threshold"), 9).alias("threshold"), "passed")


@query("select user_id, event_id, cast(rank as int) as rank from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rank from events) where rank <= 12")
def ledger_topk(spark, d):
    return evidence.top_per(table(spark, d, "events"), "user_id", [F.desc("value"), F.col("event_id")], 12).select("user_id", "event_id", "rank")


@query("select doc_id, sha256(coalesce(text, '')) as sha256, octet_length(encode(coalesce(text, ''))) as size from documents")
def file_identity(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(t.cast("binary"), 256).alias("sha256"), F.octet_length(t).cast("long").alias("size"))


@query("select event_type, cast(user_id % 3 as varchar) as family, grouping_id(event_type, cast(user_id % 3 as varchar)) as level, count(*) as n, round(avg(value), 6) + 0.0 as mean from events group by rollup (event_type, cast(user_id % 3 as varchar))")
def split_rollup(spark, d):
    e = table(spark, d, "events").withColumn("family", (F.col("user_id") % 3).cast("string"))
    return e.rollup("event_type", "family").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


# Queries of further modules join the same tables when they are imported.
from . import blind, channel, coding, detection, estimation, lines, paging, recordings, results, shift_keying  # noqa: E402, F401
