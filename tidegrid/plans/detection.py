"""Registered queries of spectra and detection, each with SQL that another engine can run where it can."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detection, intervals, spectrum
from .catalogue import PSD, QUERIES, grid, query, r, real, table

# Grids


def stream_grid(spark, d, nfft: int = 64):
    """The events as one stream and its grid; None if it is too short for one."""
    x = real(spark, d)
    return x, spectrum.plan_grid((x.agg(F.max("n")).first()[0] or -1) + 1, nfft)


def planned(spark, d, nfft: int = 64):
    x, plan = stream_grid(spark, d, nfft)
    return spectrum.spectrogram(x, nfft, plan.hop, plan.row_of), plan


_PLAN = "w as (select max(event_id) + 1 as samples from events), pl as (select (samples - 64) // 32 + 1 as frames, greatest(1, ((samples - 64) // 32 + 1) // greatest(8, cast(ceil(((samples - 64) // 32 + 1) / 65536.0) as bigint))) as rows from w)"
_GRID = PSD.rsplit(",\ng as", 1)[0] + ", g as (select ((frame + 1) * rows - 1) // frames as row, bin, avg(power) as power, avg(power) filter (frame % 2 = 0) as even, avg(power) filter (frame % 2 = 1) as odd, count(*) as k, count(*) filter (frame % 2 = 0) as k_even from p, pl group by 1, 2)"


@query(f"with {_PLAN}, x as (select unnest(range(rows)) as row, frames, rows from pl) select row, row * frames // rows as first_frame, (row * frames // rows) * 32 as start, ((row + 1) * frames // rows - 1) * 32 + 64 as stop from x")
def row_spans(spark, d):
    """The frames and samples of each row of the grid."""
    _, plan = stream_grid(spark, d)
    row = F.col("row")
    start, stop = plan.span(row, row)
    return spark.range(plan.rows).select(F.col("id").alias("row")).select("row", plan.first_frame(row).alias("first_frame"), start.alias("start"), stop.alias("stop"))


@query("with f as (select unnest([256, 1024, 4096]) as nfft), s as (select user_id as samples_key, count(*) * 4096 as samples from events group by 1), x as (select samples_key, nfft, case when samples >= nfft then (samples - nfft) // (nfft // 2) + 1 else 0 end as frames from s, f) select samples_key as user_id, nfft::bigint as nfft, frames, greatest(1, frames // greatest(8, cast(ceil(frames / greatest(1, 4194304 // nfft)) as bigint))) as rows from x where frames >= 8")
def grid_plan(spark, d):
    """How streams of different lengths would be laid out for three transform sizes."""
    s = table(spark, d, "events").groupBy("user_id").agg((F.count("*") * 4096).alias("samples")).withColumn("nfft", F.explode(F.array(*(F.lit(n).cast("long") for n in (256, 1024, 4096)))))
    frames = F.when(F.col("samples") >= F.col("nfft"), F.floor((F.col("samples") - F.col("nfft")) / (F.col("nfft") / 2)) + 1).otherwise(0).cast("long")
    most = F.greatest(F.lit(1), F.floor(spectrum.MAX_CELLS / F.col("nfft")))
    per_row = F.greatest(F.lit(spectrum.MIN_AVERAGE), F.ceil(F.col("frames") / most))
    return s.withColumn("frames", frames).where(F.col("frames") >= spectrum.MIN_AVERAGE).select("user_id", "nfft", "frames", F.greatest(F.lit(1), F.floor(F.col("frames") / per_row)).cast("long").alias("rows"))


@query(f"with {_PLAN}, {_GRID} select row, any_value(k) as k, any_value(k_even) as even, any_value(k - k_even) as odd, round(any_value(k) / 1.0556, 6) + 0.0 as dof from g group by row")
def dof_table(spark, d):
    """Independent frames of each row: all, allowing for overlap, and those of each parity."""
    g, _ = planned(spark, d)
    return g.where("bin = 0").select("row", "k", F.col("k_even").alias("even"), (F.col("k") - F.col("k_even")).alias("odd"), r(F.col("k") / spectrum.OVERLAP_VARIANCE).alias("dof"))


def _rank_sql(padded: str) -> str:
    return f"with {_PLAN}, {_GRID}, m as (select bin, median(power) as m from g group by bin), a as ({padded}), ww as (select p, list_sort(list(m) over (order by p rows between 2 preceding and 2 following))[2] as local from a) select p as bin, round(local, 3) + 0.0 as local from ww where p between 0 and 32"


def ranked(spark, d, mode: str):
    g, _ = planned(spark, d)
    m = g.groupBy("bin").agg(F.median("power").alias("m"))
    return detection.running_rank(m, "bin", "m", 20, 5, mode, 33).select("bin", r(F.col("local"), 3).alias("local"))


@query(_rank_sql("select bin as p, m from m union all select bin + 33, m from m where bin < 2 union all select bin - 33, m from m where bin >= 31"))
def noise_floor_wrap(spark, d):
    return ranked(spark, d, "wrap")


@query(_rank_sql("select bin as p, m from m union all select -1 - bin, m from m where bin < 2 union all select 65 - bin, m from m where bin >= 31"))
def noise_floor_reflect(spark, d):
    return ranked(spark, d, "reflect")


_BYTE = "cast(least(255, greatest(0, round_even((10 * log10(power) - 20) / 40 * 255, 0))) as int)"


@query(f"with {PSD} select row, bin, {_BYTE} as byte from g")
def tile_level0(spark, d):
    return grid(spark, d).select("row", "bin", spectrum.levels(F.col("power"), 20, 60).alias("byte"))


_PYRAMID = f"n as (select max(row) + 1 as rows from g), q as (select row, bin, {_BYTE} as byte, unnest(range(cast(ceil(log2(rows)) as bigint) + 1)) as level from g, n), t as (select level, row >> level as row, bin, max(byte) as byte from q group by 1, 2, 3)"


def tile_pyramid_of(spark, d):
    g = grid(spark, d)
    rows = (g.agg(F.max("row")).first()[0] or 0) + 1
    return spectrum.pyramid(g, 20, 60, rows)


@query(f"with {PSD}, {_PYRAMID} select level::int as level, row, bin, byte from t")
def tile_pyramid(spark, d):
    return tile_pyramid_of(spark, d).select("level", F.col("row").cast("long").alias("row"), "bin", "byte")


@query(f"with {PSD}, {_PYRAMID}, st as (select level, row // 4 as tile_row, bin // 16 as tile_col, count(*) as cells, sum(byte)::bigint as total from t group by 1, 2, 3), wt as (select a.l as level, b.r as tile_row, c.c as tile_col from range(3) a(l), range(4) b(r), range(4) c(c)) select wt.level::int as level, wt.tile_row, wt.tile_col, coalesce(cells, 0) as cells, coalesce(total, 0) as total from wt left join st using (level, tile_row, tile_col)")
def tile_lookup(spark, d):
    """Tiles by level and place; those past the edge are empty."""
    at = F.col("id")
    wanted = spark.range(48).select(F.floor(at / 16).cast("int").alias("level"), (F.floor(at / 4) % 4).alias("tile_row"), (at % 4).alias("tile_col"))
    return spectrum.tile_at(tile_pyramid_of(spark, d), wanted, 4, 16)


@query("with p as (select unnest(range(9)) as point) select point::int as point, round(sum(value * cos(2 * pi() * (0.1 + point * 0.0025) * event_id)), 2) + 0.0 as re, round(-sum(value * sin(2 * pi() * (0.1 + point * 0.0025) * event_id)), 2) + 0.0 as im from events, p group by point")
def zoom_dtft(spark, d):
    z = spectrum.zoom(real(spark, d), 0.1, 0.12, 9)
    return z.select("point", r(F.col("re"), 2).alias("re"), r(F.col("im"), 2).alias("im"))


# Detection


def detect(spark, d):
    """The boxes that stand out of the noise of the events stream: the flagship query."""
    g, plan = planned(spark, d)
    return detection.boxes(g, plan, real=True).select("component", "start", "stop", "low", "high", r(F.col("snr_db"), 3).alias("snr_db"), r(F.col("score"), 3).alias("score"), "cells", r(F.col("dof"), 3).alias("dof"))


QUERIES["detect"] = detect


@query(f"with {_PLAN}, {_GRID}, m as (select bin, median(even) as level from g group by bin), h as (select row, bin, odd / level as odd, row // 2 as part from g join m using (bin) where even > 1.5 * level) select part, count(*) as cells, round(avg(odd), 4) + 0.0 as odd_ratio from h group by 1")
def split_sample_mean(spark, d):
    """Cells chosen on even frames and the mean of their odd frames, which the choice does not bias."""
    g, _ = planned(spark, d)
    level = F.median("even").over(Window.partitionBy("bin"))
    h = g.withColumn("level", level).where(F.col("even") > 1.5 * F.col("level"))
    return h.groupBy(F.floor(F.col("row") / 2).alias("part")).agg(F.count("*").alias("cells"), r(F.avg(F.col("odd") / F.col("level")), 4).alias("odd_ratio"))


_MARKED = "c as (select distinct user_id % 64 as row, cast(floor(value / 16) as bigint) as bin from events where value < 120)"


@query(f"with {_MARKED}, o as (select unnest([-1, 0, 1]) as d), s as (select distinct row + a.d as row, bin + b.d as bin from c, o a, o b), t as (select row + a.d as row, bin + b.d as bin from s, o a, o b) select row, bin from t group by 1, 2 having count(*) = 9")
def closing(spark, d):
    e = table(spark, d, "events").where("value < 120")
    return detection.closed(e.select((F.col("user_id") % 64).alias("row"), F.floor(F.col("value") / 16).alias("bin")).distinct())


@query(f"with recursive {_MARKED}, v as (select row, bin, row * 32 + bin as id from c), e as (select x.id as a, y.id as b from v x join v y on abs(x.row - y.row) <= 1 and abs(x.bin - y.bin) <= 1), reach(id, other) as (select id, id from v union select reach.id, e.b from reach join e on reach.other = e.a) select row, bin, component from v join (select id, min(other) as component from reach group by 1) using (id)")
def connected_components(spark, d):
    """Marked cells of a grid, joined to their eight neighbours."""
    e = table(spark, d, "events").where("value < 120")
    return detection.labelled(e.select((F.col("user_id") % 64).alias("row"), F.floor(F.col("value") / 16).alias("bin")).distinct(), 32)


# Rules between boxes

_BOX = "b as (select event_id as id, user_id, floor(epoch(ts))::bigint as start, floor(epoch(ts))::bigint + 1800 + event_id % 7 * 900 as stop, value as low, value + 4 + event_id % 5 * 8 as high, value / 12 as snr from events)"


def signal_boxes(spark, d):
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), "user_id", t.alias("start"), (t + 1800 + e % 7 * 900).alias("stop"), F.col("value").alias("low"), (F.col("value") + 4 + e % 5 * 8).alias("high"), (F.col("value") / 12).alias("snr"))


_MEET = "x.user_id = y.user_id and greatest(x.start, y.start) < least(x.stop, y.stop)"
_FIELDS = ("low", "high", "snr")


def met(spark, d, both_ways: bool = False):
    m = intervals.overlap_pairs(signal_boxes(spark, d), "user_id", 7200, _FIELDS)
    if not both_ways:
        return m
    turned = m.select("user_id", *(F.col(c + ("_b" if s == "_a" else "_a")).alias(c + s) for s in ("_a", "_b") for c in ("id", "start", "stop", *_FIELDS)))
    return m.select(*turned.columns).unionByName(turned)


@query(f"with {_BOX} select x.user_id, x.id as id_a, y.id as id_b, round((least(x.stop, y.stop) - greatest(x.start, y.start)) * (least(x.high, y.high) - greatest(x.low, y.low)) / least((x.stop - x.start) * (x.high - x.low), (y.stop - y.start) * (y.high - y.low)), 6) + 0.0 as share from b x join b y on {_MEET} and x.id < y.id and greatest(x.low, y.low) < least(x.high, y.high)")
def io_min_pairs(spark, d):
    """Boxes that overlap in time and frequency: the common area against the smaller box."""
    m = met(spark, d).where(F.greatest("low_a", "low_b") < F.least("high_a", "high_b"))
    share = detection.over_smaller(lambda c: F.col(c + "_a"), lambda c: F.col(c + "_b"))
    return m.select("user_id", "id_a", "id_b", r(share).alias("share"))


def nms_merge(spark, d):
    """Of boxes that overlap, the strongest of each user."""
    return detection.strongest(signal_boxes(spark, d), "user_id", "snr")


QUERIES["nms_merge"] = nms_merge


@query(f"with {_BOX} select id, user_id from b x where not exists (select 1 from b y where {_MEET} and y.id <> x.id and y.snr - x.snr >= 15 and least(x.stop, y.stop) - greatest(x.start, y.start) > 0.8 * (x.stop - x.start) and greatest(x.low - y.high, y.low - x.high) <= 8 * (y.high - y.low))")
def sidelobe_anti(spark, d):
    """Boxes without a much stronger one beside them at the same time."""
    m = met(spark, d, both_ways=True)
    long = F.least("stop_a", "stop_b") - F.greatest("start_a", "start_b") > 0.8 * (F.col("stop_a") - F.col("start_a"))
    beside = F.greatest(F.col("low_a") - F.col("high_b"), F.col("low_b") - F.col("high_a")) <= 8 * (F.col("high_b") - F.col("low_b"))
    lobes = m.where((F.col("snr_b") - F.col("snr_a") >= 15) & long & beside).select(F.col("id_a").alias("id")).distinct()
    return signal_boxes(spark, d).join(lobes, "id", "left_anti").select("id", "user_id")


@query(f"with {_BOX}, c as (select *, (low + high) / 2 - 250 as centre, high - low as width from b) select x.id, x.user_id, min(y.id) as image_of from c x join c y on {_MEET} and x.id <> y.id and y.snr - x.snr >= 5 and abs(x.centre + y.centre) < greatest(x.width, y.width) / 2 and x.width / y.width > 0.5 and x.width / y.width < 2 and least(x.stop, y.stop) - greatest(x.start, y.start) > 0.7 * (x.stop - x.start) and abs(y.centre) > y.width / 2 group by 1, 2")
def image_self_join(spark, d):
    """Weak boxes mirrored about the middle of the band by a stronger one at the same time."""
    m = met(spark, d, both_ways=True)
    for s in ("_a", "_b"):
        m = m.withColumn("centre" + s, (F.col("low" + s) + F.col("high" + s)) / 2 - 250).withColumn("width" + s, F.col("high" + s) - F.col("low" + s))
    like = (F.col("width_a") / F.col("width_b") > 0.5) & (F.col("width_a") / F.col("width_b") < 2)
    long = F.least("stop_a", "stop_b") - F.greatest("start_a", "start_b") > 0.7 * (F.col("stop_a") - F.col("start_a"))
    mirrored = (F.abs(F.col("centre_a") + F.col("centre_b")) < F.greatest("width_a", "width_b") / 2) & (F.abs("centre_b") > F.col("width_b") / 2)
    return m.where((F.col("snr_b") - F.col("snr_a") >= 5) & like & long & mirrored).groupBy(F.col("id_a").alias("id"), "user_id").agg(F.min("id_b").alias("image_of"))


_GROUPS = "t as (select user_id, event_id // 1000 as part, value as centre, value / 20 as snr from events)"


@query(f"with {_GROUPS}, g as (select *, lead(centre) over (partition by user_id, part order by centre) - centre as gap from t), m as (select user_id, part, count(*) as tones, median(gap) as gap, max(snr) - min(snr) as spread from g group by 1, 2), j as (select g.user_id, g.part, m.tones, m.spread, m.gap, bool_and(coalesce(abs(g.gap - m.gap) <= 1.5 * m.gap, true)) as near from g join m using (user_id, part) group by all) select user_id, part, tones, coalesce(tones in (4, 8) and spread <= 20 and gap > 0 and near, false) as even from j")
def even_spacing(spark, d):
    """Groups of four or eight boxes at even distances and of like power."""
    t = table(spark, d, "events").select(F.struct("user_id", F.floor(F.col("event_id") / 1000).alias("part")).alias("key"), F.col("value").alias("centre"), (F.col("value") / 20).alias("snr"))
    return detection.evenly_spaced(t, "key", "centre", "snr", tolerance=1.5, spread=20.0).select("key.user_id", "key.part", "tones", "even")


@query(f"with {_BOX} select user_id, id // 1000 as comb, min(start) as start, max(stop) as stop, round(min(low), 6) + 0.0 as low, round(max(high), 6) + 0.0 as high, count(*) as tones, round(max(snr), 6) + 0.0 as snr from b group by 1, 2")
def comb_hull(spark, d):
    """A group of boxes replaced by the box around them."""
    return signal_boxes(spark, d).groupBy("user_id", F.floor(F.col("id") / 1000).alias("comb")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), r(F.min("low")).alias("low"), r(F.max("high")).alias("high"), F.count("*").alias("tones"), r(F.max("snr")).alias("snr"))


_CELLS = f"{_PLAN}, {_GRID}, fl as (select bin, median(power) as level from g group by bin), cells as (select row, bin, power / level as ratio, k from g join fl using (bin)), x as (select unnest(range(12)) as box), bx as (select box, box as first_row, box + 3 + box % 4 as last_row, 1 + box * 2 as low_bin, 4 + box * 2 as high_bin from x)"


def cells_and_boxes(spark, d):
    g, _ = planned(spark, d)
    cells = g.withColumn("level", F.median("power").over(Window.partitionBy("bin"))).select("row", "bin", (F.col("power") / F.col("level")).alias("ratio"), "k")
    b = F.col("id")
    bx = spark.range(12).select(b.alias("box"), b.alias("first_row"), (b + 3 + b % 4).alias("last_row"), (1 + b * 2).alias("low_bin"), (4 + b * 2).alias("high_bin"))
    # A box takes the cells of its rows and bins: each box names them, so the join is one on equality.
    at = bx.withColumn("row", F.explode(F.sequence("first_row", "last_row"))).withColumn("bin", F.explode(F.sequence("low_bin", "high_bin")))
    return cells.join(F.broadcast(at), ["row", "bin"])


@query(f"with {_CELLS} select box, count(*) as cells, round(avg(ratio), 4) + 0.0 as ratio, round(sum(k) / 1.0556, 4) + 0.0 as dof from bx join cells on row between first_row and last_row and bin between low_bin and high_bin group by 1")
def band_ratio_join(spark, d):
    """Mean power over the floor in a band and time span, and its independent frames."""
    return cells_and_boxes(spark, d).groupBy("box").agg(F.count("*").alias("cells"), r(F.avg("ratio"), 4).alias("ratio"), r(F.sum("k") / spectrum.OVERLAP_VARIANCE, 4).alias("dof"))


@query(f"with {_CELLS}, band as (select box, row, avg(ratio) as p from bx join cells on row between first_row and last_row and bin between low_bin and high_bin group by 1, 2), u as (select box, quantile_cont(p, 0.9) as upper from band group by 1) select box, min(row) as first_row, max(row) as last_row from band join u using (box) where p > 0.9 and p > upper * 0.1 group by 1")
def refine_edges(spark, d):
    """The first and last rows of a box whose band is above the noise and near the band's upper level."""
    band = cells_and_boxes(spark, d).groupBy("box", "row").agg(F.avg("ratio").alias("p"))
    upper = F.percentile("p", F.lit(0.9)).over(Window.partitionBy("box"))
    return band.withColumn("upper", upper).where((F.col("p") > 0.9) & (F.col("p") > F.col("upper") * 0.1)).groupBy("box").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))
