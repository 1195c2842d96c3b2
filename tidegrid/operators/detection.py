"""Detection of signals in a spectrogram: noise floor, seeds and extents, connected cells, a significance test on frames that did not choose them, and rules between boxes."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import special
from ..functions.shared import settled
from .spectrum import OVERLAP_VARIANCE, Grid

#: Chances that a noise cell is a seed or part of an extent, of a false detection in a recording, and the floor's window and ranks.
SEED, EXTENT, ALPHA = 1e-4, 1e-2, 0.01
FLOOR_WINDOW, FLOOR_RANK, GLOBAL_RANK = 8, 20, 30


def running_rank(values: DataFrame, at: str, value: str, rank: float, size: int, mode: str, count: int) -> DataFrame:
    """at, local: the order statistic of a rank (percent) in a window of odd size around each of the positions 0 to count - 1.

    mode tells how the ends go on: wrap, reflect (the end value doubled) or
    nearest. Rows are frequency bins, as many as half a transform, and come
    together in one window.
    """
    half = size // 2
    p = F.col(at)
    copies = [values.select(p.cast("long").alias("p"), value)]
    if mode == "wrap":
        copies += [values.where(p < half).select((p + count).alias("p"), value), values.where(p >= count - half).select((p - count).alias("p"), value)]
    elif mode == "reflect":
        copies += [values.where(p < half).select((-1 - p).alias("p"), value), values.where(p >= count - half).select((2 * count - 1 - p).alias("p"), value)]
    else:
        more = F.explode(F.sequence(F.lit(1), F.lit(half)))
        copies += [values.where(p == 0).select(p, value, more.alias("d")).select((-F.col("d")).cast("long").alias("p"), value), values.where(p == count - 1).select(p, value, more.alias("d")).select((F.col("d") + count - 1).cast("long").alias("p"), value)]
    padded = copies[0]
    for c in copies[1:]:
        padded = padded.unionByName(c)
    w = Window.orderBy("p").rowsBetween(-half, half)
    k = size - 1 if rank >= 100 else int(size * rank / 100)
    local = padded.select("p", F.element_at(F.sort_array(F.collect_list(value).over(w)), k + 1).alias("local"))
    return local.where((F.col("p") >= 0) & (F.col("p") < count)).select(F.col("p").alias(at), "local")


def floor(cells: DataFrame, rows: int, bins: int, dof: float, real: bool) -> DataFrame:
    """bin, level: the noise density of each bin of a grid of cells (row, bin, power); dof: independent frames of a row."""
    factor = special.mean_quantile(0.5, dof)
    spread = 1.2533 / math.sqrt(rows * dof)
    medians = settled(cells.groupBy("bin").agg((F.median("power") / factor).alias("m")))
    size = max(3, bins // FLOOR_WINDOW) | 1
    local = running_rank(medians, "bin", "m", FLOOR_RANK, size, "reflect" if real else "wrap", bins)
    cap = medians.agg((F.percentile("m", F.lit(GLOBAL_RANK / 100)) / (1 - 0.5244 * spread)).alias("cap"))
    return local.join(F.broadcast(cap)).select("bin", F.least(F.col("local") / (1 - 0.8416 * spread), F.col("cap")).alias("level"))


def threshold(dof: Column, kinds: list[int], p: float) -> Column:
    """The ratio to the floor that noise of so many independent frames exceeds with probability p; kinds: the numbers that occur."""
    out = F.lit(float("inf"))
    for k in kinds:
        if k > 0:
            out = F.when(dof == k, special.mean_exceeded(p, k)).otherwise(out)
    return out


def _spread(cells: DataFrame) -> DataFrame:
    """Each cell's place and its eight neighbours'."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return cells.withColumn("o", F.explode(near)).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("bin") + F.col("o.j")).alias("bin"))


def closed(cells: DataFrame) -> DataFrame:
    """Marked cells (row, bin) after a 3 x 3 closing: what stays when the cells are widened by one and narrowed again."""
    return _spread(_spread(cells).distinct()).groupBy("row", "bin").count().where(F.col("count") == 9).select("row", "bin")


def labelled(cells: DataFrame, width: int) -> DataFrame:
    """row, bin, component of marked cells, joined to all eight neighbours: the component's smallest cell, row * width + bin.

    Labels spread to neighbours and are looked up in themselves, so the rounds
    grow with the logarithm of a component's length; only marked cells take part.
    """
    name = (F.col("row") * width + F.col("bin")).cast("long")
    v = settled(cells.select("row", "bin", name.alias("id")))
    near = [width - 1, width, width + 1, 1]
    edge = F.when(F.col("bin") == 0, F.array(*(F.lit(d) for d in near if d != width - 1))).when(F.col("bin") == width - 1, F.array(F.lit(width - 1), F.lit(width))).otherwise(F.array(*map(F.lit, near)))
    half = v.select("id", F.explode(edge).alias("d")).select("id", (F.col("id") + F.col("d")).alias("to")).join(v.select(F.col("id").alias("to")), "to", "left_semi")
    edges = settled(half.unionByName(half.select(F.col("to").alias("id"), F.col("id").alias("to"))))
    label = v.select("id", F.col("id").alias("component"))
    while True:
        least = edges.join(label.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = label.join(least, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = label.select(F.col("id").alias("next"), F.col("component").alias("far"))
        fresh = settled(step.join(jump, "next").select("id", "old", F.least("next", "far").alias("component")))
        label = fresh.drop("old")
        if fresh.where(F.col("old") != F.col("component")).isEmpty():
            return v.join(label, "id").select("row", "bin", "component")


@F.pandas_udf(DoubleType())
def log_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([special.log10_mean_tail(a, b) for a, b in zip(x, dof)])


def boxes(cells: DataFrame, grid: Grid, real: bool, searches: int = 1) -> DataFrame:
    """component, start, stop, low, high, snr_db, score, cells, dof: what stands out of the noise.

    cells is a spectrogram() of the grid. Cells are chosen on the even frames and
    tested on the odd ones, so that the choice does not bias the test; the test
    allows for all cells and searches.
    """
    bins = grid.nfft // 2 + 1 if real else grid.nfft
    c = settled(cells)
    per_row = grid.frames / grid.rows / OVERLAP_VARIANCE
    level = floor(c, grid.rows, bins, per_row, real)
    ratio = lambda x: F.when(F.col("level") > 0, F.col(x) / F.col("level")).otherwise(0.0)
    r = settled(c.join(F.broadcast(level), "bin").select("row", "bin", "k", "k_even", ratio("even").alias("even"), ratio("odd").alias("odd"), ratio("power").alias("power")))
    kinds = [x[0] for x in r.select("k_even").distinct().collect()]  # two neighbouring numbers
    seeds = r.where(F.col("even") > threshold(F.col("k_even"), kinds, SEED)).select("row", "bin")
    extent = r.where(F.col("even") > threshold(F.col("k_even"), kinds, EXTENT)).select("row", "bin")
    inside = (F.col("row") >= 0) & (F.col("row") < grid.rows) & (F.col("bin") >= 0) & (F.col("bin") < bins)
    marked = labelled(closed(extent).where(inside).unionByName(seeds).distinct(), bins)
    seeded = marked.join(seeds, ["row", "bin"], "left_semi").select("component").distinct()
    of = marked.join(seeded, "component", "left_semi").join(r, ["row", "bin"]).groupBy("component").agg(
        F.min("row").alias("first"), F.max("row").alias("last"), F.min("bin").alias("lowest"), F.max("bin").alias("highest"), F.avg("odd").alias("odd"), F.avg("power").alias("power"),
        F.sum(F.col("k") - F.col("k_even")).cast("double").alias("tested"), F.count("*").alias("cells"), (F.sum("k") / OVERLAP_VARIANCE).alias("dof"),
    )
    need = -math.log10(ALPHA / searches / (grid.rows * bins))
    start, stop = grid.span(F.col("first"), F.col("last"))
    edge = lambda b: F.col(b) / grid.nfft - (0.0 if real else 0.5)
    found = of.withColumn("score", -log_tail("odd", "tested")).where(F.col("score") >= need)
    return found.select("component", start.alias("start"), stop.alias("stop"), (edge("lowest") - 0.5 / grid.nfft).alias("low"), (edge("highest") + 0.5 / grid.nfft).alias("high"), (10 * F.log10(F.greatest(F.col("power") - 1, F.lit(1e-6)))).alias("snr_db"), "score", "cells", "dof")


# Rules between boxes (key, id, start, stop, low, high, snr)


def shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def over_smaller(a, b) -> Column:
    """The common area of two boxes against the smaller one; a and b give a column for each of start, stop, low, high."""
    area = lambda x: (x("stop") - x("start")) * (x("high") - x("low"))
    both = shared(a("start"), a("stop"), b("start"), b("stop")) * shared(a("low"), a("high"), b("low"), b("high"))
    small = F.least(area(a), area(b))
    return F.when(small > 0, both / small).otherwise(0.0)


def strongest(found: DataFrame, key: str, score: str, most: float = 0.3) -> DataFrame:
    """key, id: of boxes that overlap by more than a share of the smaller one, the one of the higher score, taken from the highest down.

    One recording's detections are gathered; there are few of them, its samples are not.
    """
    fields = ["start", "stop", "low", "high"]
    row = F.struct((-F.col(score)).alias("order"), F.col("id"), *(F.col(c).cast("double").alias(c) for c in fields))
    kind = "array<struct<order:double,id:bigint,start:double,stop:double,low:double,high:double>>"
    per = found.groupBy(key).agg(F.sort_array(F.collect_list(row)).cast(kind).alias("x"))

    def step(kept, b):
        hit = F.exists(kept, lambda k: over_smaller(lambda c: k[c], lambda c: b[c]) > most)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(b)))

    return per.select(key, F.explode(F.aggregate("x", F.array().cast(kind), step)).alias("k")).select(key, F.col("k.id").alias("id"))


def evenly_spaced(groups: DataFrame, key: str, centre: str, power: str, tolerance: float = 0.3, spread: float = 6.0, orders: tuple[int, ...] = (4, 8)) -> DataFrame:
    """key, tones, even: have a group's boxes the number, the like power and the even distances of a comb of tones?"""
    w = Window.partitionBy(key).orderBy(centre)
    g = groups.withColumn("gap", F.lead(centre).over(w) - F.col(centre))
    m = g.groupBy(key).agg(F.count("*").alias("tones"), F.median("gap").alias("gap"), (F.max(power) - F.min(power)).alias("spread"), F.collect_list("gap").alias("gaps"))
    even = (F.col("gap") > 0) & F.forall("gaps", lambda x: F.abs(x - F.col("gap")) <= tolerance * F.col("gap"))
    return m.select(key, "tones", F.coalesce(F.col("tones").isin(*orders) & (F.col("spread") <= spread) & even, F.lit(False)).alias("even"))
