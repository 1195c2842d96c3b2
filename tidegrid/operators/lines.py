"""Spectral lines of streams of any length: symbol rates, carrier offsets, combs.

The transform of a whole stream is two rounds of short transforms: samples that are A apart meet in a
task, then their results of one frequency class meet in another. So a task holds about the square root of
a stream, and streams of all lengths go through one job. Levels are medians of blocks of
bins, peaks are found in chunks of bins, and the few lines that stand out are refined by sums over the samples.
Streams of up to 2**SHORT points do not need that: a kernel has many of them whole, and gives only their lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import settled
from . import ordered

#: Bins of a level block, and bins on either side within which only the strongest stays.
LEVEL, NEAR = 64, 4
#: Streams whose transform has up to 2**SHORT points go whole through a kernel, so many points at once.
SHORT, POINTS = 14, 1 << 19


def sized(samples: DataFrame) -> DataFrame:
    """rec, n, i, q with the mean removed, count (the samples of the stream) and m: the transform has 2**m points, two to four for each sample."""
    s = samples.groupBy("rec").agg(F.count("*").alias("count"), F.avg("i").alias("mi"), F.avg("q").alias("mq"))
    s = s.withColumn("m", F.greatest(F.lit(6), F.ceil(F.log2(2.0 * F.col("count"))).cast("int")))
    x = samples.join(s, "rec")
    return x.select("rec", "n", (F.col("i") - F.col("mi")).alias("i"), (F.col("q") - F.col("mq")).alias("q"), "count", "m")


def _kernel(second: bool):
    """Short transforms of rows (rec, m, count, class, rows of index, re, im); the first round also turns by the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                m, own = batch.column("m")[k].as_py(), batch.column("class")[k].as_py()
                rows = batch.column("rows")[k].values
                at, re, im = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("at", "re", "im"))
                size = 1 << (m // 2 if second else m - m // 2)
                x = np.zeros(size, complex)
                x[at] = re + 1j * im
                x = np.fft.fft(x)
                out = np.arange(size)
                if not second:
                    x = x * np.exp(-2j * np.pi * own * out / (1 << m))
                keep = batch.slice(k, 1).select(["rec", "m", "count", "class"])
                same = [c.take(pa.array(np.zeros(size, np.int32))) for c in keep.columns]
                yield pa.RecordBatch.from_arrays([*same, pa.array(out), pa.array(x.real.copy()), pa.array(x.imag.copy())], names=["rec", "m", "count", "class", "at", "re", "im"])

    return run


def transform(samples: DataFrame) -> DataFrame:
    """rec, m, count, bin, re, im: the discrete transform of each stream of sized(), filled up with zeros; bins from -2**(m-1) up.

    n counts from 0 within a stream; samples that are not there count as zeros.
    """
    kind = samples.schema["rec"].dataType.simpleString()
    ddl = f"rec {kind}, m int, count long, class long, at long, re double, im double"
    a = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.col("m") / 2).cast("int"))
    meet = lambda df, *cols: df.groupBy("rec", "m", "count", "class").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    x = samples.select("rec", "m", "count", (F.col("n") % a).alias("class"), F.floor(F.col("n") / a).cast("long").alias("at"), F.col("i").alias("re"), F.col("q").alias("im"))
    once = meet(x, "at", "re", "im").mapInArrow(_kernel(False), ddl)
    once = once.select("rec", "m", "count", F.col("class").alias("from"), F.col("at").alias("class"), "re", "im")
    twice = meet(once.withColumnRenamed("from", "at"), "at", "re", "im").mapInArrow(_kernel(True), ddl)
    b = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("m") - F.floor(F.col("m") / 2)).cast("int"))
    points = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m"))
    whole = F.col("class") + b * F.col("at")
    return twice.select("rec", "m", "count", F.when(whole >= points / 2, whole - points).otherwise(whole).alias("bin"), "re", "im")


def levelled(spectra: DataFrame) -> DataFrame:
    """Adds power and level: block medians over ln 2, which is the mean for noise, in a straight line between the middles of blocks."""
    x = spectra.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m") - 1)
    place = (F.col("bin") + half) / LEVEL - 0.5
    medians = x.groupBy("rec", F.floor((F.col("bin") + half) / LEVEL).alias("block")).agg((F.median("power") / math.log(2)).alias("mid"))
    last = F.floor(2 * half / LEVEL) - 1
    at = lambda k: F.greatest(F.lit(0), F.least(k, last)).cast("long")
    x = x.withColumn("left", at(F.floor(place))).withColumn("right", at(F.floor(place) + 1)).withColumn("part", place - F.floor(place))
    for side in ("left", "right"):
        x = x.join(medians.select("rec", F.col("block").alias(side), F.col("mid").alias(f"mid_{side}")), ["rec", side])
    level = F.col("mid_left") * (1 - F.col("part")) + F.col("mid_right") * F.col("part")
    return x.select("rec", "m", "count", "bin", "power", F.greatest(level, F.lit(1e-300)).alias("level"))


def find(samples: DataFrame, low: float, high: float, sequences: int = 1, alpha: float = 0.01, most: int = 8) -> DataFrame:
    """rec, frequency, uncertainty, ratio: the significant lines of each stream (rec, n, i, q), `most` of them, the strongest first by place.

    Frequencies are in cycles a sample, in [low, high]; ratio is the power over the level. The level that a line must
    reach allows for the independent bins of the band and for `sequences` searches. Streams of less than 16 samples have none.
    """
    x = sized(samples.where("n is not null and i is not null and q is not null")).where("count >= 16")
    kind = x.schema["rec"].dataType.simpleString()
    ddl = f"rec {kind}, place int, frequency double, uncertainty double, ratio double"
    rows = x.where(F.col("m") <= SHORT).groupBy("rec", "m", "count").agg(F.collect_list(F.struct("n", "i", "q")).alias("rows"))
    short = rows.mapInArrow(_short_kernel(low, high, sequences, alpha, most), ddl)
    return short.unionByName(_find_long(x.where(F.col("m") > SHORT), low, high, sequences, alpha, most))


def _short_kernel(low: float, high: float, sequences: int, alpha: float, most: int):
    """find() for rows (rec, m, count, rows of n, i, q), those with one m together."""

    def lines(m: int, count: np.ndarray, of: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        points = 1 << m
        if len(n) and n.max() >= points:
            raise ValueError("n counts from 0 within a stream")
        wide = np.zeros((len(count), 2 * points), complex)
        wide[of, n] = x
        # Twice the points: the even ones are the transform, the odd ones lie half a bin beside.
        wide = np.fft.fft(wide, axis=1)
        bins = np.arange(-points // 2, points // 2)
        power = np.square(np.abs(wide[:, (2 * bins) % (2 * points)]))
        mid = np.median(power.reshape(len(count), -1, LEVEL), axis=2) / math.log(2)
        place = (bins + points // 2) / LEVEL - 0.5
        left, last = np.floor(place).astype(int), points // LEVEL - 1
        part = place - left
        level = mid[:, np.clip(left, 0, last)] * (1 - part) + mid[:, np.clip(left + 1, 0, last)] * part
        begin, end = math.ceil(low * points), math.floor(high * points)
        band = (bins >= begin) & (bins <= end)
        ratio, bins = (power / np.maximum(level, 1e-300))[:, band], bins[band]
        none = np.full((len(count), NEAR), -np.inf)
        top = np.lib.stride_tricks.sliding_window_view(np.concatenate([none, ratio, none], axis=1), 2 * NEAR + 1, axis=1).max(axis=2)
        bar = np.log(np.maximum(1.0, np.floor((end - begin + 1) * count / points)) * (sequences / alpha))
        row, at = np.nonzero((ratio == top) & (ratio > bar[:, None]))
        order = np.lexsort((at, -ratio[row, at], row))
        row, at = row[order], at[order]
        number = np.arange(len(row)) - np.searchsorted(row, row) + 1
        row, at, number = row[number <= most], at[number <= most], number[number <= most]
        a, b, c = (np.log(np.square(np.abs(wide[row, (2 * bins[at] + k) % (2 * points)])) + 1e-300) for k in (-1, 0, 1))
        bend = a - 2 * b + c
        shift = np.clip(np.where(bend < 0, 0.25 * (a - c) / np.where(bend < 0, bend, 1.0), 0.0), -1.0, 1.0)
        strength = ratio[row, at]
        return row, number, (bins[at] + shift) / points, np.sqrt(6.0 / strength) / (2 * math.pi * count[row]), strength

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, count = batch.column("m").to_numpy(), batch.column("count").to_numpy()
            for size in np.unique(m).tolist():
                own = np.flatnonzero(m == size)
                step = max(1, POINTS >> size)
                for first in range(0, len(own), step):
                    some = own[first : first + step]
                    lists = batch.column("rows").take(pa.array(some))
                    of, rows = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy()), lists.flatten()
                    n, i, q = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("n", "i", "q"))
                    row, place, *rest = lines(size, count[some].astype(float), of, n, i + 1j * q)
                    yield pa.RecordBatch.from_arrays([batch.column("rec").take(pa.array(some[row])), pa.array(place.astype(np.int32)), *map(pa.array, rest)], names=["rec", "place", "frequency", "uncertainty", "ratio"])

    return run


def _find_long(x: DataFrame, low: float, high: float, sequences: int, alpha: float, most: int) -> DataFrame:
    points = F.pow(F.lit(2.0), F.col("m"))
    band = levelled(transform(x)).withColumn("ratio", F.col("power") / F.col("level")).where(F.col("bin").between(F.ceil(low * points), F.floor(high * points)))
    bins = F.floor(high * points) - F.ceil(low * points) + 1
    bar = F.log(F.greatest(F.lit(1.0), F.floor(bins * F.col("count") / points)) * (sequences / alpha))
    near = Window.partitionBy("rec", "chunk").orderBy("bin").rangeBetween(-NEAR, NEAR)
    cut = ordered.with_halo(band, NEAR, NEAR, "bin", 1 << 12)
    peaks = cut.withColumn("top", F.max("ratio").over(near)).where(F.col("own") & (F.col("ratio") == F.col("top")) & (F.col("ratio") > bar))
    best = Window.partitionBy("rec").orderBy(F.desc("ratio"), "bin")
    peaks = peaks.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("rec", "place", "m", "count", "bin", "ratio")
    return refined(x, peaks)


def refined(samples: DataFrame, peaks: DataFrame) -> DataFrame:
    """The frequency of each peak's top, by a parabola through the logarithms of the sums half a bin before, at and half a bin after it."""
    turn = lambda s: -2 * math.pi * (F.col("bin") + s) / F.pow(F.lit(2.0), F.col("m")) * F.col("n")
    met = samples.select("rec", "n", "i", "q").join(peaks, "rec")
    sums = []
    for name, shift in (("a", -0.5), ("b", 0.0), ("c", 0.5)):
        sums += [F.sum(F.col("i") * F.cos(turn(shift)) - F.col("q") * F.sin(turn(shift))).alias(f"{name}r"), F.sum(F.col("i") * F.sin(turn(shift)) + F.col("q") * F.cos(turn(shift))).alias(f"{name}i")]
    s = met.groupBy("rec", "place", "m", "count", "bin", "ratio").agg(*sums)
    log = lambda k: F.log(F.col(f"{k}r") * F.col(f"{k}r") + F.col(f"{k}i") * F.col(f"{k}i") + 1e-300)
    s = s.select("rec", "place", "m", "count", "bin", "ratio", *(log(k).alias(k) for k in "abc"))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    shift = F.when(bend < 0, 0.25 * (F.col("a") - F.col("c")) / bend).otherwise(0.0)
    shift = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shift))
    return s.select("rec", "place", ((F.col("bin") + shift) / F.pow(F.lit(2.0), F.col("m"))).alias("frequency"), (F.sqrt(6.0 / F.col("ratio")) / (2 * math.pi * F.col("count"))).alias("uncertainty"), "ratio")


def of_real(samples: DataFrame, value: Column) -> DataFrame:
    return samples.select("rec", "n", value.cast("double").alias("i"), F.lit(0.0).alias("q"))


def symbol_rates(samples: DataFrame, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """The strongest line of the power: pulses make it periodic in the symbol."""
    return find(of_real(samples, F.col("i") * F.col("i") + F.col("q") * F.col("q")), low, high, most=1).drop("place")


def powered(samples: DataFrame, order: int) -> DataFrame:
    """The order-th power of a complex stream; order is a power of two."""
    i, q = F.col("i"), F.col("q")
    out = samples.select("rec", "n", "i", "q")
    while order > 1:
        out, order = out.select("rec", "n", (i * i - q * q).alias("i"), (2 * i * q).alias("q")), order // 2
    return out


def carrier_offsets(samples: DataFrame, order: int, peaky: float = 4.0) -> DataFrame:
    """rec, frequency, uncertainty, ratio: the carrier of phase-shift keying of an order, from the line of its power.

    Streams whose largest magnitude is above `peaky` times the median have none: powers of such signals mislead.
    The median is taken over a stream's distinct magnitudes to four digits, so that its buffer stays small.
    """
    size = F.sqrt(F.col("i") * F.col("i") + F.col("q") * F.col("q"))
    flat = samples.groupBy("rec").agg(F.max(size).alias("top"), F.median(F.bround(size, 4)).alias("mid")).where(F.col("top") <= peaky * F.col("mid")).select("rec")
    out = find(powered(samples.join(flat, "rec", "semi"), order), -0.5 / order, 0.5 / order, most=1)
    return out.select("rec", (F.col("frequency") / order).alias("frequency"), (F.col("uncertainty") / order).alias("uncertainty"), "ratio")


def edge_energy(samples: DataFrame, scale: int) -> DataFrame:
    """How much the frequency, a mean over `scale` samples, changes from one stretch to the next: squared, as a stream."""
    return edge_energies(samples, (scale,)).select(F.col("rec.rec").alias("rec"), "n", "i", "q")


def edge_energies(samples: DataFrame, scales: tuple[int, ...]) -> DataFrame:
    """The edge energies of several scales, from one pass; rec is (rec, scale)."""
    w = Window.partitionBy("rec", "chunk").orderBy("n")
    x = ordered.with_halo(samples, 2 * max(scales), 0, "n")
    i, q = F.col("i"), F.col("q")
    for k in scales:
        x = x.withColumn(f"i{k}", F.lag("i", k).over(w)).withColumn(f"q{k}", F.lag("q", k).over(w))
    x = x.select("rec", "chunk", "n", "own", *((F.atan2(q * F.col(f"i{k}") - i * F.col(f"q{k}"), i * F.col(f"i{k}") + q * F.col(f"q{k}")) / (2 * math.pi * k)).alias(f"f{k}") for k in scales))
    for k in scales:
        x = x.withColumn(f"s{k}", F.col(f"f{k}") - F.lag(f"f{k}", k).over(w))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("scale"), F.col(f"s{k}").alias("step")) for k in scales)))
    x = x.where("own").select("rec", "n", each.alias("e")).where("e.step is not null")
    return x.select(F.struct("rec", F.col("e.scale").alias("scale")).alias("rec"), (F.col("n") - 2 * F.col("e.scale")).alias("n"), (F.col("e.step") * F.col("e.step")).alias("i"), F.lit(0.0).alias("q"))


def shift_keying_rates(samples: DataFrame, low: float = 0.01, high: float = 0.5, scales: tuple[int, ...] = (1, 2, 4, 8), harmonics: int = 4, tolerance: float = 0.002, most: int = 3) -> DataFrame:
    """rec, place, frequency, strength: up to `most` symbol rates of frequency-shift keying by the combs of their edge energy.

    A line counts if another of its first `harmonics` multiples is a line of the same scale; its strength is the sum of
    their ratios. Symbols are three times the scale long at least. Of rates within a thousandth the strongest stays.
    """
    found = settled(find(edge_energies(samples, scales), low, high, most=24).select("rec.rec", "rec.scale", "frequency", "ratio"))
    base = found.where(F.col("frequency") * F.col("scale") * 3 <= 1)
    base = base.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(harmonics)))).withColumn("target", F.col("k") * F.col("frequency"))
    other = found.select("rec", "scale", F.col("frequency").alias("f2"), F.col("ratio").alias("r2"))
    hit = base.join(other, ["rec", "scale"]).where(F.abs(F.col("f2") - F.col("target")) <= tolerance * F.col("target"))
    nearest = hit.groupBy("rec", "scale", "frequency", "ratio", "k").agg(F.min(F.struct(F.abs(F.col("f2") - F.col("target")).alias("off"), "r2")).alias("x"))
    comb = nearest.groupBy("rec", "scale", "frequency", "ratio").agg(F.sum("x.r2").alias("more")).select("rec", "scale", "frequency", (F.col("ratio") + F.col("more")).alias("strength"))
    comb = settled(comb)  # at most 24 lines a scale and stream
    stronger = comb.select("rec", F.col("frequency").alias("f2"), F.col("strength").alias("s2"), F.col("scale").alias("c2"))
    beaten = (F.abs(F.col("f2") - F.col("frequency")) <= 1e-3 * F.col("frequency")) & ((F.col("s2") > F.col("strength")) | ((F.col("s2") == F.col("strength")) & (F.col("c2") < F.col("scale"))))
    kept = comb.join(stronger.withColumnRenamed("rec", "r2"), (F.col("rec") == F.col("r2")) & beaten, "anti")
    order = Window.partitionBy("rec").orderBy(F.desc("strength"), "frequency")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("rec", "place", "frequency", "strength")
